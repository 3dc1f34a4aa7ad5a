"""Conversation trie, source divergence and n-gram join against plain Python, on odd, hot and empty tables."""

import random

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import save
from test_training_operators import got, rows_of, same

from chalkline.llm import columnar, divergence, ngram_join, registry, turn_trie

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
RANKS = ["lang", "source", "part", "item", "value", "rank"]


def talks(folder, rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("conv_id", "turn", "role", "text"), kinds, strict=True))}
    clash = {n: pa.array([7] * len(rows), pa.int64()) for n in ("conv", "depth", "pos", "ids", "top", "m")}
    pq.write_table(pa.table(columns | clash), f"{folder}/conversations.parquet")
    return str(folder)


def odd_talks():
    """Nulls everywhere, ties, repeated rows, negative and absent bases, a hot copy, shared prefixes and a long one."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "é𝄞", "", None, "x" * 9])) for c in [*range(0, 60), *range(-130, -95), 1003, 1004] for t in range(rng.randint(1, 4))]
    rows += [(2000 + i, t, "user", f"line {t}") for i in range(70) for t in range(3)]  # one conversation, seventy times
    rows += [(3000 + i, t, "user", f"step {t}" if t < 40 else f"own {i}") for i in range(30) for t in range(41)]  # part after forty turns
    rows += [(3100 + i, t, "user", f"step {t}") for i in range(25) for t in range(i)]  # prefixes of each other
    rows += [(5000, t, None, f"word {t}") for t in range(300)] + [(5001, t, None, f"word {t}") for t in range(299)]
    return rows + [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, None, "user", "first"), (7, 1, None, None), (8, 0, "user", "tie"), (8, 0, "assistant", "tie"), (8, 0, "user", "tie two"), rows[0], rows[0]]


@pytest.mark.parametrize("local", [turn_trie.LOCAL, 7])
def test_trie(spark, tmp_path, monkeypatch, local):
    """``local`` 7: all but small buckets are split in rounds."""
    monkeypatch.setattr(turn_trie, "LOCAL", local)
    monkeypatch.setattr(turn_trie, "PIECE_BITS", 4)
    rows = odd_talks()
    same(got(spark, "op11_turn_trie", talks(tmp_path, rows), TRIE), brute.trie(rows))


def test_trie_of_the_tables(spark, sf):
    t = pq.read_table(f"{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"])
    same(got(spark, "op11_turn_trie", sf, TRIE), brute.trie(list(zip(*(c.to_pylist() for c in t.columns), strict=True))))


def test_trie_without_conversations(spark, tmp_path):
    assert got(spark, "op11_turn_trie", talks(tmp_path, []), TRIE) == []
    assert got(spark, "op11_turn_trie", talks(tmp_path, [(None, 1, "a", "b")]), TRIE) == []


def test_divergence(spark, odd, monkeypatch, tmp_path):
    rows = rows_of(odd[0], "text", "lang", "source")
    same(got(spark, "op12_source_divergence", odd[0], RANKS), brute.divergence(rows))
    # Small stretches, blocks of few sources, joins by shuffle
    for name, value in (("COMBINED", 64), ("BLOCK_SOURCES", 2), ("CELLS", 32), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(divergence, name, value)
    same(got(spark, "op12_source_divergence", odd[0], RANKS), brute.divergence(rows))


def test_divergence_of_the_tables(spark, sf, empty):
    same(got(spark, "op12_source_divergence", sf, RANKS), brute.divergence(rows_of(sf, "text", "lang", "source")))
    assert got(spark, "op12_source_divergence", empty, RANKS) == []


def test_divergence_of_many_sources_with_null_and_long_terms(spark, tmp_path):
    rows = [(i, f"{'w' * (i % 40 + 1)} Term{'é' * (i % 5)} a b {'z' * 17}", None if i % 5 == 0 else f"s{i % 11}") for i in range(90)] + [(90, None, "only"), (91, "1 2 3", "only"), (92, "x", None), (92, "x", None)]
    folder = save(tmp_path, rows)
    same(got(spark, "op12_source_divergence", folder, RANKS), brute.divergence(rows_of(folder, "text", "lang", "source")))


def test_large_counts_stay_exact():
    counts, n = np.array([[0, 5 * 10**12, 3]]), np.array([10, 7 * 10**12, 9])
    expected = [[1 + 10**9 * (int(c) + 1) // int(k) for c, k in zip(counts[0], n, strict=True)]]
    assert divergence.probabilities(counts, n).tolist() == expected


def test_join(spark, odd, sf):
    for folder in (odd[0], sf):
        expected = brute.similar_groups(rows_of(folder, "doc_id", "text"))
        same(got(spark, "op13_ngram_join", folder, ["doc_id", "n_shingles", "component_id"]), [(d, *x) for d, x in expected.items()])


def test_join_with_repeated_and_null_ids(spark, repeated, empty):
    folder, rows = repeated
    found = got(spark, "op13_ngram_join", folder, ["doc_id", "n_shingles", "component_id"])
    named = [(d, t) for d, t, _ in rows if d is not None]
    component = {d: c for d, (_, c) in brute.similar_groups(named).items()}
    assert len(found) == len(rows) and {(d, c) for d, _, c in found if d is not None} == set(component.items())
    texts = {t: component[d] for d, t in named if t}
    assert sorted(str(c) for d, _, c in found if d is None) == sorted(str(texts.get(t)) for d, t, _ in rows if d is None)
    assert got(spark, "op13_ngram_join", empty, ["doc_id"]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_one_large_group(spark, tmp_path, monkeypatch, seed):
    """Near copies of one text, many of which are linked by others only, in blocks of a few."""
    rng = random.Random(seed)
    base, rows = [f"w{rng.randint(0, 400)}" for _ in range(150)], []
    for i in range(160):
        words = list(base if i % 3 else rows[rng.randrange(len(rows))][1].split() if rows else base)
        for _ in range(rng.choice((1, 2, 2, 3, 4))):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 30)}"
        rows.append((i, " ".join(words), "a"))
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 12)
    expected = brute.similar_groups([r[:2] for r in rows])
    assert 1 < len({c for _, c in expected.values()}) < 120
    same(got(spark, "op13_ngram_join", save(tmp_path, rows), ["doc_id", "n_shingles", "component_id"]), [(d, *x) for d, x in expected.items()])


def test_filters_of_all_orders_lose_no_link():
    """Pairs at the limit pass every order; and lists hold what the bound says."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 10, 11, 19, 20, 21, 100, 999):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for gone in range(prefix_max := max(1, n // 9 + 1)):
            b = np.sort(np.concatenate((a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**63, rng.integers(0, prefix_max), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
                sizes = np.array([len(a), len(b)])
                lists = [[ngram_join.first_members(s, o) for s in (a, b)] for o in ngram_join.ORDERS]
                assert ngram_join.maybe_similar(lists, sizes, np.array([0]), np.array([1])).all(), (n, gone)


def test_shingles_of_three_words():
    chunk = next(columnar.text_chunks(pa.array(["A b c d", "a B", None, "a b c d a b c"])))
    assert [len(s) for s in ngram_join.shingle_sets(chunk)] == [2, 1, 0, 4]


def test_all_three_are_registered():
    assert {"op11_turn_trie", "op12_source_divergence", "op13_ngram_join"} <= registry.QUERIES.keys() & registry.ORACLE_SQL.keys()
