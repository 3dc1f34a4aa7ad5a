"""Every query of the subpackage against plain Python, on odd small tables and on the driver's smallest."""

import json
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from chalkline.llm import decontamination, minhash, mixing, registry, sstable, suffix_dedup, suffix_sort, token_counts, toxicity
from chalkline.sources.scratch import scratch_path
from chalkline.sources.tables import table

COLUMNS = {
    "op1_word_pieces": ["doc_id", "n_words", "n_pieces", "n_unknown"],
    "op5_token_tables": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_winnowing": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_bottom_k": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_deep_shallow": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_host_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


def got(spark, name, folder, columns=None):
    frame = registry.QUERIES[name](spark, folder)
    return [tuple(r) for r in frame.select(*(columns or COLUMNS[name])).collect()]


def rows_of(folder, *names):
    return list(zip(*(pq.read_table(f"{folder}/documents.parquet", columns=[n]).column(0).to_pylist() for n in names), strict=True))


def items_of(folder):
    t = pq.read_table(f"{folder}/benchmark.parquet", columns=["item_id", "text"])
    return list(zip(*(c.to_pylist() for c in t.columns), strict=True))


def same(a, b):
    assert Counter(a) == Counter(b)


@pytest.fixture(params=["odd", "sf0.001"])
def folder(request, odd, sf):
    return odd[0] if request.param == "odd" else sf


def test_word_pieces(spark, folder):
    letters = {c: b for b, c in sstable._byte_letters().items()}
    with open(registry.tokenizer_path(), encoding="utf-8") as f:
        pieces = [bytes(letters[c] for c in t) for t in json.load(f)["model"]["vocab"] if all(c in letters for c in t)]
    begin, within = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}
    # Of the very long texts all but the one that is a single word, in which plain matching is quadratic
    rows = [r for r in rows_of(folder, "doc_id", "text") if max(map(len, (r[1] or "").split()), default=0) < 2_000]
    known = {r[0]: r for r in got(spark, "op1_word_pieces", folder)}
    same([known[d] for d, _ in rows], [(d, *brute.word_pieces(t, begin, within)) for d, t in rows])
    automaton = token_counts.LongestMatch([b"ab", b"abcde", b"a"], [b"c", b"cd", b"x", b"de"])
    assert [automaton.count(w) for w in (b"abcd", b"abcde", b"abcx", b"abq", b"acdde", b"acde", b"")] == [2, 1, 3, 0, 3, 0, 0]


def test_source_mixture(spark, folder):
    rows = rows_of(folder, "doc_id", "text", "source")
    size, target = brute.targets(rows)
    source = {d: s for d, _, s in rows}
    result = got(spark, "op2_source_mixture", folder, ["doc_id", "size", "source_size", "target", "taken"])
    same([(r[0], r[1], r[2]) for r in result], [(d, len(brute.words(t)), size[s]) for d, t, s in rows])
    taken = defaultdict(int)
    for d, n, _, t, k in result:
        assert abs(t - float(target[source[d]])) <= 1e-6 * max(1, t) and 0 <= k <= 2 * n
        taken[source[d]] += k
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    same(result, got(spark, "op2_source_mixture", folder, ["doc_id", "size", "source_size", "target", "taken"]))


def test_mixture_slots_follow_the_shares(spark, sf):
    _, mix = mixing.mix_sources(table(spark, sf, "documents"), block_words=64)
    slots = sorted({(r.slot, r.sid) for r in mix.select("slot", "sid").collect()})
    assert len(slots) == len({s for s, _ in slots})
    half = len(slots) // 2
    first, whole = Counter(s for _, s in slots[:half]), Counter(s for _, s in slots)
    assert all(abs(first[s] - n / 2) < 6 for s, n in whole.items())
    words = mix.groupBy("sid", "block").agg({"hi": "sum", "lo": "sum"}).collect()
    assert max(r["sum(hi)"] - r["sum(lo)"] for r in words) == 64


def test_mixture_is_what_the_schedule_takes(spark, sf):
    docs = table(spark, sf, "documents")
    found, mix = mixing.mix_sources(docs, block_words=64)
    last = mix.agg({"slot": "max"}).first()[0]
    cut, part = mixing.mix_sources(docs, block_words=64, n_slots=last // 2)
    assert part.agg({"slot": "max"}).first()[0] < last // 2
    by_source = lambda f: {r["source"]: r["n"] for r in f.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    whole, half = by_source(found), by_source(cut)
    assert all(abs(half[s] - n / 2) <= 6 * 64 for s, n in whole.items())
    # Of a document, what the slots before the end say, and nothing without a slot
    expected = Counter()
    for r in mix.filter(f"slot < {last // 2}").collect():
        expected[r.doc_id] += r.hi - r.lo
    assert {r.doc_id: r.taken for r in cut.collect() if r.taken} == dict(expected)
    none, _ = mixing.mix_sources(docs, n_slots=0)
    assert none.agg({"taken": "sum"}).first()[0] == 0 and none.count() == docs.count()


def test_golden_points_are_a_permutation():
    for n in (0, 1, 2, 3, 100, 6765):
        number, before = mixing.golden_fractions(n)
        assert number >= max(n, 2) and sorted(i * before % number for i in range(number)) == list(range(number))


def test_many_sources(spark, tmp_path, monkeypatch):
    """A source for every other document, joined by shuffle."""
    from conftest import save

    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), f"s{i // 2:03}" if i < 300 else "hot") for i in range(450)]
    folder = save(tmp_path, rows)
    small = got(spark, "op2_source_mixture", folder, ["doc_id", "size", "source_size", "target", "taken", "first_slot"])
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    same(small, got(spark, "op2_source_mixture", folder, ["doc_id", "size", "source_size", "target", "taken", "first_slot"]))
    size, target = brute.targets(rows)
    source, taken = {d: s for d, _, s in rows}, defaultdict(int)
    for r in small:
        assert abs(r[3] - float(target[source[r[0]]])) < 1e-6
        taken[source[r[0]]] += r[4]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


@pytest.mark.parametrize("name", ["op3_cotraining", "op4_char_nbsvm"])
def test_scores_are_whole_and_in_range(spark, folder, name):
    result = got(spark, name, folder, ["doc_id", "held_out", "score", "predicted"])
    same([(r[0], r[1]) for r in result], [(d, zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in rows_of(folder, "doc_id", "text")])
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, _, s, p in result)


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


@pytest.mark.parametrize(("name", "label", "least"), [("op4_char_nbsvm", "toxic", 0.95), ("op3_cotraining", "quality", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels[label], strict=True))
    scored = [(s, truth[d]) for d, h, s in got(spark, name, folder, ["doc_id", "held_out", "score"]) if h and truth.get(d) is not None]
    assert len(scored) > 20 and auc(scored) >= least


def fitted(x, y, w=None, steps=12, l2=1.0, like=None):
    """Newton's logistic regression in plain steps: (mean, scale, weights)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if like is None else like[:2]
    z = np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))
    w = np.zeros(z.shape[1]) if w is None else w
    ridge = np.array([l2] * (z.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
    return mean, scale, w


def logits(model, x):
    return np.hstack((np.clip((x - model[0]) / model[1], -8, 8), np.ones((len(x), 1)))) @ model[2]


def test_cotraining_by_hand(spark):
    """Every score against a local version that keeps all labels in arrays."""
    from chalkline.llm import cotraining

    folder = "/root/testdata/sf0.01"
    model, features = cotraining.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    rows = sorted(features.collect(), key=lambda r: r.doc_id)
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(float)
    views = x[:, : cotraining.TEXT_DIM], x[:, cotraining.TEXT_DIM :]
    y, fold, teaches = (np.array([r[n] for r in rows]) for n in ("y", "fold", "teaches"))
    learn, checks, pool = (y >= 0) & teaches & (fold != 1), (y >= 0) & teaches & (fold == 1), (y < 0) & teaches
    models = [fitted(v[learn], y[learn]) for v in views]
    label, most, least = [np.where(learn, y, -1) for _ in views], int(0.05 * pool.sum()), np.ceil(128 * np.log(0.95 / 0.05))
    for _ in range(4):
        for teacher, pupil in ((0, 1), (1, 0)):
            at = logits(models[teacher], views[teacher])
            before = label[pupil].copy()
            for value, sure in ((1, at), (0, -at)):
                bins = np.floor(np.minimum(sure, 30) * 128)
                open_ = np.flatnonzero(pool & (before < 0) & (bins >= least))
                bins = bins[open_]
                taken = [b for b in sorted(set(bins)) if (bins >= b).sum() <= most] or [max(bins, default=np.inf)]
                label[pupil][open_[bins >= taken[0]]] = value
        models = [fitted(v[k >= 0], k[k >= 0], m[2], 3, like=m) for v, k, m in zip(views, label, models, strict=True)]
    ends = [fitted(logits(m, v)[checks][:, None], y[checks]) for m, v in zip(models, views, strict=True)]
    both = np.stack([logits(c, logits(m, v)[:, None]) for c, m, v in zip(ends, models, views, strict=True)], 1)
    expected = 1 / (1 + np.exp(-logits(fitted(both[checks], y[checks]), both)))
    assert (label[0] >= 0).sum() > learn.sum() and (label[1] >= 0).sum() > learn.sum()
    found = {r.doc_id: r.score for r in cotraining.score(features, model).collect()}
    # Sums come in another order, here and with other kernels of a processor, but labels are passed on by whole bins
    np.testing.assert_allclose([found[r.doc_id] for r in rows], expected, atol=1e-6)


def test_toxicity_by_hand(spark):
    """Scores against dictionaries of n-grams and a plain regression on the same places."""
    folder = "/root/testdata/sf0.001"
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    known = {d: t for d, t in zip(labels["doc_id"], labels["toxic"], strict=True) if t is not None and zlib.crc32(str(d).encode()) % 5}
    from chalkline.llm import columnar

    def grams(text):
        plain = "".join(" " if c in " \t\n\v\f\r" else c.lower() if c.isascii() else c for c in text or "")
        return {plain[i : i + n] for n in toxicity.GRAMS for i in range(len(plain) - n + 1)}

    def places(text):
        names = sorted(grams(text))
        data = np.frombuffer("".join(names).encode(), np.uint8)
        ends = np.cumsum([len(g.encode()) for g in names])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if names else ends
        return set((columnar.span_hashes(columnar.prefix_sums(data), starts, ends) >> np.uint64(64 - toxicity.BITS)).tolist()) if names else set()

    rows = rows_of(folder, "doc_id", "text")
    of = {d: places(t) for d, t in rows}
    counts = [Counter(p for d, y in known.items() if y == k for p in of[d]) for k in (0, 1)]
    n = [sum(y == k for y in known.values()) for k in (0, 1)]
    ratio = lambda p: np.log((counts[1][p] + 1) / (n[1] + 2)) - np.log((counts[0][p] + 1) / (n[0] + 2))
    strength = {p: abs(ratio(p)) / (1 / (counts[1][p] + 1) + 1 / (counts[0][p] + 1)) ** 0.5 for p in counts[0] | counts[1] if counts[0][p] + counts[1][p] >= 3}
    chosen = sorted(sorted(strength, key=lambda p: (-strength[p], p))[:4096])
    x = np.array([[ratio(p) * (p in of[d]) for p in chosen] for d in known])
    y, w, b = np.array(list(known.values())), np.zeros(len(chosen)), 0.0
    for _ in range(40):
        s = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        k = s * (1 - s) + 1e-9
        z = np.hstack((x, np.ones((len(x), 1))))
        h = z.T @ (z * k[:, None]) / len(x) + np.diag([1e-4] * len(chosen) + [1e-12])
        step = np.linalg.solve(h, np.append(x.T @ (y - s) / len(x) - 1e-4 * w, (y - s).mean()))
        w, b = w + step[:-1], b + step[-1]
    weights = dict(zip(chosen, w, strict=True))
    found = dict(got(spark, "op4_char_nbsvm", folder, ["doc_id", "score"]))
    model = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    assert np.flatnonzero(model[0]).tolist() == [p for p in chosen if ratio(p)]
    expected = {d: 1 / (1 + np.exp(-b - sum(weights[p] * ratio(p) for p in of[d] if p in weights))) for d, _ in rows}
    np.testing.assert_allclose([found[d] for d in expected], list(expected.values()), atol=1e-3)


def encode_with(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_token_tables(spark, folder):
    same(got(spark, "op5_token_tables", folder), brute.token_rows(rows_of(folder, "doc_id", "text"), encode_with(registry.tokenizer_path())))


def test_shards_are_searched(spark, sf):
    path, encode = scratch_path(spark, "shards"), encode_with(registry.tokenizer_path())
    manifest = sstable.write_tables(table(spark, sf, "documents"), path, registry.tokenizer_path(), 3)
    readers = [sstable.open_shard(f) for (f,) in manifest.select("file").collect()]
    assert len(readers) > 1
    for doc_id, text in rows_of(sf, "doc_id", "text")[::23]:
        found = [x for r in readers for x in r.lookup(doc_id)]
        assert len(found) == 1 and found[0].tolist() == [*encode(text or ""), 0]
    assert not any(r.lookup(10**12) for r in readers)


def test_winnowing(spark, folder):
    same(got(spark, "op6_winnowing", folder), brute.contaminated(rows_of(folder, "doc_id", "text"), items_of(folder)))


def test_winnowing_by_join(spark, folder):
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"], broadcast_bytes=0)
    expected = brute.contaminated(rows_of(folder, "doc_id", "text"), items_of(folder))
    same([(r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]).encode())) for r in found.collect()], [x[:5] for x in expected])


def test_secrets(spark, folder):
    by_id = {r[0]: r for r in got(spark, "op7_markov_secrets", folder, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])}
    for doc_id, text in rows_of(folder, "doc_id", "text"):
        spans = brute.secrets(text)
        listed = [f"{brute.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert by_id[doc_id][1:5] == (*(sum(k == i for _, k, _ in spans) for i in range(3)), brute.sha(",".join(listed).encode()))
        every = [x for x in by_id[doc_id][5].split(",") if x]
        assert [x for x in every if not x.startswith("random")] == listed
        order = [(int(x.split(":")[1]), ["assign", "access", "hex", "random"].index(x.split(":")[0])) for x in every]
        assert order == sorted(order)


def test_markov_spans(spark, tmp_path):
    from conftest import save

    prose = "the quick answer of the committee was understandable and internationalization_of_configuration_settings was kept "
    rng = random.Random(11)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    rows = [(i, prose * 3 + (key() if i % 2 else "com.example.project.settings.manager"), "a") for i in range(40)]
    found = dict(got(spark, "op7_markov_secrets", save(tmp_path, rows), ["doc_id", "spans"]))
    at = len(prose) * 3
    assert not any(found[i] for i in range(0, 40, 2))
    assert {found[i] for i in range(1, 40, 2)} <= {f"random:{at}:{at + 32}", ""}
    assert sum(bool(found[i]) for i in range(1, 40, 2)) >= 18


def test_added_spans_by_labels(spark, tmp_path):
    """Precision and recall of the added spans: drawn keys of several alphabets against identifiers, in prose of the corpus."""
    from conftest import save

    rng, folder = random.Random(12), "/root/testdata/sf0.001"
    prose = [t for _, t in rows_of(folder, "doc_id", "text") if t]
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    words = sorted({w.strip(".,").lower() for t in prose for w in t.split() if w.isascii() and w.strip(".,").isalpha()})
    identifier = lambda: rng.choice("._-/").join(rng.choice(words) for _ in range(rng.randint(4, 7)))
    rows, truth = [], {}
    for i in range(400):
        token = "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.randint(24, 44))).strip("-_") if i % 2 else identifier()
        if len(token) >= 20:
            rows.append((i, f"{prose[i % len(prose)]}\n{token} end", "a"))
            truth[i] = i % 2 == 1, len(prose[i % len(prose)]) + 1, len(token)
    found = dict(got(spark, "op7_markov_secrets", save(tmp_path, rows), ["doc_id", "spans"]))
    said = {i: f"random:{at}:{at + n}" in found[i].split(",") for i, (_, at, n) in truth.items()}
    right = sum(said[i] and truth[i][0] for i in truth)
    precision, recall = right / max(1, sum(said.values())), right / sum(t[0] for t in truth.values())
    print(f"precision {precision:.3f} recall {recall:.3f}")
    assert precision >= 0.95 and recall >= 0.9


#: Shapes that training never draws, with the least share of keys and the largest of names that is reported.
KEY_SHAPES = {"prefix": ("sk_live_", 24, "letters", 0.9), "long prefix": ("ghp_", 36, "letters", 0.95), "groups": ("", 25, "groups", 0.75), "uuid": ("", 32, "uuid", 0.9), "upper hex": ("", 32, "upper", 0.85), "padded": ("", 64, "padded", 0.95)}
NAMES = "account balance customer invoice payment server request response handler factory builder manager context session config network storage cluster partition shuffle executor driver memory buffer stream channel listener adapter controller service repository entity mapper query index table column record schema".split()


def test_added_spans_by_unseen_shapes(spark, sf):
    """Recall for each shape of key and false reports for each shape of name; neither alphabets' groups nor cases nor words are those of training."""
    import uuid

    from chalkline.llm import secret_scan

    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    body = {"letters": lambda n: drawn(letters, n), "groups": lambda n: "-".join(drawn("ABCDEFGHJKMNPQRSTVWXYZ0123456789", 5) for _ in range(n // 5)), "uuid": lambda n: str(uuid.UUID(int=rng.getrandbits(128))), "upper": lambda n: drawn("0123456789ABCDEF", n), "padded": lambda n: drawn(letters + "+/", n) + "=="}
    name = {"camel": lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), "path": "/".join, "upper": lambda w: "_".join(w).upper(), "package": lambda w: "org." + ".".join(w) + "." + w[0].capitalize(), "version": lambda w: "-".join(w) + f"-{rng.randint(0, 9)}.{rng.randint(0, 20)}", "one word": "".join}
    model = secret_scan.train(table(spark, sf, "documents"))
    total, mean = secret_scan.cuts(model)

    def reported(token):
        ratio = float(model[secret_scan.transitions(token.encode())].sum())
        return ratio >= total and ratio >= mean * len(token)

    shares = {shape: np.mean([reported(prefix + body[kind](n)) for _ in range(300)]) for shape, (prefix, n, kind, _) in KEY_SHAPES.items()}
    false = {shape: np.mean([reported(t) for t in (make([rng.choice(NAMES) for _ in range(4)]) for _ in range(300)) if len(t) >= secret_scan.MIN_TOKEN]) for shape, make in name.items()}
    print({k: round(float(v), 3) for k, v in (shares | false).items()})
    assert all(shares[shape] >= least for shape, (*_, least) in KEY_SHAPES.items()) and max(false.values()) <= 0.02
    # The drawn samples are those of a fixed generator, whatever library names there are
    assert np.array_equal(secret_scan.seeded_counts(500), secret_scan.seeded_counts(500)) and secret_scan.drawn_name(np.random.Generator(np.random.PCG64(1))) == secret_scan.drawn_name(np.random.Generator(np.random.PCG64(1)))


def test_long_text_dense_in_keys():
    """Time in proportion to the length."""
    import time

    text = ("token: abcdef123 日本 " + "0123456789abcdef" * 2 + " Zx9Qw8Er7Ty6Ui5Op4As3 ") * 40_000
    import pyarrow as pa

    from chalkline.llm import columnar, secret_scan

    began = time.time()
    [chunk] = columnar.text_chunks(pa.array([text]))
    [(_, _, spans, free)] = secret_scan.scan(chunk)
    assert len(spans) == 80_000 and len(free) == 40_000 and time.time() - began < 20


def test_near_groups(spark, folder):
    expected = brute.near_groups(rows_of(folder, "doc_id", "text"))
    same(got(spark, "op8_bottom_k", folder), [(d, *x) for d, x in expected.items()])


def test_near_groups_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 4)
    found = minhash.near_duplicates(table(spark, odd[0], "documents"))
    same([tuple(r) for r in found.collect()], [(d, *x) for d, x in brute.near_groups(rows_of(odd[0], "doc_id", "text")).items()])


def test_removed_repeats(spark, folder):
    same(got(spark, "op9_deep_shallow", folder), brute.without_repeats(rows_of(folder, "doc_id", "text")))


def test_removed_repeats_of_frequent_minimizers(spark, odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_UNITS", 2)
    monkeypatch.setattr(suffix_dedup, "HOT_BATCH", 2)
    found = suffix_dedup.remove_repeats(table(spark, odd[0], "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    same([(*r[:4], brute.sha(bytes(r[4]))) for r in found.collect()], brute.without_repeats(rows_of(odd[0], "doc_id", "text")))


@pytest.mark.parametrize("shallow", [0, 1, 2])
def test_deep_shallow_order(shallow):
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (400, 24)).astype(np.uint8)
    rows[100:200, :18] = rows[0, :18]
    rows[200:300] = rows[rng.integers(0, 50, 100)]
    order, first = suffix_sort.deep_shallow_sort(rows, shallow)
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(r.tobytes() for r in rows) and sorted(order) == list(range(400))
    assert first.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(400)]


@pytest.mark.parametrize("name", ["op2_source_mixture", "op6_winnowing", "op8_bottom_k", "op9_deep_shallow", "op10_host_rules"])
def test_sql(spark, sf, name):
    """The queries against their SQL, on the driver's smallest tables."""
    from compare import assert_same, connect

    assert_same(registry.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(registry.ORACLE_SQL[name]).df())


def test_host_rules(spark, folder):
    same(got(spark, "op10_host_rules", folder), brute.host_rules(rows_of(folder, "doc_id", "text", "source")))


def test_hosts_fall(spark, tmp_path):
    """Hosts whose documents fail often lose their good documents too; a small host needs more evidence."""
    from conftest import save

    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    noisy = lambda: " ".join("#" + w for w in good().split())
    hosts = {"bad": (30, 10), "good": (2, 58), "one": (1, 0), "few": (2, 1), None: (25, 3), **{f"h{i}": (0, 6) for i in range(30)}}
    rows, n = [], 0
    for host, (fails, passes) in hosts.items():
        for text in [*(noisy() for _ in range(fails)), *(good() for _ in range(passes))]:
            rows.append((n, text, host))
            n += 1
    result = got(spark, "op10_host_rules", save(tmp_path, rows))
    same(result, brute.host_rules(rows))
    kept = Counter(host for (_, _, host), r in zip(rows, sorted(result), strict=True) if r[-1])
    assert not any(r[-2] for r in result)
    assert "bad" not in kept and None not in kept and kept["good"] == 60 and kept["one"] == 1 and kept["few"] == 3 and kept["h3"] == 6


# --- repeated rows, null ids, empty tables -----------------------------------------------------------------------


def test_repeated_rows_and_null_ids(spark, repeated):
    folder, rows = repeated
    pairs = [(d, t) for d, t, _ in rows]
    tokens, expected = got(spark, "op5_token_tables", folder), brute.token_rows(pairs, encode_with(registry.tokenizer_path()))
    same([(r[0], r[2], r[3]) for r in tokens], [(r[0], r[2], r[3]) for r in expected])
    by_start = sorted(tokens, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.cumsum([0, *(r[2] for r in by_start)]).tolist()[:-1]
    same(got(spark, "op6_winnowing", folder), brute.contaminated(pairs, items_of(folder)))
    same(got(spark, "op9_deep_shallow", folder), brute.without_repeats(pairs))
    same(got(spark, "op10_host_rules", folder), brute.host_rules(rows))
    size, target = brute.targets(rows)
    taken = sum(r[0] for r in got(spark, "op2_source_mixture", folder, ["taken"]))
    assert abs(taken - sum(target.values())) <= len(target)
    for name in ("op1_word_pieces", "op3_cotraining", "op4_char_nbsvm", "op7_markov_secrets", "op8_bottom_k"):
        same(got(spark, name, folder, ["doc_id"]), [(d,) for d, _ in pairs])


def test_values_of_repeated_rows(spark, repeated):
    """Repeated rows and null ids have the values of their own texts."""
    from chalkline.llm import cotraining, secret_scan

    folder, rows = repeated
    docs = table(spark, folder, "documents")
    texts = [t or "" for _, t, _ in rows]
    found = secret_scan.find_secrets(docs, ["doc_id", "text"]).collect()
    listed = lambda spans: tuple((s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in spans if s["kind"] != "random")
    same([(r["doc_id"], r["text"] or "", listed(r["spans"])) for r in found], [(d, t or "", tuple(brute.secrets(t))) for d, t, _ in rows])
    labels = table(spark, folder, "labels")
    scored = toxicity.score(docs, ["doc_id", "text"], toxicity.train(docs, labels)).collect()
    by_text = defaultdict(set)
    for r in scored:
        by_text[r["text"] or ""].add(r["score"])
    assert len(scored) == len(rows) and set(by_text) == set(texts) and all(len(x) == 1 for x in by_text.values())
    model, features = cotraining.train(docs, labels)
    assert Counter(r["doc_id"] for r in cotraining.score(features, model).collect()) == Counter(d for d, _, _ in rows)
    sizes = {(d, len(brute.shingles(t))) for d, t, _ in rows}
    assert {(r[0], r[1]) for r in got(spark, "op8_bottom_k", folder)} == sizes
    counted = token_counts.token_counts(docs, ["doc_id", "text"], registry.TOKENIZER).collect()
    per_text = defaultdict(set)
    for r in counted:
        per_text[r["text"] or ""].add((r["n_words"], r["n_pieces"], r["n_unknown"]))
    assert len(counted) == len(rows) and all(len(x) == 1 for x in per_text.values())


def test_repeated_ids_in_near_groups(spark, repeated):
    """An id with two texts links with the copies of both; a null id takes its group's smallest id."""
    result = got(spark, "op8_bottom_k", repeated[0])
    base = {r[2] for r in result if r[0] in (6, 7)}
    assert base == {6}
    assert {r[2:] for r in result if r[0] is None and r[1] > 100} == {(6, False)}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_training_reads_no_held_out_label(spark, odd):
    docs, labels = table(spark, odd[0], "documents"), table(spark, odd[0], "labels")
    kept = labels.filter(~toxicity.held_out())
    a, b = toxicity.train(docs, labels, "toxic"), toxicity.train(docs, kept, "toxic")
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]
