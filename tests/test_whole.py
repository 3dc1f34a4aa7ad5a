"""The whole job of queries whose SQL has a cut, or that have none: small fixtures against brute force."""

import datetime
import hashlib
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from chalkline.operators import ingest, practice
from chalkline.plans import ingest as ingest_queries
from chalkline.plans import memory as memory_queries
from chalkline.plans import practice as practice_queries


def parts_of(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return {frozenset(i for i in ids if find(i) == find(r)) for r in ids}


def check_links(found, sets):
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(i for i in sets if len(sets[i]) >= 3)
    true = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 3 and jaccard(a, b) >= 0.72}
    assert {(r["a"], r["b"]) for r in found} <= true
    assert all(abs(r["jaccard"] - jaccard(r["a"], r["b"])) < 1e-6 for r in found)
    assert parts_of(ids, [(r["a"], r["b"]) for r in found]) == parts_of(ids, true)


def test_near_duplicates_of_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    opening, body = [word() for _ in range(14)], [word() for _ in range(90)]
    texts = [[*(word() for _ in range(14)), *body], [*(word() for _ in range(14)), *body], [*opening, *(word() for _ in range(90))], [*opening, *(word() for _ in range(90))], ["one", "two"], ["one", "two"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = practice_queries.near_duplicate_pairs(spark, str(tmp_path)).collect()
    assert [(r["a"], r["b"]) for r in found] == [(0, 1)]
    check_links(found, {i: set(t) for i, t in enumerate(texts)})


def test_near_duplicate_links_are_few(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    base = vocabulary[:40]
    sets = {i: set(rng.sample(base, 37)) for i in range(80)} | {100 + i: set(base) for i in range(50)}
    sets |= {200 + i: set(rng.sample(vocabulary, rng.randint(1, 12))) for i in range(150)} | {400 + i: set(f"c{j}" for j in range(i * 3, i * 3 + 25)) for i in range(30)}
    rows = [(i, sorted(s)) for i, s in sets.items()]
    for size, listed in ((1024, 128), (1024, 1), (16, 1), (16, 12)):  # pairs of lists, groups only, groups in several blocks, both
        monkeypatch.setattr(practice, "BLOCK_CLASSES", size)
        monkeypatch.setattr(practice, "LIST", listed)
        found = practice.similar_objectives(spark.createDataFrame(rows, "id long, words array<string>")).collect()
        check_links(found, sets)
    monkeypatch.undo()
    found = practice.similar_objectives(spark.createDataFrame(rows, "id long, words array<string>").filter(F.col("id").between(100, 149))).collect()
    assert len(found) == 49


def test_every_link_of_different_sets_has_its_row(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    sets = {i: frozenset(rng.sample(base, 36)) for i in range(200)} | {300 + i: frozenset(rng.sample(base, 3 + i % 30)) for i in range(60)} | {400: frozenset(base[:36]), 401: frozenset(base[:36])}
    least = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    linked = lambda a, b: len(a & b) >= 3 and len(a & b) / len(a | b) >= 0.72
    true = {(a, b) for s, a in least.items() for t, b in least.items() if a < b and linked(s, t)} | {(least[s], i) for i, s in sets.items() if least[s] != i}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, words array<string>")
    for size, listed in ((practice.BLOCK_CLASSES, practice.LIST), (50, 10)):
        monkeypatch.setattr(practice, "BLOCK_CLASSES", size)
        monkeypatch.setattr(practice, "LIST", listed)
        found = practice.similar_objectives(frame).collect()
        assert len(found) == len(true) and {(r["a"], r["b"]) for r in found} == true
        check_links(found, sets)


def test_links_that_span_are_few(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(40)]
    sets = {i: set(rng.sample(base, 37)) for i in range(60)} | {100 + i: {f"c{i}", f"d{i}", "e"} for i in range(5)}
    hashed = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, words array<string>").select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("vs"))
    found = practice.similar_sets(hashed, spanning=True).collect()
    check_links(found, sets)
    assert len(found) == 59


def test_words_of_texts(spark):
    texts = ["", None, "one two  Two", "ab-ab9ab", "z" * 9 + " " + "z" * 8 + " " + "z" * 17, "zzzzzzzzz", "é日本ab語cd", "\u212aelvin kelvin", "tail", "head tail", "a b c " * 40]
    rows = spark.createDataFrame([*enumerate(texts)], "id long, text string").coalesce(1)
    found = {r["id"]: set(r["vs"]) for r in practice.text_word_sets(rows).collect()}
    words = {i: set(re.findall("[a-z]+", (t or "").lower())) for i, t in enumerate(texts)}
    assert all(len(found[i]) == len(words[i]) and len(found[i] & found[j]) == len(words[i] & words[j]) for i in words for j in words)


def test_few_pairs_leave_the_lists(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    rare = [word() for _ in range(5)]  # in all sets' prefixes
    sets = {}
    for i in range(60):
        common = [word() for _ in range(150)]
        sets |= {2 * i: {*rare, *common, *(word() for _ in range(25))}, 2 * i + 1: {*rare, *common, *(word() for _ in range(25))}}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "key long, words array<string>")
    hashed = frame.select("key", F.sort_array(F.transform("words", lambda w: F.xxhash64(w))).alias("vs"))
    found = {(r["a"], r["b"]) for r in practice._candidates(hashed, 0.72).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(60)} <= found and len(found) < 200


def test_groups_are_the_parts_of_all_pairs(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60)]
    texts = [" ".join(rng.sample(words[:30], 27)) for _ in range(20)] + [" ".join(rng.sample(words[30:], 12)) for _ in range(20)] + [None, "", "one two", "one two three", "Three, TWO one!", "one two three 4"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = practice_queries.near_duplicate_pairs(spark, str(tmp_path)).collect()
    sets = {i: set(re.findall("[a-z]+", (t or "").lower())) for i, t in enumerate(texts)}
    check_links(pairs, sets)
    found = {r["id"]: r["component"] for r in practice_queries.near_duplicate_groups(spark, str(tmp_path)).collect()}
    assert found == {i: min(part) for part in parts_of([i for i in sets if len(sets[i]) >= 3], [(r["a"], r["b"]) for r in pairs]) for i in part}


def test_sketches_keep_every_link_and_few_others(spark):
    rng = random.Random(5)
    sets = {}
    for i in range(60):  # neighbours at the limit of 0.72, and others that share a rare word
        common = [rng.getrandbits(63) for _ in range(180)]
        sets |= {2 * i: [7, *common, *(rng.getrandbits(63) for _ in range(35))], 2 * i + 1: [7, *common, *(rng.getrandbits(63) for _ in range(35))]}
    frame = spark.createDataFrame(list(sets.items()), "key long, vs array<long>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    found = {(r["a"], r["b"]) for r in practice._sketched(pairs, frame, 0.72).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(60)} <= found and len(found) < 200
    short = spark.createDataFrame([(0, [1, 2, 3]), (1, list(range(100))), (2, list(range(72))), (3, list(range(200, 272)))], "key long, vs array<long>")
    near = practice._sketched(spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "a long, b long"), short, 0.72).collect()
    assert [(r["a"], r["b"]) for r in near] == [(1, 2)]


def test_texts_are_judged_whole(spark, tmp_path):
    prose = "some plain words of a lesson " * 100
    documents = [(1, prose), (2, prose + "my password is x"), (3, prose + "call +44 20 7946 0958 now"), (4, None), (13, prose + "see page 12"), (15, "see ____ " + prose)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["sensitive"] for r in memory_queries.sensitive_screen(spark, str(tmp_path)).collect()}
    assert found == {1: False, 2: True, 3: True, 4: False, 13: False, 15: False}


def test_turns_are_compared_whole(spark, tmp_path):
    one, other = "the same opening " * 15 + "ends in one way", "the same opening " * 15 + "continues quite differently " * 9
    spark.createDataFrame([(1, 0, "user", one), (1, 1, "tutor", other)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    words = len(set(one.split()) & set(other.split())) / len(set(one.split()) | set(other.split()))
    [row] = memory_queries.semantic_similarity(spark, str(tmp_path)).collect()
    assert row["similarity"] == round(max(words, SequenceMatcher(a=one, b=other.strip()).ratio()), 6) < 1


def test_every_file_and_page_is_kept(spark, tmp_path):
    text = "a page of a lesson " * 20
    rows = [(i, "s", "en", f"{text}{i}", 400) for i in range(1, 41)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pages = {r["page"]: r["chosen_md5"] for r in ingest_queries.page_selection(spark, str(tmp_path)).collect()}
    assert pages == {i: hashlib.md5((f"reviewed {i}" if i % 10 == 0 else t).encode()).hexdigest() for i, _, _, t, _ in rows}
    assert {r["doc_id"]: r["reused"] for r in ingest_queries.incremental_reuse(spark, str(tmp_path)).collect()} == {i: i for i in range(1, 41)}
    expected = {f"unit{i % 10}/{i}.md": "deleted" if i % 11 == 0 else "edited" if i % 13 == 0 else "unchanged" for i in range(1, 41)}
    expected |= {f"moved/unit{i % 10}/{i}.md": "renamed" for i in (11, 22, 33)}
    assert {r["path"]: r["change"] for r in ingest_queries.snapshot_diff(spark, str(tmp_path)).collect()} == expected


def test_missing_files_and_sparse_pages(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, checksum string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "4")], "path string, checksum string")
    assert {r["path"]: r["change"] for r in ingest.snapshot_diff(old, new).collect()} == {"a": "unchanged", "b": "edited", "c": "deleted", "d": "renamed", "e": "added"}
    found = ingest.reuse_latest(new, old.withColumn("reused", F.col("path")), ["checksum"], [F.desc("reused")], "reused")
    assert {r["path"]: r["reused"] for r in found.collect()} == {"a": "a", "b": None, "d": "c", "e": None}
    pages = [("k", 3, 1, "short", "much more by OCR", 99999), ("k", 3, 2, "short", None, 99999), ("k", 3, 3, "short", "much more by OCR", 99), ("k", 3, 4, "w " * 60, "w " * 90, 99999)]
    chosen = ingest.choose_pages(spark.createDataFrame(pages, "checksum string, page_count int, page int, text string, ocr_text string, file_size long"))
    assert {r["page"]: (r["needs_ocr"], r["chosen"], r["confidence"]) for r in chosen.collect()} == {1: (True, "much more by OCR", 0.7), 2: (True, "short", 0.95), 3: (False, "short", 0.95), 4: (False, "w " * 60, 0.95)}


def test_every_attempt_counts(spark, tmp_path):
    line = lambda order, part, number, flag, tax: (order, part, number, flag, tax, datetime.date(2024, 1, number))
    rows = [line(4, 1, 1, "R", 0.0), line(4, 2, 2, "N", 0.0), line(5, 1, 4, "A", 0.08), line(5, 2, 5, "A", 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_tax double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["set_id"]: (r["total"], r["attempted"], r["completed"], r["correct"], r["next_exercise"], r["status"]) for r in practice_queries.set_progress(spark, str(tmp_path)).collect()}
    assert found == {4: (2, 2, 1, 1, 2, "IN_PROGRESS"), 5: (2, 2, 2, 0, None, "COMPLETED")}
    shown = {(r["set_id"], r["exercise_id"]): r["shown"] for r in practice_queries.release_policy(spark, str(tmp_path)).collect()}
    assert shown == {(4, 1): "solution", (4, 2): "hint_1", (5, 1): "solution", (5, 2): "hint_1"}
    exercises = spark.createDataFrame([(6, 1, 1), (6, 2, 2)], "set_id long, exercise_id long, ordinal long")
    [row] = practice.set_progress(exercises, practice_queries._attempts(spark, str(tmp_path))).collect()
    assert (row["attempted"], row["next_exercise"], row["mastery"], row["status"]) == (0, 1, None, "NOT_STARTED")
