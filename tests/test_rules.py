"""Rules on odd values: trailers, exact quantiles, Unicode forms, page bins, folds, files, parsers and artifacts."""

import hashlib
import io
import json
import math
import os
import random
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.operators import access, evaluation, evidence, lifecycle, memory, objectives, outline, practice, validation
from chalkline.plans import files as file_queries
from chalkline.sources import artifacts, folders, office, parsers

ODD = ["Ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne ﬂow", "Straße STRASSE", "  plain\ttext\n here ", "İstanbul", "é", "a b", "x\x1fy", "", None, "①②", "Ωμέγα", "zero​width �\x00\x07", "nul\x00", "form\x0cfeed\rreturn"]


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_unicode_forms(spark):
    folded = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in ODD]
    assert values(spark, X.nfkc_casefold(F.col("t")), ODD * 3) == folded * 3
    clean = [None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).replace("�", " ") if c in "\n\t" or unicodedata.category(c)[0] != "C") for t in ODD]
    assert values(spark, X.clean_unicode("t"), ODD) == clean
    lists = spark.createDataFrame([(0, ["ＡＢ", None, "x"]), (1, []), (2, None), (3, ["Plain", "two  words"])], "i int, a array<string>")
    assert [r["v"] for r in lists.select("i", X.nfkc_casefold_all(F.col("a")).alias("v")).orderBy("i").collect()] == [["ab", None, "x"], [], None, ["plain", "two words"]]


def test_rules_use_the_compatibility_form(spark):
    assert values(spark, validation.question_fingerprint(F.col("t")), ["Ｗｈａｔ  is ﬁne?", "STRAßE"]) == ["what is fine?", "strasse"]
    graded = practice.grade(F.lit("fill_blank"), F.col("t"), F.lit(None), F.array(F.lit("Straße"), F.lit("ﬁve")))
    assert values(spark, graded, ["STRASSE", " ｆｉｖｅ ", "six"]) == [True, True, False]
    assert values(spark, F.array_sort(objectives.tokens(F.col("t"))), ["Ｃｏｕｎｔ the ﬁsh 认识数字"]) == [["count", "fish", "数字", "认识", "识数"]]
    assert values(spark, objectives.skill(F.col("t")), ["ｃｏｕｎｔｉｎｇ ｎｕｍｂｅｒｓ"]) == ["number_sequence"]
    assert values(spark, evidence.whole_answer_key(F.col("t")), ["Ｇｏｏｄ Ｍｏｒｎｉｎｇ"]) == [hashlib.sha256(b"goodmorning").hexdigest()]
    pairs = spark.createDataFrame([("ask for your name", "request the name"), ("one two three four", "four three two one"), ("a b", "a b")], "a string, b string")
    assert [r["v"] for r in pairs.select(objectives.near_duplicate(F.col("a"), F.col("b")).alias("v")).collect()] == [True, True, False]


def test_titles_are_in_compatibility_form(spark):
    assert values(spark, outline.clean_title(F.col("t")), ["Ｕｎｉｔ３  ﬁne", "module 12b", None]) == ["Unit 3 fine", "module 12b", None]


def test_leaders_without_a_title_are_no_line_of_contents(spark):
    lines = [" ……… 88", "……… 88", "···· 9", "one ……… 88", "1 … ……… 88", "Unit 3  ..... 7", None]
    assert values(spark, outline.line_kind(F.col("t")), lines) == ["text", "text", "text", "toc", "toc", "toc", "text"]


def test_records_leave_out_leaders_without_a_title(spark):
    lines = spark.createDataFrame([(1, 1, 1, "Module  2"), (1, 1, 2, "Unit 3 one ..... 7"), (1, 1, 3, " ……… 8"), (1, 1, 4, "Unit 4 two ..... 9")], "book long, page int, n int, line string")
    books = spark.createDataFrame([(1, 120, 0)], "book long, n_pages int, page_offset int")
    found = outline.text_records(lines, books).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["title"], r["page"], r["depth"]) for r in found] == [(0, "Module 2", 7, 0), (1, "Unit 3 one", 7, 1), (2, "Unit 4 two", 9, 1)]


def test_few_query_terms_go_to_the_documents(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = spark.createDataFrame([(d, t, 1 + d % 2) for d in range(40) for t in ("the", f"w{d % 5}")], "doc_id long, token string, tf long")
        queries = spark.createDataFrame([(1, "the"), (1, "w3"), (2, "w4")], "qid long, token string")
        few = evaluation.tfidf_scores(queries, terms, F.lit(40), 3)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().toString()
        monkeypatch.setattr(evaluation, "SMALL_ROWS", 1)
        many = evaluation.tfidf_scores(queries, terms, F.lit(40), 3)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().toString()
        assert sorted(few.collect()) == sorted(many.collect()) and len(few.collect()) == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bindings_of_a_publication_meet_once(spark):
    published = spark.createDataFrame([(r, 1) for r in range(50)], "run_id long, version_id long")
    books = spark.createDataFrame([(r, b) for r in range(50) for b in (1, 2)], "run_id long, book_id long")
    members = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "version_id long, source_id string")
    existing = spark.createDataFrame([(2, 1, "b")], "book_id long, version_id long, source_id string")
    found = lifecycle.publication_bindings(published, books, members, existing)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a"), (1, 1, "b"), (2, 1, "a")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is made distinct after the pairs are made


def test_trailers_are_decoded(spark):
    def read(tail):
        (row,) = access.split_trailer(spark.createDataFrame([("Seen. CITATIONS:" + tail,)], "text string")).collect()
        return row.visible, [(c.source, c.chunk_id) for c in row.claims]

    one = {"source": 1, "chunk_id": "a]b"}
    assert read(" " + json.dumps([one, {"source": 2, "chunk_id": "c", "more": [[1], {"x": "]"}]}]) + " and so on ]") == ("Seen. ", [(1, "a]b"), (2, "c")])
    assert read(json.dumps([{"source": True, "chunk_id": "x"}, {"source": "1", "chunk_id": "x"}, {"source": 1.5, "chunk_id": "x"}, 7, "s", None, [1], one])) == ("Seen. ", [(1, "a]b")])
    assert read(" nothing")[1] == read(" [broken")[1] == read("")[1] == read(' {"source": 1}')[1] == []
    assert access.split_trailer(spark.createDataFrame([("no marker",)], "text string")).first().claims == []


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    monkeypatch.setattr(evaluation, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 9), float(rng.randint(0, 3))])) for _ in range(4000)] + [("one", 5.0), ("none", None)]
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    found = {(r.k, r.share): r.percentile for r in evaluation.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares).collect()}
    held = {k: sorted(v for x, v in rows if x == k and v is not None) for k in {k for k, _ in rows}}
    assert found == {(k, s): v[max(1, math.ceil(len(v) * s - 1e-9)) - 1] for k, v in held.items() if v for s in shares}
    assert evaluation.nearest_ranks(spark.createDataFrame([], "k string, v double"), "k", "v", [0.5]).count() == 0


def test_pages_meet_nodes_by_bins(spark):
    rng = random.Random(8)
    nodes = [(b, i, s, s + rng.choice([-1, 0, 3, 40])) for b in range(3) for i in range(60) for s in [rng.randint(-2, 90)]]
    chunks = [(c, rng.randint(0, 3), rng.choice([None, *range(1, 120)])) for c in range(200)]
    found = outline.pages_in_nodes(spark.createDataFrame(chunks, "cid int, book int, page int"), spark.createDataFrame(nodes, "book int, ordinal int, page_start int, page_end int")).collect()
    expected = sorted((c, i) for c, b, p in chunks for k, i, s, e in nodes if b == k and p is not None and s >= 1 and s <= p <= e)
    assert sorted((r.cid, r.ordinal) for r in found) == expected


def test_recall_skips_what_does_not_fit(spark):
    facts = [("k", i, i, t) for i, t in enumerate([100, 200, 90, None, 40, 10, 1, 1, 1, 1, 1])] + [(None, 1, 1, 5), ("l", 2, 1, 9999)]
    found = memory.bounded_recall(spark.createDataFrame(facts, "k string, fact_id int, rank int, tokens int"), "k", ["rank"]).collect()
    assert sorted((r.k or "", r.place, r.fact_id) for r in found) == [("", 0, 1), *(("k", n, i) for n, i in enumerate([0, 1, 3, 4, 5]))]


def test_repeated_keys_have_one_outcome(spark):
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (2, "x"), (3, "new")], "k int, body string")
    old = spark.createDataFrame([(1, "a"), (2, "x")], "k int, body string")
    assert {tuple(r) for r in lifecycle.insert_or_compare(old, new, "k", "body").collect()} == {(1, "conflict"), (2, "unchanged"), (3, "inserted")}
    rows = spark.createDataFrame([(1, None), (2, "kept")], "k int, body string")
    assert {tuple(r) for r in lifecycle.backfill(rows, new, "k", "body").select("k", "body").collect()} == {(1, "a"), (2, "kept")}
    vectors = spark.createDataFrame([(1, [0.0]), (9, [9.0])], "chunk_id int, vector array<double>")
    more = spark.createDataFrame([(1, [2.0]), (1, [1.0])], "chunk_id int, vector array<double>")
    assert {(r.chunk_id, r.vector[0]) for r in lifecycle.vector_upsert(vectors, more).collect()} == {(1, 1.0), (9, 9.0)}


def tree(root):
    for name, content in {"a.md": b"# A", "b/notes": "tëxt".encode(), "b/c/x.pdf": b"%PDF-1", "b/c/sure": b"%PDFxyz\xff", "b/c/odd": b"\xff\xfe", "b/cut": "é".encode()[:1], ".git/x.md": b"no", "b/.hid.md": b"no", "__MACOSX/y.md": b"no", "b/Thumbs.db": b"no", "b/quo'te, x.txt": b""}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (root / "link.md").symlink_to(root / "a.md")
    (root / "folder-link").symlink_to(root / "b")


def test_folders_are_scanned(spark, tmp_path):
    tree(tmp_path)
    found = {r.relative_path: (r.size_bytes, r.checksum, r.mime) for r in folders.scan_folder(spark, str(tmp_path), part_files=2).collect()}
    assert set(found) == {"a.md", "b/notes", "b/c/x.pdf", "b/c/sure", "b/c/odd", "b/cut", "b/quo'te, x.txt"}
    assert all((n, c) == ((tmp_path / p).stat().st_size, hashlib.sha256((tmp_path / p).read_bytes()).hexdigest()) for p, (n, c, _) in found.items())
    assert {p: m.split("/")[1] for p, (_, _, m) in found.items()} == {"a.md": "markdown", "b/notes": "plain", "b/c/x.pdf": "pdf", "b/c/sure": "pdf", "b/c/odd": "octet-stream", "b/cut": "octet-stream", "b/quo'te, x.txt": "plain"}
    assert {r.relative_path for r in folders.scan_folder(spark, str(tmp_path), ["a.md", "b/c/x.pdf", "b/none"]).collect()} == {"a.md", "b/c/x.pdf"}
    for bad in ("/etc/passwd", "b/../../x", "..\\x"):
        with pytest.raises(ValueError, match="below the root"):
            folders.scan_folder(spark, str(tmp_path), [bad])
    (tmp_path / "empty").mkdir()
    assert folders.scan_folder(spark, str(tmp_path / "empty")).count() == 0


def test_conditions_prune_the_walk(tmp_path):
    tree(tmp_path)
    reader = folders._Reader(str(tmp_path), 10)
    rest = list(reader.pushFilters([folders.StringStartsWith(("relative_path",), "b/c/"), folders.EqualTo(("mime",), "x")]))
    assert len(rest) == 1 and [(p.folder, p.names) for p in reader.partitions()] == [("b/c/", ("odd", "sure", "x.pdf"))]
    (tmp_path / "b/c/gone").write_text("x")
    part = reader.partitions()[0]
    (tmp_path / "b/c/gone").unlink()
    assert [r[4] for r in reader.read(part) if r[0] == "b/c/gone"] == ["FileNotFoundError: No such file or directory"]


def test_large_files_are_read_in_blocks(tmp_path):
    import resource

    with open(tmp_path / "large", "wb") as out:
        out.truncate(3 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    size, _, mime = folders.digest_and_type(str(tmp_path / "large"))
    assert (size, mime) == (3 << 30, "text/plain") and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10
    os.unlink(tmp_path / "large")


def test_parsers_give_a_row_whatever_happens(spark, monkeypatch):
    docx, md = parsers.MIME_BY_EXTENSION["docx"], parsers.MIME_BY_EXTENSION["md"]
    made = [(0, md, "# Head\n\n body \n".encode()), (1, md, b"\xff"), (2, "text/plain", b" a\n\xff\n"), (3, docx, file_queries._as_docx("Title\n\nbody")), (4, docx, b"zip?"), (5, "x/y", b"."), (6, None, b"."), (7, md, None), (8, md, b" \n"), (9, parsers.MIME_BY_EXTENSION["pptx"], file_queries._as_docx("x"))]
    rows = parsers.parse_files(spark.createDataFrame([(i, m, None if c is None else bytearray(c)) for i, m, c in made], "i int, mime string, content binary"))
    found = sorted((r.i, -1 if r.ordinal is None else r.ordinal, r.line, r.anchor_type, r.anchor_value, r.status) for r in rows.collect())
    assert found == [(0, 0, "Head", "heading", "1", "extracted"), (0, 1, "body", "line_range", "3", "extracted"), (1, -1, None, None, None, "failed"), (2, 0, " a", "line_range", "1", "extracted"), (2, 1, "�", "line_range", "2", "extracted"), (3, 0, "Title", "heading", "1", "extracted"), (3, 1, "body", "line_range", "3", "extracted"), (4, -1, None, None, None, "failed"), (5, -1, None, None, None, "quarantined"), (6, -1, None, None, None, "quarantined"), (7, -1, None, None, None, "failed"), (8, -1, None, None, None, "quarantined"), (9, -1, None, None, None, "failed")]
    status = {r.i: (r.status, r.fragments) for r in parsers.file_status(rows, "i").collect()}
    assert status[0] == ("extracted", 2) and status[4] == ("failed", 0)
    parsers.register(spark)
    assert spark.sql("SELECT line FROM VALUES ('text/markdown', CAST('# x' AS BINARY)) AS f(m, c), LATERAL parse_file(m, c)").first().line == "x"
    monkeypatch.setattr(office, "PART_BYTES", 10)  # a part that is too large fails its file with a reason
    ((*_, status, reason),) = parsers.outcomes(docx, file_queries._as_docx("long enough"))
    assert status == "failed" and "more than 10" in reason


def test_entities_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE d [<!ENTITY a "b">]><d/>')
    ((*_, status, reason),) = parsers.outcomes(parsers.MIME_BY_EXTENSION["docx"], out.getvalue())
    assert status == "failed" and "entities" in reason


def contents(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_artifacts_are_put_once(spark, tmp_path):
    root = tmp_path / "store"
    root.mkdir()
    rows = spark.createDataFrame([(bytearray(x),) for x in (b"one", b"two", b"one", b"")] + [(None,)], "content binary").repartition(4)
    artifacts.put_artifacts(rows, str(root), "manifest")
    first = contents(root)
    assert {first[artifacts.artifact_key(hashlib.sha256(x).hexdigest())] for x in (b"one", b"two", b"")} == {b"one", b"two", b""} and len(first) == 4
    assert [json.loads(x)["size"] for x in sorted(first["manifest"].decode().splitlines())] and oct((root / "manifest").stat().st_mode)[-3:] == "600"
    artifacts.put_artifacts(rows.repartition(2), str(root), "manifest")
    assert contents(root) == first
    other = spark.createDataFrame([(bytearray(b"three"),)], "content binary")
    with pytest.raises(Exception, match="another manifest"):
        artifacts.put_artifacts(other, str(root), "manifest")
    assert contents(root) == first
    with pytest.raises(ValueError):
        artifacts.artifact_key("../x")


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    root = tmp_path / "store"
    root.mkdir()
    rows = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        artifacts.put_artifacts(rows, str(root), "manifest")
    assert contents(root) == {} and os.listdir(root) == []
    artifacts.put_artifacts(spark.range(5).select(F.col("id").cast("string").cast("binary").alias("content")), str(root), "manifest")
    assert len(contents(root)) == 6
