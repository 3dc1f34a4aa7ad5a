"""Ingestion queries: ``documents`` are source files, ``source`` is the course, doc_id the path."""

from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.functions import text as X
from chalkline.operators import ingest as I
from chalkline.sources.tables import table


def _files(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("unit"), F.col("doc_id") % 10, F.lit("/"), F.col("doc_id"), F.lit(".md"))
    return docs.select("doc_id", "source", "lang", "text", path.alias("path"), F.sha2("text", 256).alias("checksum"))


def fragment_lines(spark, d):
    rows = I.fragments(_files(spark, d))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("line").alias("line_md5"), "anchor_type")


def token_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.approximate_tokens(F.col("text")).alias("approximate"), X.token_estimate(F.col("text")).alias("estimate"))


def coalesce_chunks(spark, d):
    ship(spark)
    pieces = I.line_pieces(F.col("text"), lambda line: F.when(line.contains("?"), "exercise_question").otherwise("content"))
    found = I.coalesce_chunks(table(spark, d, "documents").select("doc_id", pieces.alias("pieces")))
    return found.select("doc_id", "chunk", F.md5("text").alias("text_md5"), "anchor_value", "chunk_class", "token_count")


def snapshot_hash(spark, d):
    return I.snapshot_hash(_files(spark, d), ["source"]).select("source", "snapshot", "n_files")


def snapshot_diff(spark, d):
    files = _files(spark, d).select("path", "checksum", "doc_id")
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    edited = F.when(F.col("doc_id") % 13 == 0, F.sha2(F.col("path"), 256)).otherwise(F.col("checksum"))
    new = files.select(moved.alias("path"), edited.alias("checksum"))
    return I.snapshot_diff(files, new)


def incremental_reuse(spark, d):
    files = _files(spark, d)
    earlier = files.select("source", "checksum", F.col("doc_id").alias("reused"))
    found = I.reuse_latest(files.select("doc_id", "source", "checksum"), earlier, ["source", "checksum"], [F.desc("reused")], "reused")
    return found.select("doc_id", "reused")


def next_version_sequence(spark, d):
    versions = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 9 + 1).alias("sequence"))
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return I.next_sequence(versions, runs, "o_custkey")


def parser_dispatch(spark, d):
    files = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "application/pdf").otherwise("text/html").alias("mime"), F.when(F.col("page_id") % 9 != 0, F.col("html")).alias("text"))
    return I.dispatch(files).select("page_id", "status")


def mime_sniff(spark, d):
    k = F.col("page_id") % 5
    path = F.concat(F.lit("a.b/file"), "page_id", F.when(k == 0, ".PDF").when(k == 1, ".md").when(k == 2, ".docx").otherwise(""))
    content = F.encode(F.concat(F.when(k == 3, "%PDF-1.7 ").otherwise(""), "html"), "utf-8")
    return table(spark, d, "pages").select("page_id", I.sniff_mime(path, content).alias("mime"))


def fake_embeddings(spark, d):
    v = X.fake_embedding(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, 16), 6).alias("last"), F.round(X.dot(v, v), 6).alias("norm"))


def page_fragments(spark, d):
    return I.page_fragments(_pages(spark, d)).select("page", F.col("ordinal").cast("long").alias("ordinal"), F.md5("line").alias("line_md5"), "anchor_type", "anchor_value", "confidence")


def page_selection(spark, d):
    return _pages(spark, d).select("page", "needs_ocr", F.md5("chosen").alias("chosen_md5"), "confidence")


def _pages(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.md5("source").alias("checksum"), F.lit(3).alias("page_count"), F.col("doc_id").alias("page"), "text", F.when(F.col("doc_id") % 4 == 0, F.col("text")).alias("ocr_text"), (F.col("n_chars") * 20).alias("file_size"))
    overrides = pages.filter("page % 10 = 0").select("checksum", "page_count", "page", F.concat(F.lit("reviewed "), F.col("page")).alias("text"))
    return I.choose_pages(pages, overrides)


def mode_page_offset(spark, d):
    pairs = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 6).alias("offset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return I.mode_offset(pairs, "l_suppkey")


def artifact_keys(spark, d):
    files = _files(spark, d)
    return files.select("doc_id", I.artifact_key(F.col("checksum")).alias("artifact"), I.outline_id(F.col("source"), F.col("path")).alias("outline_id"))


_F = "f AS (SELECT doc_id, source, lang, text, 'unit' || (doc_id % 10) || '/' || doc_id || '.md' AS path, sha256(text) AS checksum FROM documents)"

QUERIES = {f.__name__: f for f in (fragment_lines, token_counts, coalesce_chunks, snapshot_hash, snapshot_diff, incremental_reuse, next_version_sequence, parser_dispatch, mime_sniff, fake_embeddings, page_fragments, page_selection, mode_page_offset, artifact_keys)}

SQL = {
    "fragment_lines": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ordinal FROM l)
SELECT doc_id, ordinal, md5(line) AS line_md5, CASE WHEN regexp_matches(line, '^#{1,6}\\s+.+$') THEN 'heading' ELSE 'line_range' END AS anchor_type FROM x WHERE trim(line) <> ''""",
    "token_counts": "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+|[^\\s\\p{L}\\p{N}_\\p{M}]'))::BIGINT AS approximate, ceil(length(text) / 4)::BIGINT AS estimate FROM documents",
    "coalesce_chunks": """WITH RECURSIVE l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, CASE WHEN contains(raw, '?') THEN 'exercise_question' ELSE 'content' END AS class,
  CASE WHEN regexp_matches(raw, '^#{1,6}\\s+.+$') THEN trim(regexp_extract(raw, '^(#{1,6})\\s+(.+)$', 2)) ELSE n::VARCHAR END AS anchor, regexp_matches(raw, '^#{1,6}\\s+.+$') AS heading FROM l WHERE trim(raw) <> ''),
s AS (SELECT *, coalesce(lag(class) OVER w <> class OR lag(heading) OVER w <> heading, true) AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, 0::BIGINT AS chunk, class, line AS text, [anchor] AS seen FROM s WHERE i = 1
UNION ALL SELECT s.doc_id, s.i, CASE WHEN starts OR length(r.text) + 1 + length(line) > 1000 THEN chunk + 1 ELSE chunk END, s.class,
  CASE WHEN starts THEN line WHEN length(r.text) + 1 + length(line) > 1000 THEN right(trim(r.text), 200) || ' ' || line ELSE r.text || ' ' || line END,
  CASE WHEN starts THEN [anchor] WHEN length(r.text) + 1 + length(line) > 1000 THEN list_append([CASE WHEN len(seen) = 1 THEN seen[1] ELSE left(seen[1] || '-' || seen[-1], 120) END], anchor) WHEN list_contains(seen, anchor) THEN seen ELSE list_append(seen, anchor) END
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
e AS (SELECT doc_id, chunk, max_by(class, i) AS class, trim(max_by(text, i)) AS text, max_by(seen, i) AS seen FROM r GROUP BY ALL)
SELECT doc_id, chunk, md5(text) AS text_md5, CASE WHEN len(seen) = 1 THEN seen[1] ELSE left(seen[1] || '-' || seen[-1], 120) END AS anchor_value, class AS chunk_class, len(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+|[^\\s\\p{L}\\p{N}_\\p{M}]'))::BIGINT AS token_count FROM e""",
    "snapshot_hash": f"""WITH {_F}, b AS (SELECT source, left(sha256(path), 3) AS bucket, sha256(string_agg(path || chr(0) || checksum || chr(10), '' ORDER BY path)) AS digest, count(*) AS n FROM f GROUP BY ALL)
SELECT source, sha256(string_agg(digest, '' ORDER BY bucket)) AS snapshot, sum(n)::BIGINT AS n_files FROM b GROUP BY source""",
    "snapshot_diff": f"""WITH {_F}, o AS (SELECT path, checksum AS c0 FROM f),
n AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 13 = 0 THEN sha256(path) ELSE checksum END AS c1 FROM f),
b AS (SELECT path, c0, c1 FROM o FULL JOIN n USING (path)), g AS (SELECT DISTINCT c0 AS c1, true AS moved FROM b WHERE b.c1 IS NULL)
SELECT path, CASE WHEN b.c1 IS NULL THEN 'deleted' WHEN c0 IS NULL AND moved THEN 'renamed' WHEN c0 IS NULL THEN 'added' WHEN c0 = b.c1 THEN 'unchanged' ELSE 'edited' END AS change FROM b LEFT JOIN g ON b.c1 = g.c1""",
    "incremental_reuse": f"WITH {_F}, e AS (SELECT source, checksum, max(doc_id) AS reused FROM f GROUP BY ALL) SELECT f.doc_id, e.reused FROM f LEFT JOIN e USING (source, checksum)",
    "next_version_sequence": "SELECT c_custkey AS o_custkey, (coalesce(max(o_orderkey % 9 + 1), 0) + 1)::BIGINT AS next_sequence FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "parser_dispatch": "SELECT page_id, CASE WHEN page_id % 9 = 0 OR html IS NULL THEN 'failed' WHEN page_id % 4 = 0 OR trim(html) = '' THEN 'quarantined' ELSE 'extracted' END AS status FROM pages",
    "mime_sniff": "SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 4 THEN 'text/plain' ELSE 'application/pdf' END AS mime FROM pages",
    "fake_embeddings": """WITH h AS (SELECT item_id, sha256(text) AS h FROM benchmark), r AS (SELECT item_id, list_transform(range(16), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::INT / 255.0::DOUBLE * 2 - 1) AS v FROM h), n AS (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM r)
SELECT item_id, round(v[1] / n, 6) AS first, round(v[16] / n, 6) AS last, 1.0::DOUBLE AS norm FROM n""",
    "page_fragments": """WITH p AS (SELECT doc_id AS page, text AS t, CASE WHEN doc_id % 4 = 0 THEN text END AS o, n_chars * 20 AS size FROM documents),
q AS (SELECT page, length(trim(t)) < 80 AND size > 3 * 10240 AND length(trim(coalesce(o, ''))) > length(trim(t)) AND page % 10 <> 0 AS ocr, CASE WHEN page % 10 = 0 THEN 'reviewed ' || page ELSE t END AS c FROM p),
l AS (SELECT page, ocr, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS ordinal FROM q) SELECT page, ordinal, md5(line) AS line_md5, 'page' AS anchor_type, page::VARCHAR AS anchor_value, CASE WHEN ocr THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM l WHERE trim(line) <> ''""",
    "page_selection": """WITH p AS (SELECT doc_id AS page, text AS t, CASE WHEN doc_id % 4 = 0 THEN text END AS o, n_chars * 20 AS size FROM documents),
q AS (SELECT *, length(trim(t)) < 80 AND size > 3 * 10240 AS needs_ocr, length(trim(coalesce(o, ''))) > length(trim(t)) AS more FROM p)
SELECT page, needs_ocr, md5(CASE WHEN page % 10 = 0 THEN 'reviewed ' || page WHEN needs_ocr AND more THEN o ELSE t END) AS chosen_md5,
CASE WHEN needs_ocr AND more AND page % 10 <> 0 THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM q""",
    "mode_page_offset": """WITH c AS (SELECT l_suppkey, l_partkey % 6 AS o, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT l_suppkey, o AS offset, n AS support FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) = 1""",
    "artifact_keys": f"WITH {_F} SELECT doc_id, 'artifacts/sha256/' || left(checksum, 2) || '/' || checksum AS artifact, 'ol_' || left(sha256(source || '|' || path), 24) AS outline_id FROM f",
}
