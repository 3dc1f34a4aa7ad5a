"""Lifecycle queries: ``documents`` are chunks, their sources files, ``orders`` runs and ``events`` what happens to them."""

from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.functions.time import epoch_seconds
from chalkline.operators import lifecycle as L
from chalkline.sources.tables import table

_NOW = 1_706_700_000


def _chunks(spark, d):
    model = F.when(F.col("n_chars") % 4 == 0, F.lit(None)).when(F.col("n_chars") % 4 == 1, "pending").when(F.col("n_chars") % 4 == 2, "m1").otherwise("m2")
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("ordinal"), model.alias("model"))


def _sources(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))


def _members(spark, d):
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("bigint")
    return _sources(spark, d).select(F.explode(F.array(number % 3, F.lit(7).cast("long"))).alias("version_id"), "source_id", number.alias("number")).filter("number % 5 <> 4").drop("number")


def embed_feed(spark, d):
    sources = _sources(spark, d).select("source_id", F.concat("source_id", F.lit(".pdf")).alias("path"))
    return L.embed_feed(_chunks(spark, d), sources, _members(spark, d), "m2").select("version_id", "chunk_id", "path", "batch")


def version_sources(spark, d):
    return L.version_sources(_members(spark, d), _sources(spark, d), F.lit(7)).select("source_id", "n")


def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    moved = e.withColumn("chunk_id", F.col("chunk_id") * 3).withColumn("vector", F.reverse("vector"))
    return L.vector_upsert(e, moved, dim=64).select("chunk_id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


def drop_orphans(spark, d):
    vectors = _chunks(spark, d).select("chunk_id", "source_id")
    return L.drop_orphans(vectors, _members(spark, d), _sources(spark, d)).select("chunk_id")


def ingestion_stats(spark, d):
    docs = table(spark, d, "documents")
    earlier = F.when(F.col("n_chars") % 3 == 0, F.lit(None)).when(F.col("n_chars") % 3 == 1, F.md5("text")).otherwise("old")
    files = docs.select("source", F.md5("text").alias("checksum"), earlier.alias("earlier"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")).alias("reused"), F.when(F.length(F.trim("text")) > 60, "extracted").otherwise("quarantined").alias("status"), F.ceil(F.length("text") / 1000).alias("n_chunks"))
    return L.ingestion_stats(files, "source")


def _events(spark, d):
    action = F.when(F.col("event_type") == "view", "build").when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "purchase", "publish").when(F.col("event_type") == "error", "rollback").otherwise("build")
    return table(spark, d, "events").select((F.col("user_id") % 6).alias("course_id"), (F.col("user_id") % 42).alias("version_id"), action.alias("action"), epoch_seconds("ts").alias("at"), F.col("event_id").alias("seq"))


def version_states(spark, d):
    ship(spark)
    return L.version_states(_events(spark, d))


def active_versions(spark, d):
    ship(spark)
    return L.active_versions(_events(spark, d))


def publication_bindings(spark, d):
    o = table(spark, d, "orders")
    published = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 3).alias("version_id"))
    books = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("book_id"))
    existing = table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), (F.col("p_partkey") % 3).alias("version_id"), F.concat(F.lit("src"), F.col("p_size") % 20).alias("source_id"))
    return L.publication_bindings(published, books, _members(spark, d), existing)


def catalog_staging(spark, d):
    docs = table(spark, d, "documents")
    c = docs.select(F.col("source").alias("root"), F.concat("lang", F.lit("/"), "doc_id").alias("path"), F.md5("text").alias("checksum"), F.concat(F.lit("k"), "doc_id").alias("stable_key"), F.when(F.col("n_chars") % 9 == 0, "needs_review").otherwise("staged").alias("status"))
    # The scan before found other contents below most roots
    other = F.when(F.col("root").like("%1"), F.col("checksum")).otherwise(F.md5("checksum"))
    before = L.stage_catalog(c.withColumn("checksum", other), spark.createDataFrame([], "root string, snapshot string"))
    return L.stage_catalog(c, before.select("root", "snapshot")).select("root", "snapshot", "n_candidates", "needs_review", "state")


def catalog_approval(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("candidate_id"), F.when(F.col("p_size") % 3 != 0, "approved").otherwise("pending").alias("review"), F.concat("p_name", F.lit("/"), "p_brand").alias("stable_key"), F.concat(F.lit(" "), F.upper("p_brand")).alias("publisher"), F.col("p_type").alias("level"), (F.col("p_size") % 4).cast("string").alias("subject"))
    existing = p.filter("p_partkey % 5 = 0").select(F.lit("book").alias("table"), F.concat("p_name", F.lit("/"), "p_brand").alias("key")).distinct()
    return L.approval_rows(c, existing)


def due_scans(spark, d):
    k = F.col("c_custkey")
    courses = table(spark, d, "customer").select(k.alias("course_id"), (k % 300).alias("root_id"))
    roots = spark.range(300).select(F.col("id").alias("root_id"), (F.col("id") % 4 != 0).alias("automatic"), F.when(F.col("id") % 5 != 0, F.lit(_NOW) - F.col("id") * 60).alias("last_scanned"), F.lit(3600).cast("long").alias("interval"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("course_id"), (F.col("o_custkey") % 300 + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("root_id"))
    payload = F.to_json(F.struct(F.col("user_id").alias("course_id")))
    events = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "ingestion.scan").otherwise("other").alias("topic"), F.when(F.col("value") > 40, F.col("ts")).alias("processed_at"), F.when(F.col("value") < 10, F.col("ts")).alias("dead_lettered_at"), payload.alias("payload"))
    return L.due_scans(courses, roots, runs, events, _NOW)


def insert_or_compare(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("Supplier#"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("")).alias("s_name"))
    same = old.filter("k % 3 = 0").select((F.col("k")).alias("k"), "s_name")
    return L.insert_or_compare(old, new.join(same.select("k"), "k", "left_anti").unionByName(same), "k", "s_name")


def artifacts_to_put(spark, d):
    files = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"), "source")
    stored = files.filter("source LIKE '%2'").select(F.concat(F.lit("artifacts/sha256/"), F.substring("checksum", 1, 2), F.lit("/"), "checksum").alias("key")).distinct()
    return L.artifacts_to_put(files, stored)


def bulk_delete(spark, d):
    kept, removed = L.retain(table(spark, d, "events"), (F.col("value") < 20) & (F.col("event_type") != "purchase"), "event_type")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept")).join(removed, "event_type")


def backfill_column(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("segment"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return L.backfill(o, c, "o_custkey", "segment").select("o_orderkey", "segment")


_S = "s AS (SELECT source AS source_id, count(*) AS n, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS k FROM documents GROUP BY source), m AS (SELECT k % 3 AS version_id, source_id FROM s WHERE k % 5 <> 4 UNION ALL SELECT 7, source_id FROM s WHERE k % 5 <> 4)"
#: All events of a course one after the other: status and publication time of each version, and the active one.
_V = """RECURSIVE e AS (SELECT user_id % 6 AS course_id, user_id % 42 AS v, CASE event_type WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'publish' WHEN 'error' THEN 'rollback' ELSE 'build' END AS action, floor(epoch(ts))::BIGINT AS tm, row_number() OVER (PARTITION BY user_id % 6 ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
k(course_id, n, s, p, active) AS (SELECT DISTINCT course_id, 0::BIGINT, MAP([]::BIGINT[], []::VARCHAR[]), MAP([]::BIGINT[], []::BIGINT[]), NULL::BIGINT FROM e UNION ALL
SELECT course_id, n, CASE WHEN ok THEN map_concat(s, MAP([v], [CASE action WHEN 'build' THEN 'building' WHEN 'ready' THEN 'ready' WHEN 'publish' THEN 'published' ELSE 'rolled_back' END])) ELSE s END, CASE WHEN ok AND action = 'publish' THEN map_concat(p, MAP([v], [tm])) ELSE p END, CASE WHEN ok AND action = 'publish' THEN v WHEN ok AND action = 'rollback' THEN before.v ELSE active END
FROM (SELECT *, CASE action WHEN 'build' THEN coalesce(s[v], '') <> 'published' WHEN 'ready' THEN s[v] = 'building' WHEN 'publish' THEN s[v] = 'ready' ELSE active = v AND before IS NOT NULL END AS ok
FROM (SELECT e.course_id, e.n, e.v, e.action, e.tm, k.s, k.p, k.active, list_max(list_transform(list_filter(map_keys(k.s), lambda x: k.s[x] = 'published' AND x <> e.v), lambda x: {'tm': k.p[x], 'v': x})) AS before FROM k JOIN e ON e.course_id = k.course_id AND e.n = k.n + 1))),
l AS (SELECT course_id, arg_max(s, n) AS s, arg_max(p, n) AS p, arg_max(active, n) FILTER (active IS NOT NULL) AS active FROM k GROUP BY course_id)"""

QUERIES = {f.__name__: f for f in (embed_feed, version_sources, vector_upsert, drop_orphans, ingestion_stats, version_states, active_versions, publication_bindings, catalog_staging, catalog_approval, due_scans, insert_or_compare, artifacts_to_put, bulk_delete, backfill_column)}

SQL = {
    "embed_feed": f"WITH {_S} SELECT version_id, doc_id AS chunk_id, source || '.pdf' AS path, (row_number() OVER (PARTITION BY version_id, source ORDER BY doc_id) - 1) // 32 AS batch FROM documents JOIN m ON source = source_id WHERE n_chars % 4 <> 3",
    "version_sources": f"WITH {_S} SELECT source_id, n FROM s JOIN m USING (source_id) WHERE version_id = 7",
    "vector_upsert": "SELECT vec_id * 3 AS chunk_id, round(embedding[-1]::DOUBLE, 6) AS first FROM embeddings UNION ALL SELECT vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id * 3 FROM embeddings)",
    "drop_orphans": f"WITH {_S} SELECT doc_id AS chunk_id FROM documents JOIN s ON source = source_id WHERE k % 5 <> 4",
    "ingestion_stats": """WITH f AS (SELECT source, n_chars % 3 = 1 AS same, doc_id % 4 = 0 AS again, length(trim(text)) > 60 AS ok, ceil(length(text) / 1000)::BIGINT AS n FROM documents)
SELECT source, count(*) AS discovered, count_if(same)::BIGINT AS unchanged, count_if(NOT same AND again)::BIGINT AS reused, count_if(NOT same AND NOT again AND ok)::BIGINT AS processed, count_if(NOT same AND NOT again AND NOT ok)::BIGINT AS quarantined, coalesce(sum(n) FILTER (NOT same AND NOT again AND ok), 0)::BIGINT AS chunks FROM f GROUP BY source""",
    "version_states": f"WITH {_V} SELECT course_id, v AS version_id, s[v] AS status, p[v] AS published_at FROM (SELECT *, unnest(map_keys(s)) AS v FROM l)",
    "active_versions": f"WITH {_V} SELECT course_id, active, list_max(list_transform(list_filter(map_keys(s), lambda x: s[x] = 'published' AND x <> active), lambda x: {{'tm': p[x], 'v': x}})).v AS previous FROM l WHERE active IS NOT NULL",
    "publication_bindings": f"""WITH {_S} SELECT DISTINCT l_partkey AS book_id, version_id, source_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN m ON version_id = o_custkey % 3
WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 3 = version_id AND 'src' || (p_size % 20) = source_id)""",
    "catalog_staging": """WITH f AS (SELECT source AS root, lang || '/' || doc_id AS path, md5(text) || chr(0) || 'k' || doc_id AS checksum, n_chars FROM documents),
b AS (SELECT root, left(sha256(path), 3) AS bucket, sha256(string_agg(path || chr(0) || checksum || chr(10), '' ORDER BY path)) AS digest, count(*) AS n, count_if(n_chars % 9 = 0) AS r FROM f GROUP BY ALL)
SELECT root, sha256(string_agg(digest, '' ORDER BY bucket)) AS snapshot, sum(n)::BIGINT AS n_candidates, sum(r)::BIGINT AS needs_review, CASE WHEN root LIKE '%1' THEN 'reused' ELSE 'new' END AS state FROM b GROUP BY root""",
    "catalog_approval": """WITH c AS (SELECT p_partkey AS id, p_name || '/' || p_brand AS k, lower(p_brand) AS pub, p_type || '/' || (p_size % 4) AS prog FROM part WHERE p_size % 3 <> 0),
r AS (SELECT 'publisher' AS t, pub AS key, id FROM c UNION ALL SELECT 'programme', prog, id FROM c UNION ALL SELECT 'book', k, id FROM c WHERE k NOT IN (SELECT p_name || '/' || p_brand FROM part WHERE p_partkey % 5 = 0)
UNION ALL SELECT u.t, u.p || ':' || k, id FROM c, (VALUES ('source_root', 'root'), ('course', 'course'), ('course_run', 'run'), ('book_course_binding', 'binding'), ('outbox_event', 'ingest')) u(t, p)) SELECT t AS "table", key, min(id) AS candidate_id FROM r GROUP BY ALL""",
    "due_scans": f"""SELECT c_custkey AS course_id, o_orderkey AS run_id, 'scan:' || c_custkey || ':scheduled:' || ({_NOW} // 3600) AS idempotency_key FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 <> 0
WHERE c_custkey % 300 % 4 <> 0 AND (c_custkey % 300 % 5 = 0 OR c_custkey % 300 * 60 >= 3600) AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value <= 40 AND value >= 10)""",
    "insert_or_compare": "SELECT c_custkey AS k, CASE WHEN s_suppkey IS NULL THEN 'inserted' WHEN s_suppkey % 3 = 0 THEN 'unchanged' ELSE 'conflict' END AS outcome FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "artifacts_to_put": "WITH f AS (SELECT sha256(coalesce(text, '')) AS c, source FROM documents) SELECT DISTINCT 'artifacts/sha256/' || left(c, 2) || '/' || c AS key FROM f WHERE c NOT IN (SELECT c FROM f WHERE source LIKE '%2')",
    "bulk_delete": "SELECT event_type, count(*) FILTER (NOT (value < 20 AND event_type <> 'purchase')) AS kept, count_if(value < 20 AND event_type <> 'purchase')::BIGINT AS removed FROM events GROUP BY event_type",
    "backfill_column": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE c_mktsegment END AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
}
