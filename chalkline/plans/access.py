"""Access queries. Chunks are ``embeddings``, callers ``customer`` rows, courses ``part`` and runs ``orders`` and ``lineitem``."""

from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.operators import access as A
from chalkline.operators import retrieval as R
from chalkline.plans import retrieval
from chalkline.sources.tables import table

_LABELS = ["public", "enrolled", "staff_only", "restricted", "legacy"]
_CLASSES = ["content", "exercise_question", "exercise_solution", "assessment"]


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _chunks(spark, d):
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("cid"), F.col("embedding").alias("cvec"), (v % 2).alias("tenant_id"), (v % 3).alias("course_id"), (v % 4).alias("version_id"), (v % 20).alias("source_id"),
        _pick(_LABELS, F.floor(v / 2)).alias("access_label"), _pick(_CLASSES, F.floor(v / 3)).alias("chunk_class"), F.when(v % 5 != 0, "page").otherwise("slide").alias("anchor_type"),
        F.when(v % 7 != 0, (v * 7 % 120 + 1).cast("string")).otherwise("cover").alias("anchor_value"), F.array(F.concat(F.lit("unit:"), v % 6), F.concat(F.lit("week:"), v % 4)).alias("scopes"),
    )


def _allowed(chunks):
    return A.payload_filter(chunks, F.lit(1), F.lit(1), rank=2, sources=[1, 5, 7, 11, 13, 17, 19], scopes=("unit:1", "week:3"), pages=(1, 90), classes=("content", "exercise_question"))


def _filtered(spark, d):
    return _allowed(_chunks(spark, d))


def payload_filter(spark, d):
    return _filtered(spark, d).select("cid", "access_label", "chunk_class", A.page_number(F.col("anchor_type"), F.col("anchor_value")).alias("page"))


def version_filter(spark, d):
    return A.payload_filter(_chunks(spark, d), F.lit(0), F.lit(2), rank=1, version=F.lit(2)).select("cid", "access_label")


def scoped_topk(spark, d):
    ship(spark)
    return R.dense_topk(retrieval._queries(spark, d), _filtered(spark, d), 5)


def vector_index_scoped(spark, d):
    """As ``scoped_topk``, by the index, whose scan has the payload's filters."""
    index, probes = retrieval._index(spark, _chunks(spark, d))
    return index.search(retrieval._queries(spark, d).drop("qrank"), 5, probes, exact=True, where=_allowed)


def indexed_count(spark, d):
    return A.payload_filter(_chunks(spark, d), F.lit(1), F.lit(1), rank=1, version=F.lit(3)).agg(F.count(F.lit(1)).alias("total_indexed"))


def _labelled(spark, d):
    return retrieval._top(spark, d).join(_chunks(spark, d).select("cid", "access_label", "chunk_class"), "cid")


def access_recheck(spark, d):
    return A.recheck(_labelled(spark, d), (F.col("qid") / 20 % 4).cast("int")).select("qid", "cid", "access_label")


def withheld_solutions(spark, d):
    evidence = _labelled(spark, d).withColumnRenamed("recall_rank", "citation")
    found = A.withhold_solutions(evidence, F.col("qid") % 40 == 0, F.col("qid") / 40 % 5, 3)
    return found.select("qid", "citation", "cid", "chunk_class")


def rescored_cut(spark, d):
    rescored = R.rescore(retrieval._described(retrieval._top(spark, d), spark, d))
    return R.best(rescored, 4).select("qid", "cid", "place", "rescored")


def course_authorised(spark, d):
    return A.authorised(_principals(spark, d), _runs(spark, d))


def _principals(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("principal"), (k % 5).alias("tenant_id"), _pick(["learner", "instructor", "admin", "learner"], k).alias("role"), F.array(k % 30, k % 17 + 30).alias("courses"))


def _runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select((k % 45).alias("course_id"), (k % 45 % 5).alias("tenant_id"), F.when((k % 45 % 7 == 0) & (F.col("o_orderpriority") == "1-URGENT"), "tenant_authenticated").otherwise("enrolled_only").alias("access_policy"))


def course_previews(spark, d):
    return A.previews(_principals(spark, d), _runs(spark, d))


def citation_trailer(spark, d):
    answers = _answers(spark, d)
    split = A.split_trailer(answers)
    return split.select("qid", F.md5("visible").alias("visible_md5"), F.size("claims").cast("long").alias("n_claims"))


def _answers(spark, d):
    claim = F.concat(F.lit('{"source": '), (F.col("recall_rank") % 4).cast("string"), F.lit(', "chunk_id": "'), F.col("cid").cast("string"), F.lit('"}'))
    lists = retrieval._top(spark, d).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("recall_rank", claim.alias("c")))), lambda x: x["c"]), ", ").alias("list"))
    bench = table(spark, d, "benchmark").select((F.col("item_id") * 20).alias("qid"), "text")
    tail = F.when(F.col("qid") % 60 == 0, "").when(F.col("qid") % 80 == 0, "CITATIONS: not a list").otherwise(F.concat(F.lit("\nCITATIONS: ["), "list", F.lit("] done")))
    return lists.join(bench, "qid").select("qid", F.concat("text", tail).alias("text"))


def citations_read(spark, d):
    evidence = retrieval._top(spark, d).filter("recall_rank <= 3").select("qid", F.col("recall_rank").alias("citation"), "cid")
    return A.cited(A.split_trailer(_answers(spark, d)), evidence)


def practice_sources(spark, d):
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    runs = table(spark, d, "orders").select(k.alias("run_id"), (k % 6).alias("active_version"), (k % 50).alias("course_id"), F.when(F.col("o_orderstatus") != "P", "tenant_authenticated").otherwise("enrolled_only").alias("access_policy"))
    versions = table(spark, d, "orders").select((k % 6).alias("version_id"), k.alias("run_id"), (k % 50).alias("course_id"), F.when(F.col("o_custkey") % 3 != 0, "published").otherwise("ready").alias("status"))
    courses = spark.range(50).select(F.col("id").alias("course_id"), (F.col("id") % 4).alias("tenant_id"), (F.col("id") % 6).alias("active_version"))
    books = table(spark, d, "part").select(p.alias("book_id"), (p % 4).alias("tenant_id"), F.when(F.col("p_size") % 4 != 0, "published").otherwise("draft").alias("lifecycle"))
    bindings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") % 6).alias("version_id"), F.col("l_suppkey").alias("source_id"))
    return A.practice_sources(bindings, books, runs, courses, versions)


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_C = f"""c AS (SELECT vec_id AS cid, vec_id % 2 AS tenant_id, vec_id % 3 AS course_id, vec_id % 4 AS version_id, vec_id % 20 AS source_id, {_LIST(_LABELS)}[(vec_id // 2) % 5 + 1] AS access_label, {_LIST(_CLASSES)}[(vec_id // 3) % 4 + 1] AS chunk_class,
  CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 THEN (vec_id * 7 % 120 + 1)::INT END AS page, vec_id % 6 AS unit, vec_id % 4 AS week FROM embeddings)"""
_F = f"""{_C}, f AS (SELECT * FROM c WHERE tenant_id = 1 AND course_id = 1 AND access_label IN ('public', 'enrolled', 'staff_only') AND source_id IN (1, 5, 7, 11, 13, 17, 19) AND (unit = 1 OR week = 3) AND page BETWEEN 1 AND 90 AND chunk_class IN ('content', 'exercise_question'))"""
_RANK = "list_position(['public', 'enrolled', 'staff_only', 'restricted'], access_label)"
_TRAIL = f"""{retrieval._TOP}, b AS (SELECT item_id * 20 AS qid, text FROM benchmark WHERE item_id * 20 IN (SELECT qid FROM top)),
k AS (SELECT qid, text, qid % 60 <> 0 AND qid % 80 <> 0 AS listed FROM b)"""
_PR = f"pr AS (SELECT c_custkey AS principal, c_custkey % 5 AS tenant_id, {_LIST(['learner', 'instructor', 'admin', 'learner'])}[c_custkey % 4 + 1] AS role, [c_custkey % 30, c_custkey % 17 + 30] AS courses FROM customer), co AS (SELECT o_orderkey % 45 AS course_id, o_orderkey % 45 % 5 AS tenant_id, bool_or(o_orderkey % 45 % 7 = 0 AND o_orderpriority = '1-URGENT') AS open FROM orders GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (payload_filter, version_filter, scoped_topk, vector_index_scoped, indexed_count, access_recheck, withheld_solutions, rescored_cut, course_authorised, course_previews, citation_trailer, citations_read, practice_sources)}

SQL = {
    "payload_filter": f"WITH {_F} SELECT cid, access_label, chunk_class, page FROM f",
    "version_filter": f"WITH {_C} SELECT cid, access_label FROM c WHERE tenant_id = 0 AND course_id = 2 AND version_id = 2 AND access_label IN ('public', 'enrolled')",
    "scoped_topk": f"WITH {retrieval._TOP}, {_F} SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS recall_rank FROM p SEMI JOIN f USING (cid) QUALIFY recall_rank <= 5",
    "vector_index_scoped": f"WITH {retrieval._TOP}, {_F} SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS recall_rank FROM p SEMI JOIN f USING (cid) QUALIFY recall_rank <= 5",
    "indexed_count": f"WITH {_C} SELECT count(*) AS total_indexed FROM c WHERE tenant_id = 1 AND course_id = 1 AND version_id = 3 AND access_label IN ('public', 'enrolled')",
    "access_recheck": f"WITH {retrieval._TOP}, {_C} SELECT qid, cid, access_label FROM top JOIN c USING (cid) WHERE coalesce({_RANK} - 1, 1) <= qid // 20 % 4",
    "withheld_solutions": f"""WITH {retrieval._TOP}, {_C} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY recall_rank) AS citation, cid, chunk_class FROM top JOIN c USING (cid)
WHERE NOT (qid % 40 = 0 AND qid / 40 % 5 < 3 AND chunk_class IN ('exercise_solution', 'assessment'))""",
    "rescored_cut": retrieval.SQL["lexical_rescore"].replace("SELECT qid, cid, hits, round(", "SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY rescored DESC, recall_rank) AS place, rescored FROM (SELECT *, round(").replace("FROM h", "FROM h) QUALIFY place <= 4"),
    "course_authorised": f"WITH {_PR} SELECT principal, course_id FROM pr JOIN co USING (tenant_id) WHERE role IN ('admin', 'instructor') OR list_contains(courses, course_id) OR open",
    "course_previews": f"WITH {_PR} SELECT principal, course_id FROM pr JOIN co USING (tenant_id) WHERE role = 'instructor' AND list_contains(courses, course_id)",
    "citation_trailer": f"WITH {_TRAIL} SELECT qid, md5(CASE WHEN listed THEN text || chr(10) ELSE text END) AS visible_md5, CASE WHEN listed THEN (SELECT count(*) FROM top WHERE top.qid = k.qid) ELSE 0 END AS n_claims FROM k",
    "citations_read": f"""WITH {_TRAIL} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY recall_rank) AS place, recall_rank AS citation, cid FROM top WHERE recall_rank <= 3 AND qid IN (SELECT qid FROM k WHERE listed)""",
    "practice_sources": """SELECT DISTINCT l_partkey AS book_id, l_suppkey AS source_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE o_orderstatus <> 'P' AND o_custkey % 3 <> 0 AND p_size % 4 <> 0 AND o_orderkey % 6 = o_orderkey % 50 % 6 AND p_partkey % 4 = o_orderkey % 50 % 4""",
}
