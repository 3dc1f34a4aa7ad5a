"""Retrieval queries. Chunks are ``embeddings`` with the text of the document of the same id; queries are the vectors
whose id is divisible by 20, with the text of a benchmark item."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.functions import text as X
from chalkline.operators import retrieval as R
from chalkline.operators import vector_index as I
from chalkline.sources.scratch import scratch_path
from chalkline.sources.tables import table

K = 15


def _queries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").filter("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), (F.col("vec_id") % 80 / 20).cast("long").alias("qrank"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec"), (F.col("vec_id") % 4).alias("crank"))


def _described(found: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the query's text and the chunk's text, path, source and page."""
    path = F.concat(F.lit("Unit 0"), F.col("doc_id") % 10, F.lit("/week_"), F.col("doc_id") % 7, F.lit("_"), F.col("source"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("cid"), "text", path.alias("path"), "source", (F.col("doc_id") % 3).alias("page"))
    bench = table(spark, d, "benchmark").select((F.col("item_id") * 20).alias("qid"), F.concat(F.col("text"), F.when(F.col("item_id") % 2 == 1, F.concat(F.lit(" unit "), F.col("item_id") % 10)).otherwise("")).alias("query"))
    return found.join(bench, "qid").join(docs, "cid")


def _top(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    ship(spark)
    return R.dense_topk(_queries(spark, d), _chunks(spark, d), k)


_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
_TOP = f"""v AS (SELECT vec_id, {_VEC} AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
p AS (SELECT q.vec_id AS qid, c.vec_id AS cid, round(list_dot_product(q.e, c.e), 6) + 0.0 AS score,
  (q.vec_id % 80 // 20) AS qrank, c.vec_id % 4 AS crank FROM n q, n c WHERE q.vec_id % 20 = 0),
top AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS recall_rank FROM p QUALIFY recall_rank <= {K})"""
_DESCRIBED = f"""{_TOP},
cand AS (SELECT top.*, b.item_id, b.text || CASE WHEN b.item_id % 2 = 1 THEN ' unit ' || (b.item_id % 10) ELSE '' END AS query, d.text, d.source, d.doc_id % 3 AS page,
  'Unit 0' || (d.doc_id % 10) || '/week_' || (d.doc_id % 7) || '_' || d.source AS path
  FROM top JOIN benchmark b ON b.item_id * 20 = top.qid JOIN documents d ON d.doc_id = top.cid)"""
_SCOPES = "list_distinct(list_transform(regexp_extract_all(lower({0}), '(?:^|[^a-z0-9])((?:unit|week)[\\s_/-]*\\d+)', 1), lambda x: x[1:4] || ':' || regexp_extract(x, '(\\d+)$', 1)::BIGINT))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{M}}_*]+')), lambda x: length(x) >= 3 AND NOT list_contains(" + _STOPS + ", x))"


def dense_topk(spark, d):
    return _top(spark, d)


def acl_filtered_topk(spark, d):
    ship(spark)
    return R.dense_topk(_queries(spark, d), _chunks(spark, d), 10, ranked_access=True)


#: One cell in so many is searched before the bounds are looked at; the recall that probes are chosen for.
PROBED, RECALL = 3, 0.95


def _index(spark: SparkSession, chunks: DataFrame) -> tuple[I.VectorIndex, int]:
    """The chunks' index and the number of cells that a query is sent to."""
    ship(spark)
    index = I.VectorIndex.build(chunks, scratch_path(spark, "index"))
    return index, max(1, -(-index.cells.count() // PROBED))


def vector_index_topk(spark, d):
    """The exact search of the index, which starts from the nearest cells."""
    index, probes = _index(spark, _chunks(spark, d))
    return index.search(_queries(spark, d).drop("qrank"), K, probes, exact=True)


def vector_index_ranked(spark, d):
    """As ``acl_filtered_topk``, by the index."""
    index, probes = _index(spark, _chunks(spark, d))
    return index.search(_queries(spark, d), 10, probes, exact=True)


def vector_index_recall(spark, d):
    """Recall of the nearest cells alone against the search of all rows, and whether it is enough."""
    index, _ = _index(spark, _chunks(spark, d))
    queries = _queries(spark, d).drop("qrank")
    measured = I.recall(index.search(queries, K, index.probes_for(K, RECALL)), R.dense_topk(queries, _chunks(spark, d), K))
    return measured.select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


def lexical_rescore(spark, d):
    return R.rescore(_described(_top(spark, d), spark, d)).select("qid", "cid", "hits", "rescored")


def scope_extract(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("Unit 0"), F.col("doc_id") % 10, F.lit("/week_"), F.col("doc_id") % 7, F.lit(" unit-"), F.col("doc_id") % 13)
    return docs.select("doc_id", F.array_join(F.array_sort(X.scopes(path)), ",").alias("scopes"))


def source_cap_rerank(spark, d):
    return R.cap_per_source(_described(_top(spark, d), spark, d), "source").select("qid", "cid", "source", "score")


def page_diversify(spark, d):
    placed = R.diversify_pages(_described(_top(spark, d), spark, d), "source", "page", F.col("page") > 0)
    return placed.select("qid", "cid", "repeated", "place")


def substantive_preference(spark, d):
    return R.prefer_substantive(_described(_top(spark, d), spark, d), least=600).select("qid", "cid", "preferred")


def evidence_lexical_gate(spark, d):
    return R.lexical_gate(_described(_top(spark, d), spark, d)).select("qid", "cid", "score")


def _evidence(spark, d):
    return R.within_budget(_described(_top(spark, d), spark, d), [F.desc("score"), F.col("recall_rank")], max_tokens=1500)


def evidence_budget(spark, d):
    return _evidence(spark, d).select("qid", "citation", "cid", "used", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def citation_validate(spark, d):
    claims = _top(spark, d).select("qid", F.col("recall_rank").alias("position"), (F.col("recall_rank") % 6 + 1).alias("citation"), F.col("cid"))
    claims = claims.union(claims.select("qid", F.col("position") + 100, F.col("citation") - 1, "cid"))
    return R.validate_citations(claims, _evidence(spark, d)).select("qid", "position", "citation", "cid")


def retrieval_trace(spark, d):
    found = R.traces(_top(spark, d), _evidence(spark, d))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("qid", joined("candidate_ids").alias("candidates"), joined("evidence_ids").alias("evidence"), "min_score", "max_chunks", "max_tokens")


_BUDGET = f"""{_DESCRIBED},
t AS (SELECT *, ceil(length(text) / 4)::BIGINT AS tokens FROM cand),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY qid ORDER BY score DESC, recall_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, recall_rank) AS citation FROM t),
ev AS (SELECT qid, cid, citation, used, CASE WHEN tokens <= 1500 - used THEN text ELSE left(text, (1500 - used) * 4) END AS text
  FROM s WHERE citation <= 5 AND (tokens <= 1500 - used OR 1500 - used >= 32))"""

QUERIES = {f.__name__: f for f in (dense_topk, acl_filtered_topk, vector_index_topk, vector_index_ranked, vector_index_recall, lexical_rescore, scope_extract, source_cap_rerank, page_diversify, substantive_preference, evidence_lexical_gate, evidence_budget, citation_validate, retrieval_trace)}

SQL = {
    "dense_topk": f"WITH {_TOP} SELECT qid, cid, score, recall_rank FROM top",
    "acl_filtered_topk": f"WITH {_TOP} SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS recall_rank FROM p WHERE crank <= qrank QUALIFY recall_rank <= 10",
    "vector_index_topk": f"WITH {_TOP} SELECT qid, cid, score, recall_rank FROM top",
    "vector_index_ranked": f"WITH {_TOP} SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS recall_rank FROM p WHERE crank <= qrank QUALIFY recall_rank <= 10",
    "vector_index_recall": "SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "lexical_rescore": f"""WITH {_DESCRIBED}, h AS (SELECT *, len(list_filter(list_distinct(regexp_split_to_array(lower(query), '\\s+')), lambda w: length(w) >= 3 AND contains(lower(text), w)))::BIGINT AS hits FROM cand)
SELECT qid, cid, hits, round(score + 0.05::DOUBLE * hits + CASE WHEN list_has_any({_SCOPES.format("query")}, {_SCOPES.format("path")}) THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END, 6) AS rescored FROM h""",
    "scope_extract": f"SELECT doc_id, array_to_string(list_sort({_SCOPES.format("'Unit 0' || (doc_id % 10) || '/week_' || (doc_id % 7) || ' unit-' || (doc_id % 13)")}), ',') AS scopes FROM documents",
    "source_cap_rerank": f"WITH {_DESCRIBED} SELECT qid, cid, source, score FROM cand QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, recall_rank) <= CASE WHEN item_id % 2 = 0 THEN 2 ELSE 5 END",
    "page_diversify": f"""WITH {_DESCRIBED}, m AS (SELECT *, NOT (page > 0 AND row_number() OVER (PARTITION BY qid, source, page ORDER BY score DESC, recall_rank) = 1) AS repeated FROM cand)
SELECT qid, cid, repeated, row_number() OVER (PARTITION BY qid ORDER BY repeated, score DESC, recall_rank) AS place FROM m""",
    "substantive_preference": f"""WITH {_DESCRIBED}, m AS (SELECT *, max(length(text)) OVER (PARTITION BY qid) AS longest FROM cand)
SELECT qid, cid, round(score + least(length(text), 400) / 400.0::DOUBLE * 0.1::DOUBLE, 6) AS preferred FROM m WHERE length(text) >= 600 OR longest < 600""",
    "evidence_lexical_gate": f"""WITH {_DESCRIBED} SELECT qid, cid, score FROM cand WHERE score >= 0.2 AND (score >= 0.5
OR list_has_any({_TERMS.format("query")}, {_TERMS.format("path || ' ' || text")}) OR list_has_any({_SCOPES.format("query")}, {_SCOPES.format("path")}))""",
    "evidence_budget": f"WITH {_BUDGET} SELECT qid, citation, cid, used, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM ev",
    "citation_validate": f"""WITH {_BUDGET}, cl AS (SELECT qid, recall_rank AS position, recall_rank % 6 + 1 AS citation, cid FROM top UNION ALL SELECT qid, recall_rank + 100, recall_rank % 6, cid FROM top)
SELECT qid, position, citation, cid FROM cl SEMI JOIN ev USING (qid, citation, cid) QUALIFY row_number() OVER (PARTITION BY qid, citation ORDER BY position) = 1""",
    "retrieval_trace": f"""WITH {_BUDGET}, c AS (SELECT qid, string_agg(cid::VARCHAR, ',' ORDER BY recall_rank) AS candidates FROM top GROUP BY qid),
e AS (SELECT qid, string_agg(cid::VARCHAR, ',' ORDER BY citation) AS evidence FROM ev GROUP BY qid)
SELECT qid, candidates, coalesce(evidence, '') AS evidence, 0.2::DOUBLE AS min_score, 5 AS max_chunks, 3500 AS max_tokens FROM c LEFT JOIN e USING (qid)""",
}
