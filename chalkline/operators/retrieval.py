"""Access-controlled vector retrieval and the selection of evidence, for many queries at once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.sources.scratch import scratch_table

#: Query vectors that are sent to the tasks at a time, about; more of them are handled in further blocks.
QUERY_BLOCK = 1 << 16
#: Scores that a task looks at in a step, however large its batches are.
SCORES = 1 << 20
MIN_SCORE, SURE_SCORE = 0.2, 0.5
MAX_CHUNKS, MAX_TOKENS, LEAST_LEFT = 5, 3500, 32


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as unit rows."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # of a slice, its own values
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def merge_best(held: tuple, vectors: np.ndarray, stored: np.ndarray, cid: np.ndarray, k: int, ranks: tuple | None = None) -> tuple:
    """(scores, cids): the ``k`` best for each of the vectors among those held and the stored rows, ties by cid.

    Rows are looked at in steps of about SCORES scores. With ``ranks`` (of vectors, of rows) rows above a vector's rank
    have a score of -inf.
    """
    step = max(1, SCORES // max(1, len(vectors)))
    for at in range(0, len(cid), step):
        scores = vectors @ stored[at : at + step].T
        np.round(scores, 6, out=scores)
        if ranks is not None:
            scores[ranks[1][None, at : at + step] > ranks[0][:, None]] = -np.inf
        some = cid[at : at + step]
        if held[0].shape[1] == k:  # rows that none of the vectors can still take
            near = (scores >= held[0][:, -1:]).any(axis=0)
            scores, some = scores[:, near], some[near]
        ids = np.hstack((held[1], np.broadcast_to(some, scores.shape)))
        scores = np.hstack((held[0], scores))
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        held = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    return held


def none_held(n: int) -> tuple:
    return np.zeros((n, 0)), np.zeros((n, 0), np.int64)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, ranked_access: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, cid, score, recall_rank): the ``k`` most similar chunks of every query by cosine, ties by cid.

    ``queries`` (qid, qvec) and ``chunks`` (cid, cvec); with ``ranked_access`` also qrank and crank, and only chunks of
    a rank up to the query's are compared (before the cut). Queries are dealt to blocks of about ``block`` by hash; one
    block at a time is sent to the tasks as a matrix and dropped when its results are written, so the driver never
    holds more. A task keeps ``k`` rows for each query over all of its batches, so only those are shuffled. Null
    vectors match nothing. Scores are rounded to six digits before ranking.
    """
    spark = chunks.sparkSession
    wanted = queries.filter("qvec IS NOT NULL").select("qid", F.col("qvec").cast("array<double>").alias("qvec"), *(["qrank"] if ranked_access else []))
    stored = chunks.filter("cvec IS NOT NULL").select("cid", "cvec", *(["crank"] if ranked_access else []))
    blocks = max(1, -(-wanted.count() // block))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = None
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = part.toArrow().combine_chunks()
        vectors = _matrix(_whole(rows.column("qvec")))
        shared = spark.sparkContext.broadcast((rows.column("qid").to_numpy(), vectors, rows.column("qrank").to_numpy() if ranked_access else None))
        best = _block_topk(stored, shared, k).withColumn("recall_rank", F.row_number().over(order).cast("long")).filter(F.col("recall_rank") <= k)
        if blocks == 1:
            return best
        best = scratch_table(best, "block")
        shared.destroy()
        found = best if found is None else found.union(best)
    return found


def _whole(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined.chunk(0) if isinstance(joined, pa.ChunkedArray) else joined


def _block_topk(chunks: DataFrame, shared: Broadcast, k: int, step: int = 1024) -> DataFrame:
    """The ``k`` best chunks of a block's queries in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, ranks = shared.value
        held = {at: none_held(len(ids[at : at + step])) for at in range(0, len(ids), step)}
        for batch in batches:
            if batch.num_rows:
                cid, stored = batch.column("cid").to_numpy(), _matrix(batch.column("cvec"))
                for at in held:
                    of = None if ranks is None else (ranks[at : at + step], batch.column("crank").to_numpy())
                    held[at] = merge_best(held[at], vectors[at : at + step], stored, cid, k, of)
        for at, (scores, cid) in held.items():
            keep = np.isfinite(scores)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[at : at + step, None], scores.shape)[keep]), pa.array(cid[keep]), pa.array(scores[keep] + 0.0)], names=["qid", "cid", "score"])

    return chunks.mapInArrow(run, "qid long, cid long, score double")


def best(candidates: DataFrame, limit: int, score: str = "rescored") -> DataFrame:
    """The ``limit`` best of each query by score, ties in their order of recall."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), "recall_rank")
    return candidates.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= limit)


def rescore(candidates: DataFrame, query: str = "query", text: str = "text", path: str = "path") -> DataFrame:
    """``rescored``: similarity, plus 0.05 for each query word in the text and 0.35 for a common scope; six digits."""
    hits = X.keyword_hits(F.col(query), F.col(text))
    scoped = F.arrays_overlap(X.scopes(F.col(query)), X.scopes(F.col(path)))
    raised = F.col("score") + 0.05 * hits + F.when(scoped, 0.35).otherwise(0.0)
    return candidates.withColumn("hits", hits).withColumn("rescored", F.round(raised, 6))


def cap_per_source(candidates: DataFrame, source: str, cap: int | None = None, score: str = "score", query: str = "query") -> DataFrame:
    """At most ``cap`` candidates of a source for a query, best first; if not set, 5 where the query names a scope, else 2."""
    order = Window.partitionBy("qid", source).orderBy(F.desc(score), "recall_rank")
    most = F.lit(cap) if cap is not None else F.when(F.size(X.scopes(F.col(query))) > 0, MAX_CHUNKS).otherwise(2)
    return candidates.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def diversify_pages(candidates: DataFrame, source: str, anchor: str, is_page: Column, score: str = "score") -> DataFrame:
    """``place``: first chunks of every page before repeats (chunks without a page count as repeats)."""
    first = F.row_number().over(Window.partitionBy("qid", source, anchor, is_page).orderBy(F.desc(score), "recall_rank"))
    marked = candidates.withColumn("repeated", ~(is_page & (first == 1)))
    order = Window.partitionBy("qid").orderBy("repeated", F.desc(score), "recall_rank")
    return marked.withColumn("place", F.row_number().over(order).cast("long"))


def prefer_substantive(candidates: DataFrame, text: str = "text", least: int = 80, score: str = "score") -> DataFrame:
    """Drop short texts where a query has a longer one; ``preferred`` adds up to 0.1 for length."""
    n = F.length(text)
    longest = F.max(n).over(Window.partitionBy("qid"))
    kept = candidates.withColumn("__longest", longest).filter((n >= least) | (F.col("__longest") < least)).drop("__longest")
    return kept.withColumn("preferred", F.round(F.col(score) + F.least(n, F.lit(400)) / 400.0 * 0.1, 6))


def lexical_gate(candidates: DataFrame, query: str = "query", text: str = "text", path: str = "path", score: str = "score", trusted: bool = False) -> DataFrame:
    """Scores of 0.2 or more; below 0.5 the query needs a term or a scope in common with text or path."""
    evidence = X.relevance_terms(F.concat_ws(" ", F.col(path), F.col(text)))
    support = F.arrays_overlap(X.relevance_terms(F.col(query)), evidence) | F.arrays_overlap(X.scopes(F.col(query)), X.scopes(F.col(path)))
    fit = F.col(score) >= MIN_SCORE
    return candidates.filter(fit if trusted else fit & ((F.col(score) >= SURE_SCORE) | support))


def within_budget(candidates: DataFrame, order: list[Column], text: str = "text", max_chunks: int = MAX_CHUNKS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A query's first chunks within a token budget; the first that overflows is cut if enough is left, then none.

    Adds ``citation`` (1, 2, ...), ``used`` tokens before the chunk, and cuts ``text``. The sum before a chunk only
    grows, so the prefix is exact.
    """
    tokens = X.token_estimate(F.col(text))
    before = Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = candidates.withColumn("__t", tokens).withColumn("used", F.coalesce(F.sum("__t").over(before), F.lit(0)).cast("long"))
    marked = marked.withColumn("citation", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long"))
    left = F.lit(max_tokens) - F.col("used")
    whole = F.col("__t") <= left
    kept = marked.filter((F.col("citation") <= max_chunks) & (whole | (left >= LEAST_LEFT)))
    return kept.withColumn(text, F.when(whole, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), (left * 4).cast("int")))).drop("__t")


def validate_citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (qid, position, citation, cid) that name evidence rightly, first occurrence of each, in order."""
    known = claims.join(evidence.select("qid", "citation", "cid"), ["qid", "citation", "cid"], "left_semi")
    first = Window.partitionBy("qid", "citation").orderBy("position")
    return known.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def traces(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each query: ids and scores of its candidates by rank, ids of its evidence by citation, and the policy's limits."""
    ranked = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("recall_rank", "cid", "score"))).alias("c"))
    chosen = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("citation", "cid"))).alias("e"))
    joined = ranked.join(chosen, "qid", "left")
    return joined.select("qid", F.col("c.cid").alias("candidate_ids"), F.col("c.score").alias("scores"), F.coalesce(F.col("e.cid"), F.array().cast("array<bigint>")).alias("evidence_ids"), F.lit(MIN_SCORE).alias("min_score"), F.lit(MAX_CHUNKS).alias("max_chunks"), F.lit(MAX_TOKENS).alias("max_tokens"))
