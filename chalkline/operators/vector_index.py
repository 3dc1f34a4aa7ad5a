"""Inverted-file vector index: unit vectors in cells of their nearest centroid, searched by cells, exactly if asked to.

Centroids are fitted on a bounded sample (about SAMPLE rows, by hashed id); every row is indexed. The index is a Parquet
table partitioned by cell, in parts of PART_ROWS rows, with all payload columns, so filters on cells and payload reach
the scan; and a small table of cells. Queries stay rows: each is sent to the parts of its nearest cells, and a task
compares a block of queries with a part.

An exact search goes on from there: a cell can only hold a better row if the angle to its centroid, less the widest angle
in the cell, is below that of the query's k-th row so far, and these cells are searched as well.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.operators.retrieval import _matrix, _whole, merge_best, none_held
from chalkline.sources.scratch import scratch_table

#: Rows that centroids are fitted on, about, and steps of the fit.
SAMPLE, STEPS = 50_000, 12
#: Rows of a part of a cell, and queries of a block that meets a part.
PART_ROWS, QUERY_ROWS = 8192, 2048
#: Rows that a task compares with all centroids, or queries with a part, in a step.
STEP_ROWS = 256
#: Centroids are sent to the tasks whole; there are no more of them than this allows.
CENTROID_BYTES = 64 << 20


def fit_centroids(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means of unit rows: farthest-first seeds among a few candidates, then Lloyd's steps."""
    rng = np.random.Generator(np.random.PCG64(7))
    cells = max(1, min(cells, len(sample)))
    chosen = [int(rng.integers(len(sample)))]
    nearest = sample @ sample[chosen[0]]
    while len(chosen) < cells:
        some = rng.integers(len(sample), size=16)
        chosen.append(int(some[np.argmin(nearest[some])]))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(steps):
        own = _nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    return centroids


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of STEP_ROWS rows at most, none empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(at, STEP_ROWS)


def _nearest(rows: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the ``k`` nearest centroids of each row, nearest first."""
    similar = rows @ centroids.T
    k = min(k, len(centroids))
    best = np.argpartition(-similar, k - 1, axis=1)[:, :k] if k < len(centroids) else np.broadcast_to(np.arange(k), similar.shape).copy()
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(similar, best, 1), axis=1, kind="stable"), 1)


@dataclass
class VectorIndex:
    """``rows``: the indexed table (cell, part, cid, cvec, payload); ``cells``: (cell, centroid, least, n, parts)."""

    rows: DataFrame
    cells: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> "VectorIndex":
        """Index ``chunks`` (cid, cvec and any payload) at ``path``; about a cell for each root of their number by default.

        Rows with a null vector match nothing and are left out; rows of one cid are rows of their own. A zero vector is
        in a cell like any other and has a similarity of 0.
        """
        spark = chunks.sparkSession
        known = chunks.filter("cvec IS NOT NULL")
        n = known.count()
        share = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(1, n))
        picked = _matrix(_whole(known.filter(share).select(F.col("cvec").cast("array<double>").alias("v")).toArrow().column("v"))) if n else np.zeros((0, 1))
        if not len(picked) and n:  # a few rows whose ids' hashes all lie beyond the share
            picked = _matrix(_whole(known.limit(1).select(F.col("cvec").cast("array<double>").alias("v")).toArrow().column("v")))
        wanted = min(cells or int(np.ceil(np.sqrt(n))), CENTROID_BYTES // (8 * picked.shape[1]))
        centroids = fit_centroids(picked, wanted) if len(picked) else np.zeros((1, 1))
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _steps(batches):
                rows = _matrix(batch.column("cvec"))
                cell = _nearest(rows, shared.value, 1)[:, 0]
                to_centre = np.einsum("ij,ij->i", rows, shared.value[cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(to_centre)], names=[*batch.schema.names, "cell", "to_centre"])

        schema = T.StructType([*known.schema, T.StructField("cell", T.IntegerType()), T.StructField("to_centre", T.DoubleType())])
        placed = scratch_table(known.mapInArrow(assign, schema), "placed")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_centre").alias("least")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
        sizes = scratch_table(sizes, "sizes")
        # A cell is small as a rule, and a large one is dealt to parts that are files of their own
        part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
        rows = placed.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", part).drop("parts", "to_centre")
        rows.repartition("cell", "part").sortWithinPartitions("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
        listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        listed.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/cells")
        shared.destroy()
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "VectorIndex":
        rows = spark.read.parquet(f"{path}/rows") if spark.read.parquet(f"{path}/cells").count() else None
        return cls(rows, spark.read.parquet(f"{path}/cells"))

    def _probes(self, queries: DataFrame, reach: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
        """(qid, qvec, qrank, cell): queries with the cells that ``reach`` (a matrix of booleans) says."""
        table = self.cells.orderBy("cell").toArrow()  # CENTROID_BYTES at most
        shared = queries.sparkSession.sparkContext.broadcast((table.column("cell").to_numpy(), np.stack(table.column("centroid").to_pylist()), table.column("least").to_numpy()))
        names = [c for c in queries.columns if c in ("qid", "qvec", "qrank")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, centroids, least = shared.value
            for batch in _steps(batches):
                of, at = np.nonzero(reach(_matrix(batch.column("qvec")) @ centroids.T, least, cell, batch))
                # A query goes to many cells, each time with its vector
                for some in range(0, len(of), PART_ROWS):
                    kept = batch.select(names).take(pa.array(of[some : some + PART_ROWS]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell[at[some : some + PART_ROWS]])], names=[*names, "cell"])

        return queries.mapInArrow(run, T.StructType([*(queries.schema[c] for c in names), T.StructField("cell", T.IntegerType())]))

    def _compare(self, probes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """(qid, cid, score): the ``k`` best of each query in each part that it meets."""
        ranked = "qrank" in probes.columns
        met = probes.join(F.broadcast(self.cells.select("cell", "parts")), "cell")
        blocks = met.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
        left = met.join(blocks, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
        right = rows.select("cell", "part", "cid", "cvec", *(["crank"] if ranked else [])).join(F.broadcast(blocks.select(F.col("cell").alias("met"), F.col("blocks").alias("of"))), F.col("cell") == F.col("met"))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("met", "of")

        def best(queries: pa.Table, stored: pa.Table) -> pa.Table:
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            if queries.num_rows and stored.num_rows:
                qid, vectors, cid, unit = queries.column("qid").to_numpy(), _matrix(_whole(queries.column("qvec"))), stored.column("cid").to_numpy(), _matrix(_whole(stored.column("cvec")))
                for at in range(0, len(qid), STEP_ROWS):
                    of = (queries.column("qrank").to_numpy()[at : at + STEP_ROWS], stored.column("crank").to_numpy()) if ranked else None
                    scores, found = merge_best(none_held(len(qid[at : at + STEP_ROWS])), vectors[at : at + STEP_ROWS], unit, cid, k, of)
                    keep = np.isfinite(scores)
                    for part, x in zip(out, (np.broadcast_to(qid[at : at + STEP_ROWS, None], scores.shape)[keep], found[keep], scores[keep] + 0.0), strict=True):
                        part.append(x)
            return pa.table([pa.array(np.concatenate(x)) for x in out], names=["qid", "cid", "score"])

        keys = ["cell", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "qid long, cid long, score double")

    def search(self, queries: DataFrame, k: int, probes: int, exact: bool = False, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(qid, cid, score, recall_rank): the ``k`` most similar rows of each query by cosine, ties by cid.

        queries (qid, qvec, and qrank if rows have a crank that may not exceed it); ids are unique. ``where`` filters
        the rows that are searched, which reaches the scan. The ``probes`` nearest cells are searched, and for ``exact`` all cells that may hold
        a row of the result. Scores are rounded to six digits before ranking.
        """
        wanted = queries.filter("qvec IS NOT NULL")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
        if self.rows is None:
            return wanted.limit(0).select("qid", F.col("qid").alias("cid"), F.lit(0.0).alias("score"), F.col("qid").alias("recall_rank"))
        rows = self.rows if where is None else where(self.rows)

        def near(similar: np.ndarray, least: np.ndarray, cell: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(similar.shape, bool)
            np.put_along_axis(out, np.argsort(-similar, axis=1, kind="stable")[:, :probes], True, 1)
            return out

        ranked = lambda found: found.withColumn("recall_rank", F.row_number().over(order).cast("long")).filter(F.col("recall_rank") <= k)
        found = ranked(self._compare(self._probes(wanted, near), rows, k))
        if not exact:
            return found
        found = scratch_table(found, "found")
        last = found.groupBy("qid").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("k"))
        open_ = wanted.join(last.filter(F.col("k") >= k).select("qid", "bar"), "qid", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))

        def may_hold(similar: np.ndarray, least: np.ndarray, cell: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            angle = np.arccos(np.clip(similar, -1, 1)) - np.arccos(np.clip(least, -1, 1))[None, :]
            bound = np.cos(np.clip(angle, 0, np.pi))
            return (bound >= batch.column("bar").to_numpy()[:, None] - 1e-5) & ~near(similar, least, cell, batch)

        more = self._compare(self._probes(open_, may_hold), rows, k)
        return ranked(found.select("qid", "cid", "score").union(more))

    def probes_for(self, k: int, recall: float, sample: int = 256) -> int:
        """The least number of probes with which the ``k`` best of about ``sample`` indexed rows are found to this share.

        Their exact results are looked up once; the curve of recall over probes is the histogram of how near the cells of
        these results are.
        """
        n = self.cells.agg(F.sum("n")).first()[0] or 0
        share = F.pmod(F.xxhash64("cid", F.lit("probe")), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample / max(1, n))))
        if not n:
            return 1
        picked = scratch_table(self.rows.filter(share).select(F.col("cid").alias("qid"), F.col("cvec").alias("qvec")), "probes")
        cells = self.cells.count()
        found = self.search(picked, k, -(-cells // 4), exact=True).select("qid", "cid").join(self.rows.select("cid", "cell"), "cid")
        wanted = picked.join(found.groupBy("qid").agg(F.collect_list("cell").alias("cells")), "qid")
        table = self.cells.orderBy("cell").toArrow()
        shared = picked.sparkSession.sparkContext.broadcast((table.column("cell").to_numpy(), np.stack(table.column("centroid").to_pylist())))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, centroids = shared.value
            for batch in batches:
                if batch.num_rows:
                    order = cell[np.argsort(-(_matrix(batch.column("qvec")) @ centroids.T), axis=1, kind="stable")]
                    at = [np.flatnonzero(o == c)[0] + 1 for o, cs in zip(order, batch.column("cells").to_pylist(), strict=True) for c in cs]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["place"])

        near = wanted.select("qvec", "cells").mapInArrow(places, "place long").groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()
        total, seen = sum(r.n for r in near), 0
        for r in near:
            seen += r.n
            if seen >= recall * total:
                return r.place
        return cells


def recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(n_queries, recall): the share of the expected (qid, cid) that was found, over all queries."""
    hit = expected.select("qid", "cid").join(found.select("qid", "cid", F.lit(1).alias("hit")), ["qid", "cid"], "left")
    return hit.agg(F.count_distinct("qid").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"))
