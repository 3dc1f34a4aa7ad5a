"""The inverted-file index against brute force: exact results, recall, filters in the scan, hot cells and odd rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.operators import access, retrieval, vector_index
from chalkline.plans import access as access_plans
from chalkline.sources.scratch import scratch_path


def vectors(spark, rows, crank=False):
    kind = "cid long, cvec array<float>" + (", crank long" if crank else "")
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="module")
def clustered(spark):
    """Twelve clusters of unlike size, one with half of all rows, equal rows and a null vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    of = np.where(rng.random(1500) < 0.5, 0, rng.integers(0, 12, 1500))
    x = centres[of] + rng.normal(scale=0.25, size=(1500, 16))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 16)]
    return vectors(spark, rows)


def queries_of(chunks):
    return chunks.filter("cid % 20 = 0 AND cvec IS NOT NULL").select(F.col("cid").alias("qid"), F.col("cvec").alias("qvec"))


def values(df):
    return sorted((r.qid, r.recall_rank, r.cid, round(r.score, 6)) for r in df.collect())


def test_exact_search_is_that_of_all_rows(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 100)  # the largest cluster is in several parts
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 16)  # and its queries in several blocks
    index = vector_index.VectorIndex.build(clustered, scratch_path(spark, "index"), cells=12)
    assert index.rows.count() == 1501 and index.cells.agg(F.max("parts")).first()[0] > 3
    expected = values(retrieval.dense_topk(queries_of(clustered), clustered, 10))
    assert values(index.search(queries_of(clustered), 10, 1, exact=True)) == expected
    again = vector_index.VectorIndex.open(spark, index.rows.inputFiles()[0].split("/rows/")[0])
    assert values(again.search(queries_of(clustered), 10, 1, exact=True)) == expected


def test_recall_of_few_cells(spark, clustered):
    index = vector_index.VectorIndex.build(clustered, scratch_path(spark, "index"), cells=12)
    probes = index.probes_for(10, 0.95)
    assert probes <= 4
    expected = retrieval.dense_topk(queries_of(clustered), clustered, 10)
    assert vector_index.recall(index.search(queries_of(clustered), 10, probes), expected).first().recall >= 0.9
    one, all_ = (vector_index.recall(index.search(queries_of(clustered), 10, p), expected).first().recall for p in (1, 12))
    assert one <= all_ == 1.0


def test_ranks_and_fewer_rows_than_asked_for(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), i % 4) for i in range(60)]
    chunks = vectors(spark, rows, crank=True)
    queries = chunks.select(F.col("cid").alias("qid"), F.col("cvec").alias("qvec"), (F.col("cid") % 3).alias("qrank")).filter("qid < 9")
    index = vector_index.VectorIndex.build(chunks, scratch_path(spark, "index"))
    for k in (5, 100):
        assert values(index.search(queries, k, 2, exact=True)) == values(retrieval.dense_topk(queries, chunks, k, ranked_access=True))


def test_empty_index_and_no_queries(spark):
    none = vectors(spark, [])
    index = vector_index.VectorIndex.build(none, scratch_path(spark, "index"))
    some = vectors(spark, [(1, [1.0, 0.0])])
    assert index.search(queries_of(some), 3, 1, exact=True).count() == 0 and index.probes_for(3, 0.9) == 1
    index = vector_index.VectorIndex.build(some, scratch_path(spark, "index"))
    assert index.search(queries_of(none), 3, 1, exact=True).count() == 0


def test_filters_reach_the_scan(spark, sf, capsys):
    chunks = access_plans._chunks(spark, sf)
    index = vector_index.VectorIndex.build(chunks, scratch_path(spark, "index"))
    kept = access.payload_filter(index.rows, F.lit(1), F.lit(1), rank=1, version=F.lit(3)).filter("cell IN (0, 1)")
    kept.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "[cell") and "EqualTo(tenant_id,1)" in plan and "EqualTo(version_id,3)" in plan


def test_memory_of_a_search_does_not_grow_with_batches(monkeypatch):
    rng = np.random.default_rng(8)
    stored, wanted, cid = rng.normal(size=(10_000, 8)), rng.normal(size=(1024, 8)), rng.permutation(10_000)
    stored[50:90] = stored[50]
    tracemalloc.start()
    scores, found = retrieval.merge_best(retrieval.none_held(1024), wanted, stored, cid, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all scores at once are 82 MB, and there were six such arrays
    all_scores = np.round(wanted @ stored.T, 6)
    order = np.lexsort((np.broadcast_to(cid, all_scores.shape), -all_scores), axis=1)[:, :15]
    assert np.array_equal(found, cid[order]) and np.allclose(scores, np.take_along_axis(all_scores, order, 1), atol=2e-6)
    ranks = rng.integers(0, 4, 1024), rng.integers(0, 5, 10_000)
    held, ids = retrieval.merge_best(retrieval.none_held(1024), wanted, stored, cid, 15, ranks)
    assert (ranks[1][np.argsort(cid)][ids] <= ranks[0][:, None])[np.isfinite(held)].all()


def test_batches_of_the_index_are_cut():
    batch = pa.record_batch([pa.array(range(1000)), pa.array([[float(i)] * 2 for i in range(1000)])], names=["cid", "cvec"])
    cut = list(vector_index._steps(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in cut) <= vector_index.STEP_ROWS and [x for b in cut for x in b.column("cid").to_pylist()] == list(range(1000))
    assert np.allclose(np.vstack([retrieval._matrix(b.column("cvec")) for b in cut]), retrieval._matrix(batch.column("cvec")))
