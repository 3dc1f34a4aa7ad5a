"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.sources.scratch import scratch_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked with the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
    least = both.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.filter("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of these."""
    least = edges.groupBy("node").agg(F.min("to").alias("least"))
    moved = edges.join(least, "node").filter("to > least").select(F.col("to").alias("node"), F.col("least").alias("to"))
    return moved.union(least.select("node", F.col("least").alias("to"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches.

    A round is a large and a small star, each a written table that is read once by the next, so plans don't grow. The
    minima have partial aggregates, so a hub costs one row a task. A chain of rising ids loses half of its
    length in a round; the rounds end when the links, each from a node to its component then, don't change. Links
    with a null end, loops and repeats are ignored.
    """
    edges = scratch_table(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct(), "edges")
    before, now = None, _state(edges)
    while now != before and now[0]:
        edges = scratch_table(_small_star(scratch_table(_large_star(edges), "large-star")), "edges")
        before, now = now, _state(edges)
    roots = edges.select(F.col("to").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return scratch_table(edges.select("node", F.col("to").alias("component")).union(roots), "labels")


def _state(edges: DataFrame) -> tuple:
    """The number of links, and two sums over them that tell whether they are the same."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "to")), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first())
