"""A training corpus from ``documents``: rules, near-duplicates, benchmark, mixture, token tables.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

Cases, for every stage: a null text is an empty one; empty and very long texts are judged whole like others; an empty
table passes through; further columns of the input are kept as they are, but their names must not begin with two
underscores, which the stages use for their own. What a stage does with ties, null ids and repeated rows is in its docstring.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.llm import decontamination, minhash, mixing, quality_rules, sstable
from chalkline.llm.registry import TOKENIZER
from chalkline.sources.scratch import scratch_table
from chalkline.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject, for themselves or for their host, go.

    Every row is judged for itself, repeated ones and those without an id too; a null source is a host of its own.
    """
    ship(spark)
    judged = quality_rules.apply_rules(docs, docs.columns, out="__rules", failed="__failed", kept="__kept")
    return judged.filter("__kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (there are no ties of different ids).

    Of repeated rows with one id and one text a single row stays, the smallest by its other columns (maps aside, which
    have no order); rows of one id with different texts are one document,
    so they stay or go together. Rows with a null id can't be named and stay.
    """
    ship(spark)
    found = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("gone"), F.count(F.lit(1)).alias("n"))
    marked = scratch_table(found.filter("doc_id IS NOT NULL AND (gone OR n > 1)").select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone")), "gone")
    rest = docs.join(marked, docs["doc_id"] == marked["__id"], "left").filter("__gone IS NULL OR NOT __gone")
    names = [f"`{c}`" for c in docs.columns]
    order = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    once = rest.filter("__gone IS NOT NULL").groupBy("doc_id", "text").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__row")).select("__row.*")
    return rest.filter("__gone IS NULL").select(*names).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Every row is judged for itself, repeated ones and those without an id too."""
    ship(spark)
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns, prefix="__")
    return found.filter("__n_hit = 0").select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the sources' target amounts: a row for each epoch that takes at least half of a document.

    The epochs of a document are the words that the schedule's slots take of it over its size, rounded, so a source is
    off its target by half a document of those at the ends of its stream. Repeated rows of an id, and those without an
    id, share their average. The order of the slots ends here: the token tables are sorted by id, for their lookup.
    """
    taken, _ = mixing.mix_sources(docs)
    copies = taken.groupBy("doc_id").agg(F.coalesce(F.round(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))), F.lit(0)).cast("int").alias("__n"))
    copies = copies.filter("__n > 0").withColumnRenamed("doc_id", "__id")
    repeated = docs.join(copies.hint("merge"), docs["doc_id"].eqNullSafe(copies["__id"]))  # by shuffle at every size: a copy count for each document isn't bounded
    return repeated.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixture in shard files, read back: doc_id, start, n_tokens, ids_crc32.

    A row for each row of the mixture; rows of one id (its epochs) follow one another in any order, those without an id are first.
    """
    ship(spark)
    return sstable.token_tables(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
    ("token tables", token_stage),
]

#: No SQL encodes token ids; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
