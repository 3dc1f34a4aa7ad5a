"""Retrieval quality and release gates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.sources.scratch import scratch_table


#: Rows of queries' terms or passages that are sent to all tasks; more of them meet the documents by shuffle.
SMALL_ROWS = 50_000


def small(rows: DataFrame) -> DataFrame:
    """``rows`` marked for a broadcast where they are few, so that a frequent term's documents stay in all tasks."""
    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def term_counts(tokens: DataFrame, key: str) -> DataFrame:
    """(key, token, tf) as a written table, so that texts are split once."""
    return scratch_table(tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")), "terms")


def inverse_frequency(terms: DataFrame, n_docs: Column) -> DataFrame:
    """(token, df, idf): ln((N + 1) / (1 + df)) + 1 of each token of ``term_counts``."""
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.round(F.ln((n_docs + F.lit(1.0)) / (F.col("df") + 1)) + 1, 6))


def tfidf_scores(queries: DataFrame, terms: DataFrame, n_docs: Column, k: int) -> DataFrame:
    """Top ``k`` documents of each query (qid, token) by cosine of normalised TF-IDF vectors: an equi-join on tokens.

    Few queries' terms meet the documents' where these are (``small``); lengths are sums over all terms of a document.
    """
    idf = scratch_table(inverse_frequency(terms, n_docs).select("token", "idf"), "idf")
    d = terms.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    q = scratch_table(queries.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("tf")).join(idf, "token").select("qid", "token", "idf", (F.col("tf") * F.col("idf")).alias("qw")), "query-terms")
    norm = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    qnorm = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    met = terms.join(small(q), "token").withColumn("w", F.col("tf") * F.col("idf"))
    scores = met.groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    scores = scores.join(norm, "doc_id").join(qnorm, "qid").select("qid", "doc_id", F.round(F.col("s") / (F.col("dn") * F.col("qn")), 6).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def retrieval_cases(ranked: DataFrame, expected: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(qid, answerable, answered, first, cited) over (qid, doc_id, rank, score) and expected (qid, doc_id).

    A query without a score of ``least`` abstains; ``first`` is the rank of its first expected document, ``cited`` whether that is 1.
    """
    hit = ranked.join(expected.distinct(), ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    answerable = expected.select("qid").distinct().withColumn("answerable", F.lit(True))
    top = ranked.groupBy("qid").agg((F.max("score") >= least).alias("answered"))
    each = queries.select("qid").join(answerable, "qid", "left").join(top, "qid", "left").join(hit, "qid", "left")
    no = F.lit(False)
    return each.select("qid", F.coalesce("answerable", no).alias("answerable"), F.coalesce("answered", no).alias("answered"), "first", F.coalesce(F.col("first") == 1, no).alias("cited"))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """Recall, MRR, citation precision, and abstention precision, recall and F1 of ``retrieval_cases``."""
    answerable, abstained = F.col("answerable"), ~F.col("answered")
    sums = retrieval_cases(ranked, expected, queries, least).agg(
        F.avg(F.when(answerable, F.col("first").isNotNull().cast("double"))).alias("recall"),
        F.avg(F.when(answerable, F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"),
        F.avg(F.when(answerable & F.col("answered"), F.col("cited").cast("double"))).alias("citation_precision"),
        F.count_if(abstained & ~answerable).alias("tp"), F.count_if(abstained).alias("n_abstained"), F.count_if(~answerable).alias("n_should"),
    )
    precision, recall = (F.col("tp") / F.greatest(F.col(n), F.lit(1)) for n in ("n_abstained", "n_should"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(0.0)
    named = {"recall": F.col("recall"), "mrr": F.col("mrr"), "citation_precision": F.col("citation_precision"), "abstention_precision": precision, "abstention_recall": recall, "abstention_f1": f1}
    return sums.select(*(F.round(c, 6).alias(k) for k, c in named.items()))


#: The sketch's share of ranks that it may be off by is 1 / ACCURACY.
ACCURACY = 10_000


def nearest_ranks(values: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, share, percentile): the value of rank ceil(n * share) of each key's sorted values, exactly.

    A sketch of each key brackets the rank; a second pass counts what lies below the bracket and the values inside it, and
    only these are looked at in order. A key with a third of all rows is partial aggregates in both passes, and a sorted
    bracket of about 4 / ACCURACY of its values at most in between. Nulls don't count, a key without values has no row;
    null keys are one. A share of 0 is the least value.
    """
    known = values.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    around = [min(1.0, max(0.0, s + d / ACCURACY)) for s in shares for d in (-2, 2)]
    sketch = known.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", around, ACCURACY).alias("at"), F.min("v").alias("least"), F.max("v").alias("most"))
    ends = lambda i, s: (F.col("least") if s * ACCURACY <= 2 else F.col("at")[2 * i], F.col("most") if (1 - s) * ACCURACY <= 2 else F.col("at")[2 * i + 1])
    brackets = F.array(*(F.struct(F.lit(s).alias("share"), lo.alias("lo"), hi.alias("hi"), F.greatest(F.lit(1), F.ceil(F.col("n") * s - 1e-9)).alias("rank")) for i, s in enumerate(shares) for lo, hi in [ends(i, s)]))
    brackets = scratch_table(sketch.select(F.col("k").alias("__k"), F.explode(brackets).alias("b")).select("__k", "b.*"), "brackets")
    met = known.join(brackets, F.equal_null(F.col("k"), F.col("__k"))).filter(F.col("v") <= F.col("hi"))
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))  # null stands for all below
    counts = met.groupBy("__k", "share", "rank", inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.partitionBy("__k", "share").orderBy(F.asc_nulls_first("v")))
    found = counts.withColumn("seen", running).filter(F.col("v").isNotNull() & (F.col("seen") >= F.col("rank"))).groupBy("__k", "share").agg(F.min("v").alias("percentile"))
    return found.select(F.col("__k").alias(key), "share", "percentile")


def nearest_rank(values: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, percentile): see ``nearest_ranks``."""
    return nearest_ranks(values, key, value, [q]).select(key, "percentile")


def golden_gate(cases: DataFrame, grounded: str, duplicate: str, valid: str) -> DataFrame:
    """Ratios of reviewed cases, and whether they meet the gate: .95 grounded, .02 duplicates, .05 invalid."""
    ratios = cases.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(a) for c, a in ((grounded, "groundedness"), (duplicate, "duplicates"))), F.round(1 - F.avg(F.col(valid).cast("double")), 6).alias("invalid"))
    return ratios.withColumn("passes", (F.col("n") >= 20) & (F.col("groundedness") >= 0.95) & (F.col("duplicates") <= 0.02) & (F.col("invalid") <= 0.05))
