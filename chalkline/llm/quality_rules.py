"""Quality rules with verdicts on hosts.

Every document is measured in one vectorised pass; its rule failures are then summed by host. The prior of a rule is a
beta distribution fitted to the hosts' failures as beta-binomial counts, by moments weighted with documents, so the
noise of small hosts isn't taken for difference between hosts. A host's rate is shrunk towards it, and the host is
rejected for a rule if its posterior rate lies above a limit by ``certainty`` standard deviations: a host with few
documents needs more evidence than a large one. The limit is ``max_host_rate``, or ``above_prior`` above the corpus
rate where that is more, so a rule that all hosts fail alike rejects none. Verdicts are joined back to the documents.

Cases: a null or empty text has no words and fails the rule on length; a very long text is measured whole, in a chunk
of its own; a null host is a host of its own, compared null-safely; ties don't occur (a host at the limit stays);
repeated rows each count and each get a verdict; an empty table gives an empty result; columns of the input other
than those named are not read, and the three result columns have names to choose, for tables that have them.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm import columnar as C
from chalkline.llm.frames import pick, with_text
from chalkline.sources.scratch import scratch_table

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Rejected hosts, in bytes, that are sent to all tasks at most.
BROADCAST_BYTES = 8 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRules:
    """Limits of a document's rules, and the shrunk failure rate above which a host is rejected for a rule."""

    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbols_per_char: float = 0.1
    max_dup_line_share: float = 0.3
    max_host_rate: float = 0.3
    above_prior: float = 0.25
    certainty: float = 2.0
    #: The prior counts as so many documents at least and at most.
    prior_strength: tuple[float, float] = (1.0, 1e4)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


_SYMBOL = C.byte_table(SYMBOLS)
_WORD_CHAR = C.NOT_WHITE & ((np.arange(256) & 0xC0) != 0x80)


def measure(chunk: C.Chunk) -> np.ndarray:
    """COUNTS of each text, a column each."""
    n = len(chunk)
    out = np.zeros((len(COUNTS), n), np.int64)
    starts, ends, of = C.runs(chunk, C.NOT_WHITE)
    out[0] = np.bincount(of, minlength=n)
    out[1] = _per_text(_WORD_CHAR[chunk.data], chunk.offsets)
    out[2] = _per_text(_SYMBOL[chunk.data], chunk.offsets)
    for i in range(n):
        lines = [x for x in chunk.text(i).split(b"\n") if x.strip()]
        out[3, i], out[4, i] = len(lines), len(lines) - len(set(lines))
    if len(starts) >= WINDOW:
        grams = C.gram_hashes(C.span_hashes(C.prefix_sums(chunk.data), starts, ends), WINDOW)
        whole = of[: len(grams)] == of[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        keys = C.mix(grams[at] + C.mix(of[at].astype(np.uint64) + np.uint64(1)))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            hits = at[np.isin(keys, twice)]
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, hits, 1)
            np.add.at(change, hits + WINDOW, -1)
            out[5] = np.bincount(of[np.cumsum(change[:-1]) > 0], minlength=n)
    return out


def rule_counts(docs: DataFrame, keep: list[str], text: str = "text", out: str = "rules") -> DataFrame:
    """The columns ``keep`` of every row with a struct ``out`` of COUNTS."""
    read, name = with_text(docs, keep, text)
    schema = T.StructType([*pick(read, *keep).schema, T.StructField(out, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(c) for c in C.text_chunks(batch.column(name))]
            counts = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
            struct = pa.StructArray.from_arrays([pa.array(x) for x in counts], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], struct], names=[*keep, out])

    return read.mapInArrow(run, schema)


def base_failed(rules: str, limits: HostRules) -> F.Column:
    """The rules that reject a document whatever its host."""
    r = F.col(rules)
    return (r["n_words"] < limits.min_words) | (100 * r["n_repeat_words"] > limits.max_repeat_pct * r["n_words"])


def failures(rules: str, limits: HostRules) -> dict[str, F.Column]:
    """All rules, as a boolean each: does the document fail it?"""
    r = F.col(rules)
    return {
        "short": r["n_words"] < limits.min_words,
        "repeats": 100 * r["n_repeat_words"] > limits.max_repeat_pct * r["n_words"],
        "symbols": r["n_symbols"] > limits.max_symbols_per_char * r["word_chars"],
        "dup_lines": r["n_dup_lines"] > limits.max_dup_line_share * r["n_lines"],
    }


def host_verdicts(measured: DataFrame, host: str, rules: str, limits: HostRules) -> DataFrame:
    """A row for each host: documents, failure rates raw and shrunk, and ``host_ok``; a written table.

    ``measured`` should be a written table, as it is read twice. The hosts are summed with partial aggregates, so
    a host with a third of all rows sends one row a task.
    """
    failed = failures(rules, limits)
    counted = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *(F.count_if(c).alias(f"n_{k}") for k, c in failed.items()))
    hosts = scratch_table(counted, "host-counts")
    n = F.col("n_docs")
    sums = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n_docs").alias("n"), F.sum(n.cast("double") * n).alias("nn"), *(f for k in failed for f in (F.sum(f"n_{k}").alias(f"k_{k}"), F.sum(F.col(f"n_{k}").cast("double") * F.col(f"n_{k}") / n).alias(f"kk_{k}")))).first()
    ok = F.lit(True)
    for k in failed:
        mean, strength = beta_prior(sums["h"], sums["n"] or 0, sums["nn"] or 0.0, sums[f"k_{k}"] or 0, sums[f"kk_{k}"] or 0.0, limits.prior_strength)
        total = n + F.lit(strength)
        shrunk = (F.col(f"n_{k}") + F.lit(mean * strength)) / total
        limit = max(limits.max_host_rate, mean + limits.above_prior)
        hosts = hosts.withColumn(f"rate_{k}", F.col(f"n_{k}") / n).withColumn(f"shrunk_{k}", shrunk)
        ok = ok & (shrunk - limits.certainty * F.sqrt(shrunk * (1 - shrunk) / (total + 1)) <= limit)
    return scratch_table(hosts.withColumn("host_ok", ok), "hosts")


def beta_prior(hosts: int, n: int, nn: float, k: int, kk: float, bounds: tuple[float, float]) -> tuple[float, float]:
    """(mean, strength) of the beta prior from sums over hosts of documents, their squares, failures, failures squared over documents.

    The moments of beta-binomial counts, weighted by documents: what the rates vary beyond binomial noise is the
    share rho of the prior's variance, and 1 / rho - 1 its strength.
    """
    low, high = bounds
    if not n:
        return 0.0, high
    mean = k / n
    noise, spread = hosts - 1, n - nn / n
    if mean <= 0 or mean >= 1 or spread <= noise:
        return mean, high
    rho = ((kk - n * mean * mean) / (mean * (1 - mean)) - noise) / (spread - noise)
    return mean, high if rho <= 1 / (1 + high) else max(low, 1 / rho - 1)


def apply_rules(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", limits: HostRules = HostRules(), out: str = "rules", failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """``keep`` of every document, the struct ``out`` of its counts, ``base_failed`` and ``kept`` (names to choose, where ``keep`` has them).

    The measured rows are written once (with the text, where that is one of ``keep``), so no text is measured twice.
    Rejected hosts are joined back: broadcast up to BROADCAST_BYTES, which is checked, and by a shuffle join beyond,
    where Spark splits hot hosts.
    """
    measured = scratch_table(rule_counts(docs, list(dict.fromkeys([*keep, host])), text, out), "rules")
    verdicts = host_verdicts(measured, host, out, limits).filter("NOT host_ok").select(F.col("host").alias("__host"), F.col("host_ok").alias("__ok"))
    size = verdicts.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("__host"), F.lit(0)) + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        verdicts = F.broadcast(verdicts)
    joined = measured.join(verdicts, measured[f"`{host}`"].eqNullSafe(verdicts["__host"]), "left")
    base = base_failed(out, limits)
    return joined.select(*(F.col(f"`{k}`") for k in keep), out, base.alias(failed), (~base & F.coalesce("__ok", F.lit(True))).alias(kept))
