"""Queues, retries, rate limits and service telemetry over an event table."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.time import epoch_micros, epoch_seconds
from chalkline.operators.folds import ordered_fold
from chalkline.operators.machines import run_machine


def queue_depth(events: DataFrame, topic: str, processed: Column, dead: Column) -> DataFrame:
    return events.groupBy(topic).agg(F.count_if(~processed & ~dead).alias("pending"), F.count_if(dead).alias("dead_letter"))


def retry_state(tries: DataFrame, key: str, failed: Column, limit: int = 5) -> DataFrame:
    """(failures, state): dead_letter after ``limit`` failures, done after a success, else queued."""
    counts = tries.groupBy(key).agg(F.count_if(failed).alias("failures"), F.count_if(~failed).alias("successes"))
    state = F.when(F.col("failures") >= limit, "dead_letter").when(F.col("successes") > 0, "done").otherwise("queued")
    return counts.select(key, "failures", state.alias("state"))


def first_delivery(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first event of each idempotency key."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def over_limit(hits: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """(key, window_start, hits): windows in which a key hit more than ``limit`` times; a window starts at the first hit after the last one."""

    def step(state: dict, row: dict) -> list[tuple]:
        closed = []
        if state and row["__at"] >= state["start"] + seconds:
            closed = [(state["start"], state["n"])] if state["n"] > limit else []
            state.clear()
        if not state:
            state.update(start=row["__at"], n=0)
        state["n"] += 1
        return closed

    rows = hits.select(key, epoch_seconds(F.col(ts)).alias("__at"))
    return ordered_fold(rows, [key], [F.col("__at")], "window_start bigint, hits bigint", dict, step, lambda state: [(state["start"], state["n"])] if state and state["n"] > limit else [])


def circuit(calls: DataFrame, key: str, at: str, order: list[str], failed: str, threshold: int = 3, reset: int = 30) -> DataFrame:
    """(key, call, outcome) of calls (call_id): ok, failed, or rejected while the circuit is open.

    It opens with the ``threshold``-th consecutive failure and lets calls through again, with the count at zero, when ``reset``
    seconds have passed.
    """

    def step(state: dict, row: dict) -> list[tuple]:
        if state.get("opened") is not None:
            if row[at] - state["opened"] < reset:
                return [(row["call_id"], "rejected")]
            state.clear()
        if not row[failed]:
            state.clear()
            return [(row["call_id"], "ok")]
        state["failures"] = state.get("failures", 0) + 1
        if state["failures"] >= threshold:
            state["opened"] = row[at]
        return [(row["call_id"], "failed")]

    return ordered_fold(calls.select(key, "call_id", at, failed), [key], [F.col(c) for c in order], "call_id bigint, outcome string", dict, step)


def job_states(jobs: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """(job_id, status, closes_event) of jobs (job_id, submitted, count) at ``now`` by their events (job_id, at, action: ready, cancel).

    The first end counts. A job has five minutes, eight if it asks for more than ten; what comes later than that finds
    it failed. A cancelled or failed job closes its queued event.
    """
    deadline = F.col("submitted") + F.when(F.col("count") > 10, 480).otherwise(300)
    ends = events.groupBy("job_id").agg(F.min(F.struct("at", "action")).alias("e"))
    joined = jobs.join(ends, "job_id", "left").withColumn("deadline", deadline)
    status = F.when(F.col("e.at") < F.col("deadline"), F.when(F.col("e.action") == "cancel", "cancelled").otherwise("ready")).when(F.lit(now) >= F.col("deadline"), "failed").otherwise("running")
    return joined.select("job_id", status.alias("status"), status.isin("cancelled", "failed").alias("closes_event"))


#: Attempts after which a job isn't tried again; seconds that it has, and that one of more than ten items has.
MAX_ATTEMPTS = 5
DEADLINE, LONG_DEADLINE, LONG_COUNT = 300, 480, 10
_ENDED = ("succeeded", "failed", "dead_letter", "cancelled")


@dataclass
class Job:
    """What is known of a job. Times are seconds; ``deadline`` is -1 before the submission."""

    status: str = "unknown"
    attempts: int = 0
    deadline: int = -1

    def ended(self) -> bool:
        return self.status in _ENDED

    def until(self, now: int) -> list[tuple]:
        """The change that comes with the time alone: a job that hasn't ended by its deadline fails."""
        if self.ended() or not 0 <= self.deadline <= now:
            return []
        self.status = "failed"
        return [(self.deadline, self.status, self.attempts, "deadline")]

    def step(self, at: int, kind: str, retryable: bool, count: int, max_attempts: int) -> list[tuple]:
        """The changes (at, status, attempts, reason) of an event; none for an ended job or one that wasn't submitted."""
        out = self.until(at)
        if self.ended() or (self.status == "unknown") != (kind == "submitted"):
            return out
        reason = None
        if kind == "submitted":
            self.status, self.deadline = "queued", at + (LONG_DEADLINE if count > LONG_COUNT else DEADLINE)
        elif kind == "failed":
            self.attempts += 1
            self.status, reason = ("failed", "fatal") if not retryable else ("dead_letter", "attempts") if self.attempts >= max_attempts else ("queued", "retry")
        elif kind in ("succeeded", "cancelled"):
            self.status = kind
        else:
            return out
        return [*out, (at, self.status, self.attempts, reason)]


def job_outcomes(events: DataFrame, now: int, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(job_id, at, status, attempts, reason): the last change of every submitted job by ``now`` (seconds).

    events: job_id, event_id, at (seconds), kind (submitted, failed, succeeded, cancelled), retryable, count. A retryable
    failure queues the job again until ``max_attempts`` failures make it a dead letter; a fatal one fails it at once, as
    does its deadline (which comes before events of the same time). Ended jobs stay as they are; an event id counts once
    (its first row), and events before the submission don't count.
    """
    known = events.filter((F.col("at") <= now) & F.col("job_id").isNotNull())
    once = known.groupBy("job_id", "event_id").agg(F.min(F.struct("at", "kind", F.coalesce("retryable", F.lit(False)).alias("retryable"), F.coalesce("count", F.lit(0)).alias("count"))).alias("e"))

    def step(state: dict, row: dict) -> list[tuple]:
        job = state.setdefault("job", Job())
        for change in job.step(row["at"], row["kind"], row["retryable"], row["count"], max_attempts):
            state["last"] = change
        return []

    def finish(state: dict) -> list[tuple]:
        last = [*([state["last"]] if "last" in state else []), *state["job"].until(now)]
        return last[-1:]

    return ordered_fold(once.select("job_id", "event_id", "e.*"), ["job_id"], [F.col("at"), F.col("event_id")], "at bigint, status string, attempts int, reason string", dict, step, finish)


def oldest_unclaimed(queue: DataFrame, topic: str, order: list[str], limit: int) -> DataFrame:
    """(topic, place, ...): the ``limit`` oldest unclaimed events of each topic, first in first out.

    Each task keeps ``limit`` rows a topic before they are dealt by topic, so a topic with a third of all rows costs no more.
    """
    place = F.row_number().over(Window.partitionBy(topic).orderBy(*order))
    oldest = queue.filter("claimed_at IS NULL").withColumn("place", place).filter(F.col("place") <= limit)
    return oldest.withColumn("place", F.col("place").cast("long"))


def trace_states(events: DataFrame, trace: str, order: list[str], state: str, terminal: tuple[str, ...] = ("completed", "failed", "cancelled", "abstained")) -> DataFrame:
    """(trace, state, n): the first terminal state of each trace, else open, and the events up to then (all of an open one).

    Two aggregates, so a trace of any length is a row a task; null traces are one.
    """
    at = F.struct(*order)
    ends = events.filter(F.col(state).isin(*terminal)).groupBy(trace).agg(F.min(F.struct(*order, F.col(state).alias("s"))).alias("f"))
    ends = ends.select(F.col(trace).alias("__t"), F.struct(*(F.col("f")[o].alias(o) for o in order)).alias("__end"), F.col("f.s").alias("__s"))
    joined = events.join(ends, F.equal_null(F.col(trace), F.col("__t")), "left")
    counted = joined.groupBy(trace).agg(F.max("__s").alias("state"), F.count_if(F.coalesce(at <= F.col("__end"), F.lit(True))).alias("n"))
    return counted.select(trace, F.coalesce("state", F.lit("open")).alias("state"), "n")


def error_ratio(events: DataFrame, ts: str, failed: Column, seconds: int) -> DataFrame:
    window = (F.floor(epoch_seconds(F.col(ts)) / seconds) * seconds).alias("window_start")
    return events.groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors"), F.round(F.avg(failed.cast("double")), 6).alias("ratio"))


def histogram_quantile(values: DataFrame, key: str, value: str, bounds: list[float], q: float) -> DataFrame:
    """The quantile by linear interpolation within the bucket that holds it; the last bound where it lies above all."""
    counts = values.groupBy(key).agg(*(F.count_if(F.col(value) <= b).cast("double").alias(f"c{i}") for i, b in enumerate(bounds)), F.count(F.lit(1)).alias("n"))
    rank, found = F.lit(q) * F.col("n"), F.lit(None).cast("double")
    for i, b in reversed(list(enumerate(bounds))):
        low, before = (bounds[i - 1], F.col(f"c{i - 1}")) if i else (0.0, F.lit(0.0))
        inside = F.lit(low) + (F.lit(b - low)) * (rank - before) / F.nullif(F.col(f"c{i}") - before, F.lit(0.0))
        found = F.when(F.col(f"c{i}") >= rank, inside).otherwise(found)
    return counts.select(key, F.round(F.coalesce(found, F.lit(bounds[-1])), 6).alias("quantile"))


def sessions(events: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """Runs of a key's events without a gap of more than ``gap`` seconds."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    new = F.coalesce(epoch_micros(F.col(ts)) - epoch_micros(F.lag(ts).over(order)) > gap * 1_000_000, F.lit(True))
    marked = events.withColumn("session", F.sum(new.cast("long")).over(order))
    return marked.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n_events"), epoch_seconds(F.min(ts)).alias("first_s"), epoch_seconds(F.max(ts)).alias("last_s"))


def invalid_transitions(events: DataFrame, key: str, order: list[str], status: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """The events that the guard refuses, with ``from``, the state that the key was and stays in.

    A key's first known status is taken; from then on an event moves it only along an ``allowed`` pair. A status that no
    pair has is refused at any time (``from`` is null before the first).
    """
    names = sorted({s for pair in allowed for s in pair})
    number = {s: i for i, s in enumerate(names, 1)}
    moves = {s: {0: number[s]} | {number[a]: number[b] for a, b in allowed if b == s} for s in names}
    run = run_machine(events, [key], order, status, moves, len(names) + 1)
    before = F.when(F.col("state_before") > 0, F.element_at(F.array(*map(F.lit, names)), F.greatest("state_before", F.lit(1))))
    pair = F.concat(F.col("from"), F.lit(">"), F.col(status))
    ok = F.coalesce(pair.isin([f"{a}>{b}" for a, b in allowed]) | (F.col("from").isNull() & F.col(status).isin(names)), F.lit(False))
    return run.withColumn("from", before).filter(~ok).drop("state_before", "state_after")


def failure_islands(events: DataFrame, key: str, order: list[str], failed: Column, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more consecutive failures of a key, as a circuit breaker would open on."""
    window = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("failed", failed).withColumn("island", F.sum((~failed).cast("long")).over(window))
    return marked.filter("failed").groupBy(key, "island").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= least)


def retained(events: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return events.filter(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))
