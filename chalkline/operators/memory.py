"""Learner memory: bounded windows and recall, rolling summaries, extraction and promotion of facts."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.operators.folds import ordered_fold

MAX_TURNS, MAX_TURN_TOKENS, MAX_FACTS, MAX_FACT_TOKENS, MAX_SUMMARY_TOKENS = 12, 1200, 8, 350, 500


def recent_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", most: int = MAX_TURNS, tokens: int = MAX_TURN_TOKENS) -> DataFrame:
    """The newest turns within both bounds, up to the first that overflows."""
    newest = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = turns.withColumn("used", F.sum(X.token_estimate(F.col(text))).over(newest)).withColumn("back", F.row_number().over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return marked.filter((F.col("used") <= tokens) & (F.col("back") <= most))


def recall_score(similarity: Column, importance: Column, confidence: Column, age_days: Column, pinned: Column) -> Column:
    age = F.greatest(age_days, F.lit(0.0))
    return F.when(pinned, 1.0).otherwise(0.0) + 0.35 * similarity + 0.3 * importance + 0.2 * confidence * F.exp(-age / 180) + 0.15 * F.exp(-age / 90)


def bounded_recall(facts: DataFrame, key: str, order: list[str], tokens: str = "tokens", most: int = MAX_FACTS, budget: int = MAX_FACT_TOKENS) -> DataFrame:
    """Greedy choice by ``order`` (sorted ascending): a fact that doesn't fit is skipped, later ones may still fit.

    Not a prefix of the order, so the facts of a key are folded as they come in order, and none is kept. Equal ones come by
    fact_id; null tokens count nothing.
    """
    rows = facts.select(key, *order, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("__t"), F.col("fact_id").cast("long").alias("__id"))

    def step(state: dict, row: dict) -> list[tuple]:
        if state["n"] >= most or state["used"] + row["__t"] > budget:
            return []
        state["n"] += 1
        state["used"] += row["__t"]
        return [(state["n"] - 1, row["__id"])]

    return ordered_fold(rows, [key], [*(F.col(c) for c in order), F.col("__id")], "place bigint, fact_id bigint", lambda: {"n": 0, "used": 0}, step)


def rolling_summary(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct lines of who said what, in order, cut to the last tokens of the budget."""
    line = F.concat(F.when(F.col(role) == "user", "Learner: ").otherwise("Tutor: "), X.bounded(F.col(text), 80))
    lines = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"))
    whole = F.array_join(F.array_distinct(F.col("ls.l")), "\n")
    return lines.select(key, X.bounded(whole, MAX_SUMMARY_TOKENS, tail=True).alias("summary"))


# What a learner says that states a fact, by kind, and what asks for one to be kept.
EXPLICIT = r"i prefer|please answer|my goal|i am (?:a )?(?:beginner|advanced)|step[- ]by[- ]step|remember that|我希望|请用|我的目标|我是初学者|逐步|记住"
LANGUAGES = (("请用|用中文|in chinese|chinese response", "chinese"), ("用英文|in english|english response", "english"), ("中英|bilingual", "bilingual"))
STYLES = (("逐步|一步一步|step[- ]by[- ]step", "step_by_step"), ("简洁|concise|brief answers?", "concise"))
BEGINNER = "我是初学者|i am (?:a )?beginner|i'm (?:a )?beginner"
GOAL = r"(?i)(?:my goal is|我的目标是)\s*[:：]?\s*([^。.!?]{3,160})"
# Values that need no words of the evidence; types of short life, and days.
CANONICAL = ("chinese", "english", "bilingual", "concise", "step_by_step", "detailed", "beginner", "advanced")
SHORT_LIVED, SHORT_DAYS, LONG_DAYS = ("misconception", "mastery_signal"), 90, 365
SAME_VALUE = 0.9


def extract_facts(turns: DataFrame, text: str = "text", number: str = "n", interval: int = 2) -> DataFrame:
    """(fact_key, value) that a learner's turn states by rule; only every ``interval``-th turn, or explicit ones."""
    short = X.compact(F.col(text))
    low = F.lower(short)
    has = lambda pattern: F.rlike(low, F.lit(pattern))
    first = lambda rules: F.coalesce(*(F.when(has(pattern), value) for pattern, value in rules))
    goal = F.nullif(F.trim(F.regexp_extract(short, GOAL, 1)), F.lit(""))
    stated = {"response_language": first(LANGUAGES), "explanation_style": first(STYLES), "self_reported_level": F.when(has(BEGINNER), "beginner"), "primary_learning_goal": goal}
    facts = F.array(*(F.struct(F.lit(k).alias("fact_key"), v.alias("value")) for k, v in stated.items()))
    heard = turns.filter(~X.is_sensitive(short) & (has(EXPLICIT) | ((F.length(short) >= 8) & (F.col(number) % interval == 0))))
    return heard.select("*", F.explode(facts).alias("f")).filter("f.value IS NOT NULL").select(*turns.columns, "f.fact_key", "f.value")


def candidate_reason() -> Column:
    """Why a candidate (turn_id, course_id, value and the expected ones, evidence) is no fact: scope, sensitive or unsupported; else null."""
    value, evidence = F.col("value"), F.lower(X.compact(F.col("evidence")))
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"(?U)([\w\u3400-\u9fff]+)"), F.lit(1))), lambda t: F.length(t) > 1)
    supported = (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(evidence, t)) | value.isin(*CANONICAL)
    scope = (F.col("turn_id") == F.col("expected_turn_id")) & (F.col("course_id") == F.col("expected_course_id"))
    return F.when(~scope, "scope").when(X.is_sensitive(value) | X.is_sensitive(F.col("evidence")), "sensitive").when(~supported, "unsupported")


def expires_at(kind: Column, confirmed: Column) -> Column:
    """Epoch seconds at which a fact confirmed then expires."""
    return confirmed + F.when(kind.isin(*SHORT_LIVED), SHORT_DAYS).otherwise(LONG_DAYS) * 86400


def promote(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(keys, fact_no, value, status, evidence, confidence): the facts that a key's candidates (value, confidence, turn) make, in order.

    A candidate as similar as SAME_VALUE to the active fact confirms it: its turn joins the evidence, and the higher
    confidence stays. Another value makes both conflicted, and none is active then; without an active fact it becomes one.
    """

    def step(facts: list[dict], row: dict) -> Iterable[tuple]:
        active = facts[-1] if facts and facts[-1]["status"] == "active" else None
        if active is not None and X.text_similarity(active["value"], row["value"]) >= SAME_VALUE:
            active["turns"].add(row["turn"])
            active["confidence"] = max(active["confidence"], row["confidence"])
            return ()
        if active is not None:
            active["status"] = "conflicted"
        facts.append({"value": row["value"], "turns": {row["turn"]}, "confidence": row["confidence"], "status": "active" if active is None else "conflicted"})
        return ()

    def finish(facts: list[dict]) -> Iterable[tuple]:
        return [(n, f["value"], f["status"], len(f["turns"]), f["confidence"]) for n, f in enumerate(facts, 1)]

    return ordered_fold(candidates, keys, order, "fact_no bigint, value string, status string, evidence bigint, confidence double", list, step, finish)


def lineage_state(updates: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """State of each lineage after its updates (at, action: state, correct, pin, unpin or delete; value).

    A correction supersedes the value before; a pin clears the expiry for good; a deletion ends the lineage, later
    updates find nothing and are ignored. Maxima over the updates, so no order of rows is kept.
    """
    at = F.col(order)
    ended = updates.groupBy(*keys).agg(F.min(F.when(F.col("action") == "delete", at)).alias("deleted_at"))
    live = updates.join(ended, keys).filter(F.col("deleted_at").isNull() | (at <= F.col("deleted_at")))
    of = lambda *actions: F.col("action").isin(*actions)
    last = lambda value, cond: F.max(F.when(cond, F.struct(at.alias("at"), value.alias("v"))))["v"]
    return live.groupBy(*keys).agg(
        last(F.col("value"), of("state", "correct")).alias("value"), F.count_if(of("correct")).alias("superseded"), F.coalesce(last(F.col("action") == "pin", of("pin", "unpin")), F.lit(False)).alias("pinned"),
        F.bool_or(of("pin")).alias("keeps"), F.when(F.max("deleted_at").isNotNull(), "tombstoned").otherwise("active").alias("status"),
    )


def purge(facts: DataFrame, summaries: DataFrame, keys: list[str], owner: str) -> tuple[DataFrame, DataFrame]:
    """(facts without tombstoned lineages, summaries emptied for the owners of purged ones)."""
    gone = facts.filter("status = 'tombstoned'").select(*dict.fromkeys([*keys, owner])).distinct()
    owners = gone.select(owner).distinct().withColumn("__purged", F.lit(True))
    emptied = summaries.join(owners, owner, "left").withColumn("summary", F.when(F.col("__purged").isNull(), F.col("summary"))).drop("__purged")
    return facts.join(gone.select(*keys), keys, "left_anti"), emptied


def consented(rows: DataFrame, settings: DataFrame, keys: list[str], flag: str = "enabled") -> DataFrame:
    """Rows whose owner has switched memory on; without a setting it is off."""
    return rows.join(settings.filter(F.col(flag)).select(*keys), keys, "left_semi")


def session_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", last: int = 64) -> DataFrame:
    """(key, turn, place): the last turns of a session in ascending order, with the number of a learner's turns in all of it."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    counts = turns.groupBy(key).agg(F.count_if(F.col("role") == "user").alias("user_turns"))
    kept = turns.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last)
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    return kept.select(key, order, place.alias("place")).join(counts, key)


def latest_state(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key; tombstones go."""
    last = events.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return last.filter("status <> 'tombstoned'")
