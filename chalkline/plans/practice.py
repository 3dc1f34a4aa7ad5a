"""Practice queries: ``orders`` are sets, ``lineitem`` exercises and attempts, ``customer`` learners."""

from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.functions import text as X
from chalkline.functions.time import epoch_micros, epoch_seconds
from chalkline.operators import practice as P
from chalkline.operators.components import connected_components
from chalkline.sources.tables import spread, table


def _exercises(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("exercise_id"), F.min("l_linenumber").over(_same()).cast("long").alias("ordinal")).distinct()


def _same():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey", "l_partkey")


def _attempts(spark, d):
    rows = table(spark, d, "lineitem")
    correct = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    return rows.select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("exercise_id"), F.col("l_linenumber").alias("attempt_number"), F.when(F.col("l_tax") > 0.07, "give_up").otherwise("submit").alias("action"), correct.alias("correct"), epoch_seconds("l_shipdate").alias("created_at"))


def set_progress(spark, d):
    return P.set_progress(_exercises(spark, d), _attempts(spark, d))


def _sets(spark, d):
    return set_progress(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 100).alias("plan_id")), "set_id")


def plan_rollup(spark, d):
    return P.plan_rollup(_sets(spark, d))


def mastery_band(spark, d):
    return set_progress(spark, d).select("set_id", P.mastery_band(F.col("correct"), F.col("completed")).alias("band"))


def resume_order(spark, d):
    sets = _sets(spark, d)
    cursors = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("set_id"))
    return P.resume_order(sets, cursors).select("user_id", "set_id", "place")


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"), "user_id", (F.col("event_id") % 3).alias("exercise_id"), epoch_micros("ts").alias("at"), (F.col("event_id") % 50).alias("key"), F.floor(F.col("value") / 400).cast("long").alias("digest"), F.when(F.col("event_type") == "error", "give_up").otherwise("submit").alias("action"), (F.col("event_type") == "purchase").alias("correct"))


def attempt_replay(spark, d):
    return P.replay_attempts(_requests(spark, d)).select("request_id", "outcome")


def rubric_score(spark, d):
    w = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("x")))).alias("r"))
    score, passes = P.rubric_score(F.transform("r", lambda x: x["w"]), F.transform("r", lambda x: x["x"] / 100000.0), F.lit(0.5))
    return w.select("l_orderkey", score.alias("score"), passes.alias("passes"))


def objective_grading(spark, d):
    ship(spark)
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "fill_blank").when(F.col("p_size") % 3 == 1, "multiple_choice").otherwise("short_answer").alias("kind"), F.upper("p_type").alias("answer"), F.concat(F.lit(" "), F.col("p_type")).alias("expected"))
    graded = P.grade(F.col("kind"), F.col("answer"), F.col("expected"), F.array(F.col("expected"), F.lit("small")))
    return rows.select("p_partkey", "kind", graded.alias("correct"))


def release_policy(spark, d):
    rows = _attempts(spark, d).groupBy("set_id", "exercise_id").agg(F.count_if(F.col("action") == "submit").alias("n"), F.bool_or(F.col("action") == "give_up").alias("gave_up"), F.bool_or(F.coalesce("correct", F.lit(False))).alias("ok"))
    return rows.select("set_id", "exercise_id", P.release_policy(F.col("n"), F.col("gave_up"), F.col("ok")).alias("shown"))


def attempt_feedback(spark, d):
    kinds, languages = F.array(*map(F.lit, P.HINTS_EN)), F.array(*map(F.lit, ("zh", "en", "bilingual")))
    of = lambda values, n: F.element_at(values, (F.col("l_partkey") % n + 1).cast("int"))
    rows = _attempts(spark, d).withColumn("l_partkey", F.col("exercise_id"))
    wrong = F.when((F.col("action") == "submit") & ~F.col("correct"), F.col("attempt_number"))
    told = P.outcome(F.col("action"), F.col("correct").isNull(), F.col("correct"))
    return rows.select("set_id", "exercise_id", "attempt_number", told.alias("outcome"), P.hint(of(kinds, 4), of(languages, 3), wrong).alias("hint"))


def objective_history_window(spark, d):
    sets = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("set_id"), epoch_seconds("o_orderdate").alias("created_at"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("objectives"))
    return P.recent_objectives(sets, 3)


def _word_sets(spark, d):
    ship(spark)
    return P.text_word_sets(spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), "text"))


def near_duplicate_pairs(spark, d):
    return P.similar_sets(_word_sets(spark, d))


def near_duplicate_groups(spark, d):
    labels = connected_components(P.similar_sets(_word_sets(spark, d), spanning=True).select("a", "b")).withColumnRenamed("node", "id")
    return _word_sets(spark, d).filter(F.size("vs") >= 3).select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def answer_ngram_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.answer_keys(F.concat_ws(" ", "p_name", F.lit("is the"), "p_type")), ",").alias("keys"))


_A = """ex AS (SELECT l_orderkey AS set_id, l_partkey AS exercise_id, min(l_linenumber)::BIGINT AS ordinal FROM lineitem GROUP BY ALL),
tries AS (SELECT l_orderkey AS set_id, l_partkey AS exercise_id, l_linenumber AS attempt_number, CASE WHEN l_tax > 0.07::DOUBLE THEN 'give_up' ELSE 'submit' END AS action,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'R' END AS correct, epoch(l_shipdate)::BIGINT AS created_at FROM lineitem)"""
_S = f"""{_A}, per AS (SELECT set_id, exercise_id, bool_or(coalesce(correct, false)) AS ok, bool_or(action = 'give_up' OR coalesce(NOT correct AND attempt_number >= 3, false)) AS closed, max(created_at) AS latest FROM tries GROUP BY ALL),
j AS (SELECT ex.*, per.set_id IS NOT NULL AS tried, coalesce(ok, false) AS ok, coalesce(ok, false) OR coalesce(closed, false) AS done, latest FROM ex LEFT JOIN per USING (set_id, exercise_id)),
s AS (SELECT set_id, count(*) AS total, count_if(tried)::BIGINT AS attempted, count_if(done)::BIGINT AS completed, count_if(ok)::BIGINT AS correct, (min({{'o': ordinal, 'e': exercise_id}}) FILTER (NOT done)).e AS next_exercise, max(latest) AS latest FROM j GROUP BY set_id),
st AS (SELECT *, CASE WHEN completed > 0 THEN round(correct / completed, 3) END AS mastery, CASE WHEN completed = total THEN 'COMPLETED' WHEN latest IS NOT NULL THEN 'IN_PROGRESS' ELSE 'NOT_STARTED' END AS status FROM s)"""

_HINTS = lambda name: "[" + ", ".join("[" + ", ".join(f"'{h}'" for h in hints) + "]" for hints in getattr(P, name).values()) + "][exercise_id % 4 + 1][w]"

QUERIES = {f.__name__: f for f in (set_progress, plan_rollup, mastery_band, resume_order, attempt_replay, rubric_score, objective_grading, release_policy, attempt_feedback, objective_history_window, near_duplicate_pairs, near_duplicate_groups, answer_ngram_keys)}

SQL = {
    "set_progress": f"WITH {_S} SELECT set_id, total, attempted, completed, correct, next_exercise, latest, mastery, status FROM st",
    "plan_rollup": f"""WITH {_S}, o AS (SELECT o_orderkey AS set_id, o_custkey % 100 AS plan_id FROM orders)
SELECT plan_id, count(*) AS n_sets, sum(total)::BIGINT AS total, sum(completed)::BIGINT AS completed, sum(correct)::BIGINT AS correct, round(sum(correct) / nullif(sum(completed), 0), 3) AS mastery, max(latest) AS latest,
CASE WHEN sum(completed) = sum(total) THEN 'COMPLETED' WHEN sum(attempted) > 0 THEN 'IN_PROGRESS' ELSE 'NOT_STARTED' END AS status FROM st JOIN o USING (set_id) GROUP BY plan_id""",
    "mastery_band": f"WITH {_S} SELECT set_id, CASE WHEN completed > 0 AND correct / completed >= 0.8 THEN 'confident' WHEN completed > 0 THEN 'developing' ELSE 'starting' END AS band FROM st",
    "resume_order": f"""WITH {_S}, o AS (SELECT o_orderkey AS set_id, o_custkey AS user_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cursor FROM orders)
SELECT user_id, set_id, row_number() OVER (PARTITION BY user_id ORDER BY (set_id = cursor) DESC, latest DESC NULLS LAST, set_id DESC) AS place FROM st JOIN o USING (set_id) WHERE status <> 'COMPLETED'""",
    "attempt_replay": """WITH r AS (SELECT event_id AS request_id, user_id, event_id % 3 AS exercise_id, epoch_us(ts) AS tm, event_id % 50 AS key, floor(value / 400)::BIGINT AS digest, event_type = 'error' AS give_up, event_type = 'purchase' AS ok FROM events),
m AS (SELECT *, first(digest) OVER k AS fd, row_number() OVER k AS n FROM r WINDOW k AS (PARTITION BY user_id, exercise_id, key ORDER BY tm, request_id)),
c AS (SELECT *, coalesce(bool_or(n = 1 AND (give_up OR ok)) OVER b, false) AS ended, coalesce(sum(CASE WHEN n = 1 AND NOT give_up THEN 1 ELSE 0 END) OVER b, 0) AS submits FROM m WINDOW b AS (PARTITION BY user_id, exercise_id ORDER BY tm, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT request_id, CASE WHEN n > 1 AND digest = fd THEN 'replay' WHEN n > 1 THEN 'conflict' WHEN ended OR submits >= 3 THEN 'closed' ELSE 'accepted' END AS outcome FROM c""",
    "rubric_score": """WITH g AS (SELECT l_orderkey, round(list_sum(list_transform(list(struct_pack(w := l_quantity, x := l_extendedprice / 100000.0::DOUBLE) ORDER BY l_linenumber), lambda r: r.w * r.x)) / sum(l_quantity), 3) AS score FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, score, score >= 0.5 AS passes FROM g""",
    "objective_grading": """WITH r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'fill_blank' WHEN 1 THEN 'multiple_choice' ELSE 'short_answer' END AS kind, upper(p_type) AS answer, ' ' || p_type AS expected FROM part)
SELECT p_partkey, kind, CASE kind WHEN 'multiple_choice' THEN answer = expected WHEN 'fill_blank' THEN lower(answer) IN (lower(trim(expected)), 'small') END AS correct FROM r""",
    "release_policy": f"""WITH {_A}, g AS (SELECT set_id, exercise_id, count_if(action = 'submit') AS n, bool_or(action = 'give_up') AS gu, bool_or(coalesce(correct, false)) AS ok FROM tries GROUP BY ALL)
SELECT set_id, exercise_id, CASE WHEN ok OR gu OR n >= 3 THEN 'solution' WHEN n >= 2 THEN 'hint_2' WHEN n = 1 THEN 'hint_1' ELSE 'none' END AS shown FROM g""",
    "attempt_feedback": f"""WITH {_A}, h AS (SELECT *, CASE WHEN action = 'submit' AND NOT correct AND attempt_number BETWEEN 1 AND 2 THEN attempt_number END AS w FROM tries),
t AS (SELECT *, {_HINTS("HINTS_ZH")} AS zh, {_HINTS("HINTS_EN")} AS en FROM h)
SELECT set_id, exercise_id, attempt_number, CASE WHEN action = 'give_up' THEN 'gave_up' WHEN correct IS NULL THEN 'provisional' WHEN correct THEN 'correct' ELSE 'incorrect' END AS outcome, CASE exercise_id % 3 WHEN 0 THEN zh WHEN 1 THEN en ELSE zh || ' / ' || en END AS hint FROM t""",
    "objective_history_window": """WITH k AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate)::BIGINT DESC, o_orderkey DESC) AS n, o_orderpriority, o_orderstatus FROM orders QUALIFY n <= 3),
u AS (SELECT key, n, 0 AS pos, o_orderpriority AS objective FROM k UNION ALL SELECT key, n, 1, o_orderstatus FROM k)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY n, pos) AS place, objective FROM u""",
    "near_duplicate_groups": """WITH RECURSIVE w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents), s AS (SELECT id, len(ws) AS n, unnest(ws) AS v FROM w WHERE len(ws) >= 3),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n + y.n) AS t FROM s x JOIN s y ON x.v = y.v AND x.id < y.id GROUP BY ALL), l AS (SELECT a, b FROM c WHERE c >= 3 AND c / (t - c) >= 0.72), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT id, least(id, coalesce((SELECT min(b) FROM r WHERE r.a = id), id)) AS component FROM w WHERE len(ws) >= 3""",
    "answer_ngram_keys": """WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' is the ' || p_type), '[a-z]+') AS ws FROM part),
g AS (SELECT p_partkey, ws, unnest(list_transform(range(2, 7), lambda n: list_transform(range(1, len(ws) - n + 2), lambda i: ws[i:i + n - 1]))) AS gs FROM t), h AS (SELECT p_partkey, unnest(gs) AS g FROM g),
k AS (SELECT p_partkey, sha256(array_to_string(g, '')) AS k FROM h WHERE length(array_to_string(g, '')) >= 6 AND len(list_filter(g, lambda x: x NOT IN ('a', 'am', 'an', 'and', 'are', 'i', 'is', 'it', 'my', 'the', 'this', 'that', 'your'))) > 0
UNION SELECT p_partkey, sha256(array_to_string(ws, '')) FROM t WHERE length(array_to_string(ws, '')) >= 8)
SELECT p_partkey, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM k WHERE k.p_partkey = t.p_partkey), '') AS keys FROM t""",
}
