"""Memory queries over ``conversations``; learners are ``customer`` rows, their facts ``orders`` and ``events``."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.functions import text as X
from chalkline.functions.time import epoch_seconds
from chalkline.operators import memory as M
from chalkline.sources.tables import spread, table


def recent_turn_window(spark, d):
    return M.recent_turns(table(spark, d, "conversations"), tokens=300).select("conv_id", "turn", "back", F.col("used").cast("long").alias("used"))


def recall_decay_score(spark, d):
    c = table(spark, d, "customer")
    score = M.recall_score(F.lit(0.5), F.col("c_acctbal") / 10000.0, F.lit(0.9), (F.col("c_custkey") % 400).cast("double"), F.col("c_custkey") % 50 == 0)
    return c.select("c_custkey", F.round(score, 6).alias("score"))


def bounded_recall_greedy(spark, d):
    ship(spark)
    o = table(spark, d, "orders")
    facts = o.select("o_custkey", F.col("o_orderkey").alias("fact_id"), F.negative("o_totalprice").alias("rank_by"), (F.col("o_orderkey") * 37 % 190 + 5).alias("tokens"))
    return M.bounded_recall(facts, "o_custkey", ["rank_by", "fact_id"])


def rolling_summary(spark, d):
    return M.rolling_summary(table(spark, d, "conversations")).select("conv_id", F.md5("summary").alias("summary_md5"), F.length("summary").cast("long").alias("chars"))


def sensitive_screen(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.is_sensitive(F.col("text")).alias("sensitive"))


_SAID = [". please answer in chinese", ". My goal is to read ", ". I am a beginner, step by step please", "", ". brief answers and bilingual text"]


def fact_extraction(spark, d):
    word = F.regexp_extract(F.lower("text"), "([a-z]{3,})", 1)
    n = (F.col("conv_id") * 7 + F.col("turn")) % len(_SAID)
    said = F.concat("text", F.element_at(F.array(*map(F.lit, _SAID)), (n + 1).cast("int")), F.when(n == 1, word).otherwise(""))
    turns = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", said.alias("text"), F.col("turn").alias("n"))
    return M.extract_facts(turns).select("conv_id", "turn", "fact_key", "value")


def _candidates(spark, d):
    value = F.when(F.col("event_id") % 5 == 0, F.concat(F.upper("event_type"), F.lit("  "))).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("user_id", (F.col("event_id") % 2).alias("fact_key"), value.alias("value"), "event_id", (F.col("event_id") % 7).alias("turn"), F.round(F.col("value") / 1000, 6).alias("confidence"))


def fact_promotion(spark, d):
    ship(spark)
    return M.promote(_candidates(spark, d), ["user_id", "fact_key"], [F.col("event_id")])


def fact_candidates(spark, d):
    t = table(spark, d, "conversations")
    value = F.when(F.col("turn") % 5 == 0, "beginner").when(F.col("turn") % 5 == 1, F.regexp_extract(F.lower("text"), "([a-z]{4,})", 1)).when(F.col("turn") % 5 == 2, "qqzzx").otherwise("my password is x")
    rows = t.select("conv_id", "turn", F.col("turn").alias("turn_id"), F.col("conv_id").alias("course_id"), value.alias("value"), F.when(F.col("conv_id") % 9 == 0, -1).otherwise(F.col("turn")).alias("expected_turn_id"), F.col("conv_id").alias("expected_course_id"), F.col("text").alias("evidence"))
    return rows.select("conv_id", "turn", M.candidate_reason().alias("reason"))


def fact_expiry(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "misconception").when(F.col("event_type") == "purchase", "mastery_signal").otherwise("preference")
    return e.select("event_id", M.expires_at(kind, epoch_seconds("ts")).alias("expires_at"))


def _updates(spark, d):
    action = F.when(F.col("event_type") == "view", "state").when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "signup", "pin").when(F.col("event_type") == "purchase", "unpin")
    action = action.otherwise(F.when(F.col("value") < 20, "delete").otherwise("state"))
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), action.alias("action"), F.col("value").cast("string").alias("value"))


def lineage_state(spark, d):
    return M.lineage_state(_updates(spark, d), ["user_id"])


def memory_purge(spark, d):
    facts = M.lineage_state(_updates(spark, d), ["user_id"])
    summaries = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("summary"))
    kept, emptied = M.purge(facts, summaries, ["user_id"], "user_id")
    return emptied.join(kept.select("user_id", "status"), "user_id", "left")


def memory_consent(spark, d):
    settings = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") > 0).alias("enabled"))
    return M.consented(table(spark, d, "events").select("event_id", "user_id"), settings, ["user_id"])


def session_turns(spark, d):
    return M.session_turns(table(spark, d, "conversations"), last=3)


def latest_fact_state(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "tombstoned").otherwise("active").alias("status"))
    return M.latest_state(e, ["user_id"], [F.desc("event_id")])


def key_normalisation(spark, d):
    return table(spark, d, "pages").select("page_id", X.normal_key(F.col("url")).alias("key"))


def semantic_similarity(spark, d):
    """Every turn against the one before."""
    ship(spark)
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role"))
    turns = spread(table(spark, d, "conversations").select("conv_id", "turn", "role", "text")).withColumn("before", before)
    return turns.filter("before IS NOT NULL").select("conv_id", "turn", F.round(X.similarity(F.col("before"), F.col("text")), 6).alias("similarity"))


def unicode_normalisation(spark, d):
    ship(spark)
    docs = table(spark, d, "documents")
    return spread(docs.select("doc_id", "text")).select("doc_id", F.md5(X.nfkc_casefold("text")).alias("folded_md5"), F.md5(X.clean_unicode("text")).alias("clean_md5"))


_TOK = "coalesce(ceil(length(text) / 4), 0)::BIGINT"
_COMPACT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_SENSITIVE = X.SENSITIVE.replace("'", "''")

_LINEAGE = """u AS (SELECT user_id, event_id AS tm, value, CASE event_type WHEN 'view' THEN 'state' WHEN 'click' THEN 'correct' WHEN 'signup' THEN 'pin' WHEN 'purchase' THEN 'unpin' ELSE CASE WHEN value < 20 THEN 'delete' ELSE 'state' END END AS action FROM events),
d AS (SELECT *, min(tm) FILTER (action = 'delete') OVER (PARTITION BY user_id) AS gone FROM u), k AS (SELECT * FROM d WHERE gone IS NULL OR tm <= gone),
l AS (SELECT user_id, arg_max(value, tm) FILTER (action IN ('state', 'correct'))::VARCHAR AS value, count_if(action = 'correct')::BIGINT AS superseded, coalesce(arg_max(action = 'pin', tm) FILTER (action IN ('pin', 'unpin')), false) AS pinned, bool_or(action = 'pin') AS keeps, CASE WHEN max(gone) IS NOT NULL THEN 'tombstoned' ELSE 'active' END AS status FROM k GROUP BY user_id)"""

QUERIES = {f.__name__: f for f in (recent_turn_window, recall_decay_score, bounded_recall_greedy, rolling_summary, sensitive_screen, fact_extraction, fact_promotion, fact_candidates, fact_expiry, lineage_state, memory_purge, memory_consent, session_turns, latest_fact_state, key_normalisation, semantic_similarity, unicode_normalisation)}

SQL = {
    "recent_turn_window": f"""WITH m AS (SELECT conv_id, turn, sum({_TOK}) OVER w::BIGINT AS used, row_number() OVER w AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, back, used FROM m WHERE used <= 300 AND back <= 12""",
    "unicode_normalisation": "SELECT doc_id, md5(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS folded_md5, md5(regexp_replace(replace(text, '�', ' '), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')) AS clean_md5 FROM documents",
    "recall_decay_score": "SELECT c_custkey, round(CASE WHEN c_custkey % 50 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.35::DOUBLE * 0.5::DOUBLE + 0.3::DOUBLE * (c_acctbal / 10000.0::DOUBLE) + 0.2::DOUBLE * 0.9::DOUBLE * exp(-(c_custkey % 400)::DOUBLE / 180) + 0.15::DOUBLE * exp(-(c_custkey % 400)::DOUBLE / 90), 6) AS score FROM customer",
    "bounded_recall_greedy": """WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey * 37 % 190 + 5 AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY -o_totalprice, o_orderkey) AS n FROM orders),
f AS (SELECT k, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS cnt, NULL::BIGINT AS id FROM (SELECT DISTINCT k FROM o)
UNION ALL SELECT f.k, o.n, CASE WHEN f.cnt < 8 AND f.used + o.t <= 350 THEN f.used + o.t ELSE f.used END, CASE WHEN f.cnt < 8 AND f.used + o.t <= 350 THEN f.cnt + 1 ELSE f.cnt END, CASE WHEN f.cnt < 8 AND f.used + o.t <= 350 THEN o.id END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
SELECT k AS o_custkey, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS place, id AS fact_id FROM f WHERE id IS NOT NULL""",
    "rolling_summary": f"""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Learner: ' ELSE 'Tutor: ' END || trim(left({_COMPACT.format("text")}, 320)) AS line FROM conversations),
f AS (SELECT conv_id, line, min(turn) AS t FROM l GROUP BY ALL), j AS (SELECT conv_id, {_COMPACT.format("string_agg(line, chr(10) ORDER BY t)")} AS s FROM f GROUP BY conv_id)
SELECT conv_id, md5(trim(right(s, 2000))) AS summary_md5, length(trim(right(s, 2000)))::BIGINT AS chars FROM j""",
    "sensitive_screen": f"SELECT doc_id, coalesce(regexp_matches(text, '{_SENSITIVE}'), false) AS sensitive FROM documents",
    "fact_extraction": f"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text || {"[" + ", ".join(f"'{s}'" for s in _SAID) + "]"}[(conv_id * 7 + turn) % 5 + 1] || CASE WHEN (conv_id * 7 + turn) % 5 = 1 THEN coalesce(regexp_extract(lower(text), '([a-z]{{3,}})', 1), '') ELSE '' END, '\\s+', ' ', 'g')) AS raw FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, turn, raw, lower(raw) AS s FROM t WHERE NOT regexp_matches(raw, '{_SENSITIVE}') AND ((turn % 2 = 0 AND length(raw) >= 8) OR regexp_matches(lower(raw), 'please answer|my goal|i am a beginner|step by step')))
SELECT conv_id, turn, 'response_language' AS fact_key, CASE WHEN s LIKE '%in chinese%' THEN 'chinese' ELSE 'bilingual' END AS value FROM h WHERE s LIKE '%in chinese%' OR s LIKE '%bilingual%'
UNION ALL SELECT conv_id, turn, 'explanation_style', CASE WHEN s LIKE '%step by step%' THEN 'step_by_step' ELSE 'concise' END FROM h WHERE s LIKE '%step by step%' OR s LIKE '%brief answer%'
UNION ALL SELECT conv_id, turn, 'self_reported_level', 'beginner' FROM h WHERE s LIKE '%i am a beginner%'
UNION ALL SELECT conv_id, turn, 'primary_learning_goal', trim(regexp_extract(raw, '(?i)my goal is\\s*[:：]?\\s*([^。.!?]{{3,160}})', 1)) FROM h WHERE regexp_matches(raw, '(?i)my goal is\\s*[:：]?\\s*([^。.!?]{{3,160}})')""",
    "fact_promotion": """WITH RECURSIVE c AS (SELECT user_id, event_id % 2 AS k, event_type AS v, event_id % 7 AS turn, round(value / 1000, 6) AS conf, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, k, n, 1::BIGINT AS fact, v AS held, true AS act, false AS hit, turn, conf, v FROM c WHERE n = 1
UNION ALL SELECT c.user_id, c.k, c.n, CASE WHEN act AND held = c.v THEN fact ELSE fact + 1 END, c.v, NOT act OR held = c.v, act AND held <> c.v, c.turn, c.conf, c.v FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k AND c.n = f.n + 1),
g AS (SELECT user_id, k, fact, arg_min(v, n) AS lv, arg_min(n, n) AS n0, bool_or(hit) AS hit, count(DISTINCT turn) AS evidence, max(conf) AS confidence FROM f GROUP BY ALL),
s AS (SELECT *, hit OR coalesce(lead(hit) OVER (PARTITION BY user_id, k ORDER BY fact), false) AS bad FROM g)
SELECT s.user_id, s.k AS fact_key, fact AS fact_no, CASE WHEN event_id % 5 = 0 THEN upper(lv) || '  ' ELSE lv END AS value, CASE WHEN bad THEN 'conflicted' ELSE 'active' END AS status, evidence, confidence FROM s
JOIN (SELECT user_id, event_id % 2 AS k, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS n FROM events) e ON e.user_id = s.user_id AND e.k = s.k AND e.n = s.n0""",
    "fact_candidates": f"""WITH t AS (SELECT conv_id, turn, text, CASE turn % 5 WHEN 0 THEN 'beginner' WHEN 1 THEN coalesce(regexp_extract(lower(text), '([a-z]{{4,}})', 1), '') WHEN 2 THEN 'qqzzx' ELSE 'my password is x' END AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 AND turn <> -1 THEN 'scope' WHEN turn % 5 > 2 OR regexp_matches(text, '{_SENSITIVE}') THEN 'sensitive' WHEN turn % 5 = 2 AND NOT contains(lower(text), 'qqzzx') THEN 'unsupported' END AS reason FROM t""",
    "fact_expiry": "SELECT event_id, floor(epoch(ts))::BIGINT + CASE WHEN event_type IN ('error', 'purchase') THEN 90 ELSE 365 END * 86400 AS expires_at FROM events",
    "lineage_state": f"WITH {_LINEAGE} SELECT user_id, value, superseded, pinned, keeps, status FROM l",
    "memory_purge": f"WITH {_LINEAGE} SELECT c_custkey AS user_id, CASE WHEN status = 'tombstoned' THEN NULL ELSE c_name END AS summary, CASE WHEN status <> 'tombstoned' THEN status END AS status FROM customer LEFT JOIN l ON user_id = c_custkey",
    "memory_consent": "SELECT event_id, user_id FROM events SEMI JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0 AND c_acctbal > 0) USING (user_id)",
    "session_turns": """WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS user_turns FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, user_turns FROM m WHERE n <= 3""",
    "latest_fact_state": "SELECT user_id, max(event_id) AS event_id, 'active' AS status FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'",
    "key_normalisation": "SELECT page_id, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 255) AS key FROM pages",
}
