"""Telemetry and queue queries over ``events``, and the evaluation of retrieval."""

from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.functions.time import epoch_seconds
from chalkline.operators import evaluation as V
from chalkline.operators import ops as O
from chalkline.sources.tables import spread, table


def _e(spark, d):
    return table(spark, d, "events")


def outbox_depth(spark, d):
    return O.queue_depth(_e(spark, d), "event_type", F.col("user_id") % 3 == 0, (F.col("user_id") % 3 == 1) & (F.col("value") > 50))


def retry_dead_letter(spark, d):
    return O.retry_state(_e(spark, d), "user_id", F.col("event_type") == "error", 3)


def idempotent_dedup(spark, d):
    return O.first_delivery(_e(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def fixed_window_rate(spark, d):
    ship(spark)
    return O.over_limit(_e(spark, d), "user_id", "ts", 86400, 1)


def circuit_breaker(spark, d):
    ship(spark)
    calls = _e(spark, d).select((F.col("user_id") % 50).alias("route"), F.col("event_id").alias("call_id"), epoch_seconds("ts").alias("at"), F.col("event_type").isin("error", "view").alias("failed"))
    return O.circuit(calls, "route", "at", ["at", "call_id"], "failed", reset=86400)


def job_deadlines(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 1000).alias("submitted"), (F.col("o_custkey") % 20).alias("count"))
    events = table(spark, d, "lineitem").filter("l_linenumber >= 3").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") % 1000 + F.col("l_partkey") % 700).alias("at"), F.when(F.col("l_returnflag") == "R", "cancel").otherwise("ready").alias("action"))
    return O.job_states(jobs, events, 1100)


def _job_events(spark, d):
    """Customers' orders as jobs: the first line item submits, the others are attempts, with a success or a cancellation among them."""
    line, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    kind = F.when(n == 1, "submitted").when(F.col("l_quantity") < 6, "succeeded").when(F.col("l_quantity") > 49, "cancelled").otherwise("failed")
    at = F.col("l_orderkey") % 1000 + (n - 1) * (F.col("l_partkey") % 90)
    return line.select(F.col("l_orderkey").alias("job_id"), n.cast("long").alias("event_id"), at.alias("at"), kind.alias("kind"), (F.col("l_suppkey") % 9 != 0).alias("retryable"), (F.col("l_partkey") % 20).cast("int").alias("count"))


def job_outcomes(spark, d):
    ship(spark)
    return O.job_outcomes(_job_events(spark, d), 1200, 3)


def oldest_unclaimed(spark, d):
    queue = _e(spark, d).withColumn("claimed_at", F.when(F.col("value") < 60, F.col("ts")))
    return O.oldest_unclaimed(queue, "event_type", ["ts", "event_id"], 10).select("event_type", "place", "event_id")


def trace_states(spark, d):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("value") < 5, "abstained").otherwise("streaming")
    return O.trace_states(_e(spark, d).withColumn("state", state), "user_id", ["ts", "event_id"], "state")


def error_ratio_10m(spark, d):
    return O.error_ratio(_e(spark, d), "ts", F.col("event_type") == "error", 600)


def histogram_quantile(spark, d):
    return O.histogram_quantile(_e(spark, d), "event_type", "value", [5.0, 20.0, 50.0, 75.0, 100.0], 0.95)


def session_activity(spark, d):
    return O.sessions(_e(spark, d), "user_id", "ts", 6 * 3600)


def retention_cleanup(spark, d):
    kept = O.retained(_e(spark, d), "ts", F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'"), 10)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


_ALLOWED = [("view", "click"), ("click", "purchase"), ("view", "view"), ("signup", "view"), ("error", "view"), ("purchase", "view")]


def state_transition_violations(spark, d):
    ship(spark)
    found = O.invalid_transitions(_e(spark, d), "user_id", ["ts", "event_id"], "event_type", _ALLOWED)
    return found.select("event_id", "from", "event_type")


def failure_islands(spark, d):
    return O.failure_islands(_e(spark, d), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"), 3)


def _words(column):
    return F.regexp_extract_all(F.lower(column), F.lit("([a-z]{3,})"), F.lit(1))


def _term_counts(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return V.term_counts(docs.select("doc_id", F.explode(_words("text")).alias("token")), "doc_id")


def _n_docs(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1))).scalar()


def tfidf_idf(spark, d):
    return V.inverse_frequency(_term_counts(spark, d), _n_docs(spark, d))


def _bench(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("qid"), "text")


def _ranked(spark, d):
    queries = _bench(spark, d).select("qid", F.explode(_words("text")).alias("token"))
    return V.tfidf_scores(queries, _term_counts(spark, d), _n_docs(spark, d), 5)


def tfidf_top5(spark, d):
    return _ranked(spark, d)


_PASSAGE = 8


def _expected(spark, d):
    """Documents that hold the first eight words of an item one after the other, as benchmark passages planted in a corpus do."""
    items = _bench(spark, d).select("qid", F.array_join(F.slice(_words("text"), 1, _PASSAGE), " ").alias("gram"), F.size(_words("text")).alias("n")).filter(F.col("n") >= _PASSAGE).drop("n")
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", _words("text").alias("words")).filter(F.size("words") >= _PASSAGE)
    starts = F.sequence(F.lit(1), F.size("words") - _PASSAGE + 1)
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("words", i, _PASSAGE), " ")))).alias("gram"))
    return grams.join(V.small(items), "gram").select("qid", "doc_id").distinct()


def recall_mrr(spark, d):
    """The ranking of all items, held against the documents in which their passages are planted."""
    return V.retrieval_metrics(_ranked(spark, d), _expected(spark, d), _bench(spark, d), 0.2)


def recall_cases(spark, d):
    return V.retrieval_cases(_ranked(spark, d), _expected(spark, d), _bench(spark, d), 0.2).select("qid", "answerable", "answered", "first", "cited")


def nearest_rank_p95(spark, d):
    return V.nearest_rank(_e(spark, d), "event_type", "value", 0.95)


def price_quantiles(spark, d):
    """Median and 95th percentile of few keys that hold all rows."""
    return V.nearest_ranks(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.5, 0.95])


def golden_gate(spark, d):
    labels = table(spark, d, "labels").select((F.col("quality") == 1).alias("grounded"), (F.col("toxic") == 1).alias("duplicate"), ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("valid"))
    return V.golden_gate(labels, "grounded", "duplicate", "valid")


def revenue_by_segment(spark, d):
    """A plain relational query: pushed filters, pruned columns, partial aggregates."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").filter("l_discount >= 0.05").select("l_orderkey", "l_extendedprice", "l_discount")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.max(epoch_seconds("o_orderdate")).alias("last_order"))


_T = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents), idf AS (SELECT token, count(DISTINCT doc_id) AS df, round(ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(DISTINCT doc_id) + 1)) + 1, 6) AS idf FROM t GROUP BY token)"
_R = f"""{_T}, q AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM benchmark),
dw AS (SELECT doc_id, token, count(*) * any_value(idf) AS w FROM t JOIN idf USING (token) GROUP BY ALL), qw AS (SELECT qid, token, count(*) * any_value(idf) AS w FROM q JOIN idf USING (token) GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY ALL), qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(qw.w * dw.w) / any_value(dn.n * qn.n), 6) AS score FROM qw JOIN dw USING (token) JOIN dn USING (doc_id) JOIN qn USING (qid) GROUP BY ALL),
rk AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5)"""
_CASES = f"""dl AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]{{3,}}'), ' ') || ' ' AS t FROM documents), il AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM benchmark),
x AS (SELECT item_id AS qid, doc_id FROM il JOIN dl ON len(w) >= {_PASSAGE} AND contains(t, ' ' || array_to_string(w[1:{_PASSAGE}], ' ') || ' ')),
cases AS (SELECT b.item_id AS qid, EXISTS (SELECT 1 FROM x WHERE x.qid = b.item_id) AS answerable, EXISTS (SELECT 1 FROM rk WHERE rk.qid = b.item_id AND score >= 0.2) AS answered, (SELECT min(rk.rank) FROM rk JOIN x ON rk.qid = x.qid AND rk.doc_id = x.doc_id WHERE rk.qid = b.item_id) AS first,
  EXISTS (SELECT 1 FROM rk JOIN x ON rk.qid = x.qid AND rk.doc_id = x.doc_id WHERE rk.qid = b.item_id AND rk.rank = 1) AS cited FROM benchmark b)"""
_BOUNDS = "[0.0, 5.0, 20.0, 50.0, 75.0, 100.0]"
_OK = ", ".join(f"'{a}>{b}'" for a, b in _ALLOWED)

QUERIES = {f.__name__: f for f in (outbox_depth, retry_dead_letter, idempotent_dedup, fixed_window_rate, circuit_breaker, job_deadlines, job_outcomes, oldest_unclaimed, trace_states, error_ratio_10m, histogram_quantile, session_activity, retention_cleanup, state_transition_violations, failure_islands, tfidf_idf, tfidf_top5, recall_mrr, recall_cases, nearest_rank_p95, price_quantiles, golden_gate, revenue_by_segment)}

SQL = {
    "outbox_depth": "SELECT event_type, count_if(user_id % 3 <> 0 AND NOT (user_id % 3 = 1 AND value > 50))::BIGINT AS pending, count_if(user_id % 3 = 1 AND value > 50)::BIGINT AS dead_letter FROM events GROUP BY event_type",
    "retry_dead_letter": "SELECT user_id, count_if(event_type = 'error')::BIGINT AS failures, CASE WHEN count_if(event_type = 'error') >= 3 THEN 'dead_letter' WHEN count_if(event_type <> 'error') > 0 THEN 'done' ELSE 'queued' END AS state FROM events GROUP BY user_id",
    "idempotent_dedup": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "fixed_window_rate": """WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS tm, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))) AS n FROM events),
f AS (SELECT user_id, n, tm AS start FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.tm >= start + 86400 THEN e.tm ELSE start END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, start AS window_start, count(*) AS hits FROM f GROUP BY ALL HAVING count(*) > 1""",
    "circuit_breaker": """WITH RECURSIVE e AS (SELECT user_id % 50 AS route, event_id, floor(epoch(ts))::BIGINT AS tm, event_type IN ('error', 'view') AS failed, row_number() OVER (PARTITION BY user_id % 50 ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
f AS (SELECT route, event_id, n, CASE WHEN failed THEN 1 ELSE 0 END AS k, NULL::BIGINT AS opened, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS outcome FROM e WHERE n = 1
UNION ALL SELECT e.route, e.event_id, e.n, CASE WHEN opened IS NOT NULL AND tm - opened < 86400 THEN k WHEN NOT failed THEN 0 WHEN opened IS NOT NULL THEN 1 ELSE k + 1 END,
  CASE WHEN opened IS NOT NULL AND tm - opened < 86400 THEN opened WHEN failed AND opened IS NULL AND k + 1 >= 3 THEN tm END, CASE WHEN opened IS NOT NULL AND tm - opened < 86400 THEN 'rejected' WHEN failed THEN 'failed' ELSE 'ok' END FROM f JOIN e ON e.route = f.route AND e.n = f.n + 1)
SELECT route, event_id AS call_id, outcome FROM f""",
    "job_deadlines": """WITH e AS (SELECT l_orderkey AS k, min({'a': l_orderkey % 1000 + l_partkey % 700, 'b': CASE WHEN l_returnflag = 'R' THEN 'cancel' ELSE 'ready' END}) AS e FROM lineitem WHERE l_linenumber >= 3 GROUP BY l_orderkey),
j AS (SELECT o_orderkey, o_orderkey % 1000 + CASE WHEN o_custkey % 20 > 10 THEN 480 ELSE 300 END AS deadline, e FROM orders LEFT JOIN e ON k = o_orderkey),
s AS (SELECT o_orderkey AS job_id, CASE WHEN e.a < deadline THEN CASE WHEN e.b = 'cancel' THEN 'cancelled' ELSE 'ready' END WHEN 1100 >= deadline THEN 'failed' ELSE 'running' END AS status FROM j)
SELECT job_id, status, status IN ('cancelled', 'failed') AS closes_event FROM s""",
    "job_outcomes": """WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS e, l_orderkey % 1000 + (l_linenumber - 1) * (l_partkey % 90) AS tm, CASE WHEN l_linenumber = 1 THEN 'submitted' WHEN l_quantity < 6 THEN 'succeeded' WHEN l_quantity > 49 THEN 'cancelled' ELSE 'failed' END AS kind, l_suppkey % 9 <> 0 AS retryable, l_partkey % 20 AS c FROM lineitem),
u AS (SELECT k, e, x.* FROM (SELECT k, e, min({'tm': tm, 'kind': kind, 'retryable': retryable, 'c': c}) AS x FROM l WHERE tm <= 1200 GROUP BY k, e)), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tm, e) AS n FROM u),
f AS (SELECT k, n, CASE WHEN kind = 'submitted' THEN tm END AS tm, CASE WHEN kind = 'submitted' THEN 'queued' ELSE 'unknown' END AS s, 0 AS a, NULL::VARCHAR AS r, CASE WHEN kind = 'submitted' THEN tm + CASE WHEN c > 10 THEN 480 ELSE 300 END END AS z FROM o WHERE n = 1
UNION ALL SELECT k, n, CASE WHEN late THEN z WHEN act THEN tm ELSE was END, CASE WHEN late THEN 'failed' WHEN NOT act THEN s WHEN kind = 'submitted' THEN 'queued' WHEN kind <> 'failed' THEN kind WHEN NOT retryable THEN 'failed' WHEN a + 1 >= 3 THEN 'dead_letter' ELSE 'queued' END, CASE WHEN act AND NOT late AND kind = 'failed' THEN a + 1 ELSE a END,
  CASE WHEN late THEN 'deadline' WHEN NOT act THEN r WHEN kind <> 'failed' THEN NULL WHEN NOT retryable THEN 'fatal' WHEN a + 1 >= 3 THEN 'attempts' ELSE 'retry' END, CASE WHEN act AND kind = 'submitted' THEN tm + CASE WHEN c > 10 THEN 480 ELSE 300 END ELSE z END
FROM (SELECT o.k, o.n, o.tm, f.tm AS was, o.kind, o.retryable, o.c, s, a, r, z, s = 'queued' AND z <= o.tm AS late, (s = 'unknown' AND o.kind = 'submitted') OR (s = 'queued' AND o.kind <> 'submitted') AS act FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)),
x AS (SELECT k, arg_max({'tm': tm, 's': s, 'a': a, 'r': r, 'z': z}, n) AS x FROM f GROUP BY k)
SELECT k AS job_id, CASE WHEN x.s = 'queued' AND x.z <= 1200 THEN x.z ELSE x.tm END AS at, CASE WHEN x.s = 'queued' AND x.z <= 1200 THEN 'failed' ELSE x.s END AS status, x.a AS attempts, CASE WHEN x.s = 'queued' AND x.z <= 1200 THEN 'deadline' ELSE x.r END AS reason FROM x WHERE x.s <> 'unknown'""",
    "oldest_unclaimed": "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place, event_id FROM events WHERE value >= 60 QUALIFY place <= 10",
    "trace_states": """WITH s AS (SELECT user_id, {'a': ts, 'b': event_id} AS k, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' WHEN value < 5 THEN 'abstained' END AS s FROM events),
f AS (SELECT user_id, min(k) FILTER (s IS NOT NULL) AS z, arg_min(s, k) FILTER (s IS NOT NULL) AS state FROM s GROUP BY user_id)
SELECT user_id, coalesce(any_value(state), 'open') AS state, count(*) FILTER (z IS NULL OR k <= z) AS n FROM s JOIN f USING (user_id) GROUP BY user_id""",
    "error_ratio_10m": "SELECT (floor(epoch(ts) / 600) * 600)::BIGINT AS window_start, count(*) AS n, count_if(event_type = 'error')::BIGINT AS errors, round(avg((event_type = 'error')::INT), 6) AS ratio FROM events GROUP BY ALL",
    "histogram_quantile": f"""WITH b AS (SELECT unnest({_BOUNDS})::DOUBLE AS hi, unnest(range(6)) AS i), c AS (SELECT event_type, i, hi, count_if(value <= hi OR (i > 0 AND false))::DOUBLE AS c FROM events, b GROUP BY ALL),
n AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT event_type, i, hi, CASE WHEN i = 0 THEN 0 ELSE c END AS c, lag(hi) OVER w AS lo, lag(CASE WHEN i = 0 THEN 0 ELSE c END) OVER w AS p FROM c WINDOW w AS (PARTITION BY event_type ORDER BY i)),
f AS (SELECT event_type, arg_min(lo + (hi - lo) * (0.95::DOUBLE * n - p) / nullif(c - p, 0), i) AS q FROM l JOIN n USING (event_type) WHERE i > 0 AND c >= 0.95::DOUBLE * n GROUP BY event_type)
SELECT event_type, round(coalesce(q, 100.0), 6)::DOUBLE AS quantile FROM n LEFT JOIN f USING (event_type)""",
    "session_activity": """WITH m AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM m)
SELECT user_id, session, count(*) AS n_events, floor(epoch(min(ts)))::BIGINT AS first_s, floor(epoch(max(ts)))::BIGINT AS last_s FROM s GROUP BY ALL""",
    "retention_cleanup": "SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY GROUP BY event_type",
    "state_transition_violations": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, event_type, NULL::VARCHAR AS was, event_type AS now, false AS refused FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, e.event_type, now, CASE WHEN now || '>' || e.event_type IN ({_OK}) THEN e.event_type ELSE now END, now || '>' || e.event_type NOT IN ({_OK}) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, was AS "from", event_type FROM f WHERE refused""",
    "failure_islands": """WITH m AS (SELECT user_id, event_type IN ('error', 'view') AS failed, sum((event_type NOT IN ('error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM events)
SELECT user_id, island, count(*) AS failures FROM m WHERE failed GROUP BY ALL HAVING count(*) >= 3""",
    "tfidf_idf": f"WITH {_T} SELECT token, df, idf FROM idf",
    "tfidf_top5": f"WITH {_R} SELECT qid, doc_id, score, rank FROM rk",
    "recall_cases": f"WITH {_R}, {_CASES} SELECT qid, answerable, answered, first, cited FROM cases",
    "recall_mrr": f"""WITH {_R}, {_CASES}, s AS (SELECT avg(CASE WHEN answerable THEN (first IS NOT NULL)::INT END) AS recall, avg(CASE WHEN answerable THEN coalesce(1.0::DOUBLE / first, 0) END) AS mrr, avg(CASE WHEN answerable AND answered THEN cited::INT END) AS precision,
  count_if(NOT answered AND NOT answerable) AS tp, count_if(NOT answered) AS na, count_if(NOT answerable) AS ns FROM cases), p AS (SELECT *, tp / greatest(na, 1) AS ap, tp / greatest(ns, 1) AS ar FROM s)
SELECT round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(precision, 6) AS citation_precision, round(ap, 6) AS abstention_precision, round(ar, 6) AS abstention_recall, round(CASE WHEN ap + ar > 0 THEN 2 * ap * ar / (ap + ar) ELSE 0 END, 6)::DOUBLE AS abstention_f1 FROM p""",
    "nearest_rank_p95": "SELECT event_type, quantile_disc(value, 0.95) AS percentile FROM events GROUP BY event_type",
    "price_quantiles": "SELECT l_returnflag, 0.5::DOUBLE AS share, quantile_disc(l_extendedprice, 0.5) AS percentile FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 0.95::DOUBLE, quantile_disc(l_extendedprice, 0.95) FROM lineitem GROUP BY 1",
    "golden_gate": """WITH r AS (SELECT count(*) AS n, round(avg((quality = 1)::INT), 6) AS groundedness, round(avg((toxic = 1)::INT), 6) AS duplicates, round(1 - avg((quality = 1 OR toxic = 0)::INT), 6) AS invalid FROM labels)
SELECT *, n >= 20 AND groundedness >= 0.95 AND duplicates <= 0.02 AND invalid <= 0.05 AS passes FROM r""",
    "revenue_by_segment": "SELECT c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, max(epoch(o_orderdate)::BIGINT) AS last_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_discount >= 0.05 GROUP BY c_mktsegment",
}
