"""Set queries: ``orders`` are jobs and sets, ``lineitem`` drafts and exercises, ``part`` books, ``customer`` learners."""

from pyspark.sql import functions as F

from chalkline.operators import practice as P
from chalkline.operators import sets as S
from chalkline.plans import practice as _practice
from chalkline.sources.tables import table


def _jobs(spark, d):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "validating").when(F.col("o_orderstatus") == "O", "ready").otherwise("failed")
    return table(spark, d, "orders").select(k.alias("job_id"), status.alias("status"), (k % 4 + 2).alias("asked"), (F.col("o_custkey") % 5).alias("tenant_id"), F.col("o_custkey").alias("user_id"))


def _drafts(spark, d):
    n = F.col("l_linenumber")
    citations = F.when(n == 3, F.array().cast("array<bigint>")).otherwise(F.array(F.col("l_partkey") % 20, F.col("l_suppkey")))
    prompt = F.when(F.col("l_partkey") % 40 == 0, " ").otherwise(F.concat(F.lit("Say "), F.col("l_partkey") % 3))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_orderkey").alias("set_id"), (F.col("l_orderkey") * 10 + n).alias("draft_id"), F.col("l_partkey").alias("exercise_id"), n.alias("place"), (n - 1).alias("ordinal"), citations.alias("citations"), prompt.alias("prompt"), F.when(F.col("l_returnflag") == "R", "answer_leakage").alias("reason"))


def set_commit(spark, d):
    committed = _jobs(spark, d).filter("job_id % 7 = 0").select("job_id")
    found = S.commit_sets(_jobs(spark, d), _drafts(spark, d), committed)
    return found.select("job_id", "set_id", "exercise_id", "ordinal", F.size("evidence_ids").cast("long").alias("n_evidence"), "draft_id")


def set_audit(spark, d):
    sources = _drafts(spark, d).select("set_id", F.explode("citations").alias("chunk_id")).filter("chunk_id % 10 <> 9").distinct()
    return S.audit_sets(_drafts(spark, d), sources, 4).select("set_id", F.array_join("errors", ",").alias("errors"))


def default_plans(spark, d):
    books = table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"))
    nodes = table(spark, d, "lineitem").filter("l_partkey % 3 <> 0 AND l_linenumber = 1").select(F.col("l_partkey").alias("book_id"), F.col("l_orderkey").alias("ordinal"), F.concat(F.lit("Unit "), F.col("l_orderkey") % 9).alias("title"))
    return S.default_plans(books, nodes)


def cited_sources(spark, d):
    allowed = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_name").alias("path"))
    return S.cited_sources(_drafts(spark, d).withColumn("exercise_id", F.col("draft_id")), allowed)


def set_views(spark, d):
    sets = _jobs(spark, d).filter("job_id % 5 <> 0").select("job_id", F.col("job_id").alias("set_id"))
    found = S.set_views(sets, _drafts(spark, d), _jobs(spark, d))
    return found.select("job_id", "status", "set_id", F.array_join(F.transform("exercises", lambda x: x.cast("string")), ",").alias("exercises"))


def preview_sets(spark, d):
    jobs = _jobs(spark, d)
    return S.previews(jobs.select("job_id", F.col("job_id").alias("set_id")), jobs, F.lit(2)).select("set_id")


def owned_exercises(spark, d):
    sets = _jobs(spark, d).select(F.col("job_id").alias("set_id"), "user_id")
    return S.owned_exercises(sets, _drafts(spark, d).select("set_id", "exercise_id", "ordinal"), F.lit(7))


def resume_views(spark, d):
    next_ = _practice.set_progress(spark, d).filter("next_exercise IS NOT NULL").select("set_id", F.col("next_exercise").alias("exercise_id"))
    return S.resume_views(next_, _practice._attempts(spark, d))


def attempt_ordinals(spark, d):
    return S.attempt_ordinals(P.replay_attempts(_practice._requests(spark, d))).select("request_id", "ordinal")


def still_published(spark, d):
    live = table(spark, d, "part").filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("book_id"), (F.col("p_partkey") % 2).alias("version_id"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("book_id"), (F.col("l_partkey") % 2).alias("version_id"))
    return S.still_published(rows, live, ["book_id", "version_id"])


def fixture_gate(spark, d):
    return S.fixture_gate(_drafts(spark, d), "job_id")


def request_digests(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.request_digest(F.when(F.col("event_type") == "error", "give_up").otherwise("submit"), F.when(F.col("event_type") != "error", F.col("props"))).alias("digest"))


def teaching_policies(spark, d):
    c = table(spark, d, "customer")
    course = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"language": "'), F.lower("c_mktsegment"), F.lit('"}'))).when(F.col("c_custkey") % 3 == 1, "not json")
    override = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('{"solution_reveal_after_attempts": "'), F.col("c_custkey") % 6, F.lit('", "language": null}')))
    p = S.policy(course, override)
    return c.select("c_custkey", p["language"].alias("language"), p["solution_reveal_after_attempts"].alias("reveal"), p["hint_stages"].alias("hints"))


def evidence_sizes(spark, d):
    return table(spark, d, "part").select("p_partkey", S.evidence_size(F.col("p_size")).cast("long").alias("chunks"))


def repair_focus(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.floor(F.col("doc_id") / 12).alias("job_id"), F.col("doc_id").alias("chunk_id"), "text", (F.col("n_chars") % 5 / 10).alias("score"))
    citations = docs.select(F.floor(F.col("doc_id") / 12).alias("job_id"), (F.col("doc_id") - F.col("doc_id") % 3).alias("chunk_id"))
    return S.repair_focus(chunks, citations, "job_id").select("job_id", "chunk_id", "place", "cited")


def cursor_reset(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("key"))
    existing = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("1-URGENT").alias("key"))
    _, second = S.gated_insert(existing, new, ["user_id", "key"], table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")
    return second


def bound_outlines(spark, d):
    bindings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("version_id"))
    outlines = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("version_id"), (F.col("s_suppkey") % 4).alias("n_nodes"))
    existing = bindings.filter("book_id % 5 = 0")
    return S.bound_outlines(bindings, outlines, existing)


def append_turns(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    sessions = table(spark, d, "conversations").filter("turn = 0 AND conv_id % 4 <> 0").select("conv_id")
    return S.append_turns(turns, sessions).select("conv_id", "turn")


def learner_views(spark, d):
    visible, protected = P.split_answer(_drafts(spark, d).withColumn("exercise_id", F.col("draft_id")), ["prompt"], ["reason"])
    return visible.join(protected.filter("reason IS NOT NULL").select("exercise_id"), "exercise_id", "left_anti")


_J = "j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'validating' WHEN 'O' THEN 'ready' ELSE 'failed' END AS status, o_orderkey % 4 + 2 AS asked, o_custkey % 5 AS tenant_id, o_custkey AS user_id FROM orders)"
_D = """d AS (SELECT l_orderkey AS job_id, l_orderkey * 10 + l_linenumber AS draft_id, l_partkey AS exercise_id, l_linenumber AS place, l_linenumber - 1 AS ordinal, CASE WHEN l_linenumber = 3 THEN [] ELSE [l_partkey % 20, l_suppkey] END AS citations,
  CASE WHEN l_partkey % 40 = 0 THEN ' ' ELSE 'Say ' || (l_partkey % 3) END AS prompt, CASE WHEN l_returnflag = 'R' THEN 'answer_leakage' END AS reason FROM lineitem)"""
_UUID = "left({0}, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || lower(to_hex((('0x' || substr({0}, 17, 1))::INT & 3) | 8)) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"
_NS = "unhex('" + S.URL_NAMESPACE + "')"

QUERIES = {f.__name__: f for f in (set_commit, set_audit, default_plans, cited_sources, set_views, preview_sets, owned_exercises, resume_views, attempt_ordinals, still_published, fixture_gate, request_digests, teaching_policies, evidence_sizes, repair_focus, cursor_reset, bound_outlines, append_turns, learner_views)}

SQL = {
    "set_commit": f"""WITH {_J}, {_D}, c AS (SELECT job_id, count(*) AS n, len(list_distinct(flatten(list(citations)))) AS ev FROM d GROUP BY job_id), w AS (SELECT job_id, ev, sha1({_NS} || encode('practice-set:' || job_id)) AS h FROM j JOIN c USING (job_id) WHERE status = 'validating' AND n = asked AND job_id % 7 <> 0),
s AS (SELECT job_id, ev, {_UUID.format('h')} AS set_id FROM w), e AS (SELECT job_id, set_id, ev, draft_id, row_number() OVER (PARTITION BY job_id ORDER BY place) - 1 AS ordinal FROM s JOIN d USING (job_id)), x AS (SELECT *, sha1({_NS} || encode('exercise:' || set_id || ':' || ordinal)) AS h FROM e)
SELECT job_id, set_id, {_UUID.format('h')} AS exercise_id, ordinal, ev AS n_evidence, draft_id FROM x""",
    "set_audit": f"""WITH {_D}, m AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(trim(prompt)) ORDER BY ordinal) AS n, len(list_filter(citations, lambda x: x % 10 = 9)) > 0 AS lost FROM d),
g AS (SELECT job_id, [CASE WHEN count(*) <> 4 THEN 'count' END, CASE WHEN min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1 OR count(DISTINCT ordinal) <> count(*) THEN 'ordinals' END, CASE WHEN bool_or(trim(prompt) = '') THEN 'empty' END, CASE WHEN bool_or(n > 1) THEN 'duplicate' END,
  CASE WHEN bool_or(len(citations) = 0) THEN 'uncited' END, CASE WHEN bool_or(lost) THEN 'unresolved' END, max(reason)] AS es FROM m GROUP BY job_id) SELECT job_id AS set_id, array_to_string(list_sort(list_filter(es, lambda x: x IS NOT NULL)), ',') AS errors FROM g""",
    "default_plans": """WITH n AS (SELECT l_partkey AS book_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) - 1 AS ordinal, 'Unit ' || (l_orderkey % 9) AS title, l_orderkey AS node FROM lineitem WHERE l_partkey % 3 <> 0 AND l_linenumber = 1)
SELECT * FROM n UNION ALL SELECT p_partkey, 0, p_name, NULL FROM part WHERE p_partkey NOT IN (SELECT book_id FROM n)""",
    "cited_sources": f"WITH {_D}, c AS (SELECT draft_id AS exercise_id, unnest(citations) AS chunk_id, generate_subscripts(citations, 1) - 1 AS place FROM d) SELECT exercise_id, place, chunk_id, s_name AS path FROM c LEFT JOIN supplier ON s_suppkey = chunk_id AND s_nationkey % 2 = 0",
    "set_views": f"WITH {_J}, {_D}, l AS (SELECT job_id, string_agg(exercise_id::VARCHAR, ',' ORDER BY ordinal, exercise_id) AS es FROM d GROUP BY job_id) SELECT job_id, status, CASE WHEN job_id % 5 <> 0 THEN job_id END AS set_id, CASE WHEN job_id % 5 <> 0 THEN coalesce(es, '') ELSE '' END AS exercises FROM j LEFT JOIN l USING (job_id)",
    "preview_sets": f"WITH {_J} SELECT job_id AS set_id FROM j WHERE status = 'ready' AND tenant_id = 2",
    "owned_exercises": f"WITH {_J}, {_D} SELECT job_id AS set_id, user_id, exercise_id, ordinal FROM j JOIN d USING (job_id) WHERE user_id = 7",
    "resume_views": f"WITH {_practice._S} SELECT set_id, next_exercise AS exercise_id, count(tries.set_id) FILTER (action = 'submit') AS submitted FROM st LEFT JOIN tries ON tries.set_id = st.set_id AND tries.exercise_id = next_exercise WHERE next_exercise IS NOT NULL GROUP BY ALL".replace("SELECT set_id, next_exercise AS", "SELECT st.set_id, next_exercise AS"),
    "attempt_ordinals": _practice.SQL["attempt_replay"].replace("SELECT request_id, CASE", ", o AS (SELECT *, CASE").replace("END AS outcome FROM c", "END AS outcome FROM c) SELECT request_id, row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY tm, request_id) AS ordinal FROM o WHERE outcome = 'accepted'"),
    "still_published": "SELECT l_orderkey, l_linenumber, l_partkey AS book_id, l_partkey % 2 AS version_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 3 <> 0",
    "fixture_gate": f"WITH {_D}, g AS (SELECT job_id, count(*) AS n, round(avg((reason IS NULL)::INT), 6) AS valid_ratio, count(DISTINCT lower(trim(prompt))) AS prompts FROM d GROUP BY job_id) SELECT *, valid_ratio = 1 AND prompts = n AS passes FROM g",
    "request_digests": """SELECT event_id, sha256('{"action": "' || CASE WHEN event_type = 'error' THEN 'give_up' ELSE 'submit' END || '", "answer": ' || CASE WHEN event_type = 'error' OR props IS NULL THEN 'null' ELSE '"' || replace(props, '"', '\\"') || '"' END || '}') AS digest FROM events""",
    "teaching_policies": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE 'auto' END AS language, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 6)::VARCHAR ELSE '3' END AS reveal, '3' AS hints FROM customer",
    "evidence_sizes": "SELECT p_partkey, least(40, greatest(5, 2 * p_size))::BIGINT AS chunks FROM part",
    "repair_focus": """WITH d AS (SELECT doc_id // 12 AS job_id, doc_id AS chunk_id, text, n_chars % 5 / 10 AS score, length(trim(text)) >= 120 AS big FROM documents), c AS (SELECT doc_id // 12 AS job_id, doc_id - doc_id % 3 AS chunk_id, count(*) AS cited FROM documents GROUP BY ALL),
m AS (SELECT d.*, coalesce(cited, 0) AS cited, max(big) OVER (PARTITION BY d.job_id) AS has_big FROM d LEFT JOIN c ON c.job_id = d.job_id AND c.chunk_id = d.chunk_id)
SELECT job_id, chunk_id, row_number() OVER (PARTITION BY job_id ORDER BY cited, score DESC, length(text) DESC, chunk_id) AS place, cited FROM m WHERE big OR NOT has_big""",
    "cursor_reset": "SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0))",
    "bound_outlines": "SELECT DISTINCT l_partkey AS book_id, l_suppkey AS version_id, CASE WHEN l_suppkey % 3 <> 0 AND l_suppkey % 4 > 0 THEN 'available' ELSE 'unavailable' END AS availability, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 4 ELSE 0 END AS n_nodes FROM lineitem WHERE l_partkey % 5 <> 0",
    "append_turns": "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id % 4 <> 0)",
    "learner_views": f"WITH {_D} SELECT draft_id AS exercise_id, prompt FROM d WHERE draft_id NOT IN (SELECT draft_id FROM d WHERE reason IS NOT NULL)",
}
