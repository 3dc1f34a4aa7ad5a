"""Practice sets and study plans: commits, audits, views of sets with their exercises, defaults, digests and policies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.validation import normal

# The URL namespace of name-based identifiers, and the defaults of a teaching policy.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
POLICY = {"hint_stages": "3", "solution_reveal_after_attempts": "3", "language": "auto"}
MIN_EVIDENCE, MAX_EVIDENCE, FOCUS_CHARS = 5, 40, 120


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """A version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def commit_sets(jobs: DataFrame, drafts: DataFrame, committed: DataFrame) -> DataFrame:
    """(job_id, set_id, exercise_id, ordinal, evidence_ids, draft_id) of the sets to write: exactly once for each job.

    A job (job_id, status, asked) commits if it is validating, has as many drafts (job_id, draft_id, place, citations) as
    asked, and no set yet. Identifiers follow from the job's, so a repeated commit writes the same rows.
    """
    ready = jobs.filter("status = 'validating'").join(committed.select("job_id"), "job_id", "left_anti")
    counts = drafts.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("evidence_ids"))
    whole = ready.join(counts, "job_id").filter("n = asked").select("job_id", "evidence_ids", name_uuid(F.concat(F.lit("practice-set:"), F.col("job_id").cast("string"))).alias("set_id"))
    ordinal = F.row_number().over(Window.partitionBy("job_id").orderBy("place")) - 1
    rows = whole.join(drafts.select("job_id", "draft_id", ordinal.cast("long").alias("ordinal")), "job_id")
    return rows.withColumn("exercise_id", name_uuid(F.concat_ws(":", F.lit("exercise"), "set_id", F.col("ordinal").cast("string"))))


def audit_sets(exercises: DataFrame, sources: DataFrame, asked: int) -> DataFrame:
    """(set_id, errors): sorted codes of a set's exercises (set_id, ordinal, prompt, citations, reason).

    count, ordinals (not 0 .. n-1), empty, duplicate, uncited, unresolved (a citation that isn't one of the set's sources), and
    the codes of prompts' own checks.
    """
    marked = exercises.withColumn("__n", F.row_number().over(Window.partitionBy("set_id", normal(F.col("prompt"))).orderBy("ordinal")))
    cited = exercises.select("set_id", F.explode("citations").alias("chunk_id"))
    missing = cited.join(sources.select("set_id", "chunk_id"), ["set_id", "chunk_id"], "left_anti").select("set_id").distinct().withColumn("unresolved", F.lit(True))
    code = lambda cond, name: F.when(F.bool_or(cond), name)
    per = marked.groupBy("set_id").agg(
        F.when(F.count(F.lit(1)) != asked, "count").alias("a"), F.when((F.min("ordinal") != 0) | (F.max("ordinal") != F.count(F.lit(1)) - 1) | (F.countDistinct("ordinal") != F.count(F.lit(1))), "ordinals").alias("b"),
        code(F.trim("prompt") == "", "empty").alias("c"), code(F.col("__n") > 1, "duplicate").alias("d"), code(F.size("citations") == 0, "uncited").alias("e"), F.collect_set("reason").alias("f"),
    )
    joined = per.join(missing, "set_id", "left")
    errors = F.concat(F.array_compact(F.array("a", "b", "c", "d", "e", F.when(F.col("unresolved"), "unresolved"))), "f")
    return joined.select("set_id", F.array_sort(errors).alias("errors"))


def default_plans(books: DataFrame, nodes: DataFrame) -> DataFrame:
    """(book_id, ordinal, title, node): a module for each outline node in order, or one for the whole book where it has none."""
    listed = nodes.select("book_id", (F.row_number().over(Window.partitionBy("book_id").orderBy("ordinal")) - 1).cast("long").alias("ordinal"), "title", F.col("ordinal").alias("node"))
    bare = books.join(nodes.select("book_id"), "book_id", "left_anti").select("book_id", F.lit(0).cast("long").alias("ordinal"), "title", F.lit(None).cast("long").alias("node"))
    return listed.join(books.select("book_id"), "book_id", "left_semi").select("book_id", "ordinal", "title", "node").union(bare)


def cited_sources(exercises: DataFrame, allowed: DataFrame) -> DataFrame:
    """(exercise_id, place, chunk_id, path): citations in order with the sources the caller may see; others keep a null path."""
    each = exercises.select("exercise_id", F.posexplode("citations").alias("place", "chunk_id"))
    return each.join(allowed.select("chunk_id", "path"), "chunk_id", "left").select("exercise_id", "place", "chunk_id", "path")


def set_views(sets: DataFrame, exercises: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row for each job (job_id, status, user_id) with its set, if any, and the exercises in order."""
    listed = exercises.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "exercise_id"))).alias("es"))
    held = sets.join(listed, "set_id", "left").select("job_id", "set_id", F.transform("es", lambda e: e["exercise_id"]).alias("exercises"))
    return jobs.join(held, "job_id", "left").withColumn("exercises", F.coalesce("exercises", F.array().cast("array<bigint>")))


def previews(sets: DataFrame, jobs: DataFrame, tenant: Column) -> DataFrame:
    """Sets of a tenant whose job is ready, as an instructor may preview them."""
    return sets.join(jobs.filter((F.col("status") == "ready") & (F.col("tenant_id") == tenant)).select("job_id"), "job_id", "left_semi")


def owned_exercises(sets: DataFrame, exercises: DataFrame, owner: Column) -> DataFrame:
    return sets.filter(F.col("user_id") == owner).join(exercises, "set_id")


def resume_views(next_: DataFrame, attempts: DataFrame) -> DataFrame:
    """Next exercises with the number of attempts submitted to them so far."""
    counts = attempts.groupBy("exercise_id", "set_id").agg(F.count_if(F.col("action") == "submit").alias("submitted"))
    return next_.join(counts, ["set_id", "exercise_id"], "left").withColumn("submitted", F.coalesce("submitted", F.lit(0)))


def attempt_ordinals(requests: DataFrame) -> DataFrame:
    """``ordinal`` of accepted requests of ``practice.replay_attempts``: how many of the learner and exercise were accepted before, plus one."""
    accepted = requests.filter("outcome = 'accepted'")
    n = F.row_number().over(Window.partitionBy("user_id", "exercise_id").orderBy("at", "request_id"))
    return accepted.withColumn("ordinal", n.cast("long"))


def still_published(rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Historical rows whose book and version are published now."""
    return rows.join(live.select(*keys), keys, "left_semi")


def fixture_gate(drafts: DataFrame, group: str) -> DataFrame:
    """(group, n, valid_ratio, prompts, passes): all valid, and no two alike."""
    per = drafts.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("reason").isNull().cast("double")), 6).alias("valid_ratio"), F.countDistinct(normal(F.col("prompt"))).alias("prompts"))
    return per.withColumn("passes", (F.col("valid_ratio") == 1) & (F.col("prompts") == F.col("n")))


def request_digest(action: Column, answer: Column) -> Column:
    """SHA-256 of the request as JSON with sorted keys; a null answer is written as null."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.sha2(F.concat(F.lit('{"action": '), quoted(action), F.lit(', "answer": '), F.coalesce(quoted(answer), F.lit("null")), F.lit("}")), 256)


def policy(course: Column, override: Column) -> Column:
    """The defaults, with a course's JSON fields over them and a request's over those."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    last = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    defaults = F.create_map(*(F.lit(x) for kv in POLICY.items() for x in kv))
    return last(last(defaults, kept(read(course))), kept(read(override)))


def evidence_size(count: Column) -> Column:
    """How many chunks a job of ``count`` questions asks for."""
    return F.least(F.lit(MAX_EVIDENCE), F.greatest(F.lit(MIN_EVIDENCE), 2 * count))


def repair_focus(chunks: DataFrame, citations: DataFrame, job: str) -> DataFrame:
    """``place`` of each job's chunks for a repair: fewest citations first, then score and length; short ones only where there is no other."""
    long_ = F.length(F.trim("text")) >= FOCUS_CHARS
    marked = chunks.withColumn("__any", F.max(long_).over(Window.partitionBy(job))).filter(long_ | ~F.col("__any"))
    counts = citations.groupBy(job, "chunk_id").agg(F.count(F.lit(1)).alias("cited"))
    joined = marked.join(counts, [job, "chunk_id"], "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    order = Window.partitionBy(job).orderBy("cited", F.desc("score"), F.desc(F.length("text")), "chunk_id")
    return joined.withColumn("place", F.row_number().over(order).cast("long")).drop("__any")


def gated_insert(existing: DataFrame, new: DataFrame, keys: list[str], second: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows inserted, rows of ``second`` that go with them): what exists already is left alone, and so is its second write."""
    inserted = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return inserted, second.join(inserted.select(on).distinct(), on, "left_semi")


def bound_outlines(bindings: DataFrame, outlines: DataFrame, existing: DataFrame) -> DataFrame:
    """(book_id, version_id, availability, n_nodes) to write: a row for each bound book without one, also where no outline was found."""
    keys = ["book_id", "version_id"]
    wanted = bindings.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    found = wanted.join(outlines, "version_id", "left")
    return found.select(*keys, F.when(F.coalesce("n_nodes", F.lit(0)) > 0, "available").otherwise("unavailable").alias("availability"), F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"))


def append_turns(turns: DataFrame, sessions: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Assistant turns to append: not blank, and of a session that is still there."""
    return turns.filter(F.coalesce(F.trim(text), F.lit("")) != "").join(sessions.select(key), key, "left_semi")
