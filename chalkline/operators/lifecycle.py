"""Content versions and their upkeep: embed feed, ingestion statistics, publication, staging, scheduled scans, upserts."""

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.operators.folds import ordered_fold
from chalkline.operators.ingest import snapshot_hash
from chalkline.operators.machines import run_machine
from chalkline.sources.scratch import scratch_table

EMBED_BATCH = 32


def embed_feed(chunks: DataFrame, sources: DataFrame, members: DataFrame, model: str) -> DataFrame:
    """Chunks of a version's sources that have no vector of ``model`` yet: never embedded, pending, or of another model.

    chunks (chunk_id, source_id, ordinal, model), sources (source_id, path, label), members (version_id, source_id). A row
    for each version and chunk, with its batch of EMBED_BATCH by (source, ordinal) within the source.
    """
    pending = chunks.filter(F.col("model").isNull() | (F.col("model") == "pending") | (F.col("model") != model))
    joined = pending.join(sources, "source_id").join(members, "source_id")
    batch = F.floor((F.row_number().over(Window.partitionBy("version_id", "source_id").orderBy("ordinal", "chunk_id")) - 1) / EMBED_BATCH)
    return joined.withColumn("batch", batch.cast("long"))


def version_sources(members: DataFrame, sources: DataFrame, version: Column) -> DataFrame:
    """The sources of a version, over the bridge of versions and sources."""
    return members.filter(F.col("version_id") == version).join(sources, "source_id")


def vector_upsert(vectors: DataFrame, embedded: DataFrame, key: str = "chunk_id", dim: int | None = None) -> DataFrame:
    """Vectors with the embedded ones in place of those of their key; a vector of another size than ``dim`` is an error.

    Of embedded rows that repeat a key the one with the smallest values is taken.
    """
    others = [c for c in embedded.columns if c != key]
    embedded = embedded.groupBy(key).agg(F.min(F.struct(*others)).alias("__r")).select(key, "__r.*").select(*embedded.columns)
    if dim is not None:
        embedded = embedded.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit("a vector has another size than its collection"))))
    return embedded.unionByName(vectors.join(embedded.select(key), key, "left_anti"))


def drop_orphans(vectors: DataFrame, members: DataFrame, sources: DataFrame) -> DataFrame:
    """Vectors without those of ``sources`` that no version holds any more."""
    orphans = sources.select("source_id").distinct().join(members.select("source_id"), "source_id", "left_anti")
    return vectors.join(orphans, "source_id", "left_anti")


def ingestion_stats(files: DataFrame, group: str) -> DataFrame:
    """Files discovered, unchanged, processed, reused and quarantined, and chunks written, in one pass.

    files: checksum, earlier (its checksum before, null if new), reused (id of an equal source), status, n_chunks.
    """
    same = F.coalesce(F.col("checksum") == F.col("earlier"), F.lit(False))
    again = ~same & F.col("reused").isNotNull()
    fresh = ~same & F.col("reused").isNull()
    return files.groupBy(group).agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(same).alias("unchanged"), F.count_if(again).alias("reused"), F.count_if(fresh & (F.col("status") == "extracted")).alias("processed"),
        F.count_if(fresh & (F.col("status") != "extracted")).alias("quarantined"), F.coalesce(F.sum(F.when(fresh & (F.col("status") == "extracted"), F.col("n_chunks"))), F.lit(0)).cast("long").alias("chunks"),
    )


#: States of a version, and what each action does to those that it changes. A rollback is the course's to decide.
VERSION_STATES = ("none", "building", "ready", "published", "rolled_back")
_BUILD, _READY, _PUBLISH = {0: 1, 2: 1, 4: 1}, {1: 2}, {2: 3}


def _possible(moves: dict[int, int], maybe: bool = False) -> dict[int, int]:
    """An action on sets of states (as bits); with ``maybe`` it may also be refused."""
    out = {}
    for states in range(1 << len(VERSION_STATES)):
        after = 0
        for s in range(len(VERSION_STATES)):
            if states >> s & 1:
                after |= 1 << moves.get(s, s) | (maybe and 1 << s)
        out[states] = after
    return out


#: The machine over sets of states that a version may be in, whatever the course decides on rollbacks.
POSSIBLE = {"build": _possible(_BUILD), "ready": _possible(_READY), "publish": _possible(_PUBLISH), "rollback": _possible({3: 4}, maybe=True)}


def version_history(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(course_id, version_id, status, published_at) of every version, and (course_id, active, previous) of every course.

    events: course_id, version_id, action (build, ready, publish, rollback), at, seq (which tells equal times apart). A build
    starts a version that isn't published; what was built gets ready; a ready version is published and is the course's
    active one then. Only the active version is rolled back, and only if another is published: the one that was published
    last (of equal times the larger version) is active again. Refused events change nothing. ``published_at`` is the time
    of the last accepted publication, ``previous`` what a rollback restores.

    A machine over sets of states runs over all versions first, in ranges of events; what no decision of the course can
    change is settled there. Left for a fold in the order of each course are publications and rollbacks that may be
    accepted, and the events of versions that may have been rolled back.
    """
    known = events.filter(F.col("action").isin(*POSSIBLE)).select("course_id", "version_id", "action", "at", "seq")
    run = run_machine(known, ["course_id", "version_id"], ["at", "seq"], "action", POSSIBLE, 1 << len(VERSION_STATES), 1)
    run = scratch_table(run, "possible")
    certain = F.col("state_before").isin(*(1 << s for s in range(len(VERSION_STATES))))
    moves = F.when(certain, F.col("state_after") != F.col("state_before")).otherwise(True)
    live = run.filter(moves & (F.col("action").isin("publish", "rollback") | ~certain))
    number = F.log2(F.col("state_before")).cast("int")
    live = live.select("course_id", "version_id", "action", "at", "seq", F.when(certain, number).alias("state"))

    def step(course: dict, row: dict) -> list[tuple]:
        if not course:
            course.update(state={}, published={}, order=[], active=None)
        v, action = row["version_id"], row["action"]
        now = course["state"].get(v, row["state"])
        if action == "publish" and now == 2:
            course["state"][v], course["published"][v], course["active"] = 3, row["at"], v
            bisect.insort(course["order"], (row["at"], v))
        elif action == "rollback" and course["active"] == v:
            others = [p for p in course["order"][-2:] if p[1] != v]
            if others:
                course["order"].remove((course["published"][v], v))
                course["state"][v], course["active"] = 4, others[-1][1]
        elif action in ("build", "ready") and now is not None:
            course["state"][v] = (_BUILD if action == "build" else _READY).get(now, now)
        return []

    def finish(course: dict) -> list[tuple]:
        if not course:
            return []
        last = [p for p in course["order"][-2:] if p[1] != course["active"]]
        previous = last[-1][1] if last else None
        return [(v, VERSION_STATES[s], course["published"].get(v), v == course["active"], v == previous) for v, s in course["state"].items()]

    decided = ordered_fold(live, ["course_id"], [F.col("at"), F.col("seq")], "version_id bigint, decided string, published_at bigint, active boolean, previous boolean", dict, step, finish)
    decided = scratch_table(decided, "decided")
    ends = run.groupBy("course_id", "version_id").agg(F.max_by("state_after", F.struct("at", "seq")).alias("s"))
    names = F.element_at(F.array(*map(F.lit, VERSION_STATES)), F.log2(F.col("s")).cast("int") + 1)
    joined = ends.join(decided, ["course_id", "version_id"], "left")
    states = joined.select("course_id", "version_id", F.coalesce("decided", names).alias("status"), "published_at").filter("status <> 'none'")
    flagged = lambda flag: F.max(F.when(F.col(flag), F.col("version_id"))).alias(flag)
    return states, decided.groupBy("course_id").agg(flagged("active"), flagged("previous")).filter("active IS NOT NULL")


def version_states(events: DataFrame) -> DataFrame:
    """(course_id, version_id, status, published_at): see ``version_history``."""
    return version_history(events)[0]


def active_versions(events: DataFrame) -> DataFrame:
    """(course_id, active, previous): see ``version_history``."""
    return version_history(events)[1]


def publication_bindings(published: DataFrame, books: DataFrame, members: DataFrame, existing: DataFrame) -> DataFrame:
    """New (book_id, version_id, source_id) of a publication: a run's books with all of its version's sources, those that exist left out.

    published (run_id, version_id), books (run_id, book_id), members (version_id, source_id). A version's books and its
    sources are each made distinct before they meet, so no pair is made twice, however many runs have it.
    """
    keys = ["book_id", "version_id", "source_id"]
    bound = published.join(books, "run_id").select("book_id", "version_id").distinct()
    wanted = bound.join(members.select("version_id", "source_id").distinct(), "version_id").select(*keys)
    return wanted.join(existing.select(*keys), keys, "left_anti")


def stage_catalog(candidates: DataFrame, batches: DataFrame) -> DataFrame:
    """(root, snapshot, n_candidates, needs_review, state) of scanned roots: reused where the same snapshot was staged before, else new.

    candidates (root, path, checksum, stable_key, status); batches (root, snapshot).
    """
    keyed = candidates.withColumn("checksum", F.concat("checksum", F.lit("\0"), "stable_key"))
    hashes = snapshot_hash(keyed, ["root"])
    review = candidates.groupBy("root").agg(F.count_if(F.col("status") == "needs_review").alias("needs_review"))
    known = batches.select("root", "snapshot").distinct().withColumn("known", F.lit(True))
    found = hashes.join(review, "root").join(known, ["root", "snapshot"], "left")
    return found.select("root", "snapshot", F.col("n_files").alias("n_candidates"), "needs_review", F.when(F.col("known"), "reused").otherwise("new").alias("state"))


def due_scans(courses: DataFrame, roots: DataFrame, runs: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """(course_id, run_id, idempotency_key) of the scans to queue at ``now`` (epoch seconds).

    A course's root is scanned if that is automatic and its interval has passed (or it never was scanned), and no event of
    the course is pending, which its JSON payload names. Runs match both the course and the root.
    """
    due = roots.filter(F.col("automatic") & (F.coalesce(F.lit(now) - F.col("last_scanned"), F.col("interval")) >= F.col("interval")))
    joined = courses.join(due, "root_id").join(runs, ["course_id", "root_id"])
    pending = events.filter("topic = 'ingestion.scan' AND processed_at IS NULL AND dead_lettered_at IS NULL").select(F.get_json_object("payload", "$.course_id").cast("bigint").alias("course_id"))
    key = F.concat(F.lit("scan:"), F.col("course_id"), F.lit(":scheduled:"), F.floor(F.lit(now) / F.col("interval")))
    return joined.join(pending, "course_id", "left_anti").select("course_id", "run_id", key.alias("idempotency_key"))


def insert_or_compare(existing: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """(key, outcome) of new rows: inserted, unchanged where the same body is there, conflict where another one is.

    Of new rows of a key the one with the smallest body is tried; a second one with another body makes it a conflict.
    """
    once = new.groupBy(key).agg(F.min(body).alias(body), (F.min(body) != F.max(body)).alias("__two"))
    joined = once.join(existing.select(key, F.col(body).alias("__b")), key, "left")
    return joined.select(key, F.when(F.coalesce("__two", F.lit(False)), "conflict").when(F.col("__b").isNull(), "inserted").when(F.col("__b") == F.col(body), "unchanged").otherwise("conflict").alias("outcome"))


def artifacts_to_put(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Content-addressed keys that aren't stored yet, a row for each content."""
    key = F.concat(F.lit("artifacts/sha256/"), F.substring("checksum", 1, 2), F.lit("/"), F.col("checksum")).alias("key")
    return files.select(key).distinct().join(stored.select("key"), "key", "left_anti")


def retain(rows: DataFrame, expired: Column, group: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, removed counts by group) of a bulk delete; a null condition keeps the row."""
    gone = F.coalesce(expired, F.lit(False))
    return rows.filter(~gone), rows.groupBy(group).agg(F.count_if(gone).alias("removed"))


def backfill(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set from ``values`` (key, column) where it is null, to the smallest of its key; other rows stay as they are."""
    found = values.groupBy(key).agg(F.min(column).alias("__v"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(column, "__v")).drop("__v")


def text_digest(text: Column) -> Column:
    return F.sha2(X.compact(text), 256)


def approval_rows(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(table, key, candidate_id) to insert for approved candidates (candidate_id, review, stable_key, publisher, level, subject).

    A candidate fans out to eight tables, each by its natural key: publisher and programme are shared, the others are the
    book's. Rows of one key are one (of the smallest candidate), and keys that exist (table, key) are left out.
    """
    c = F.col
    book = c("stable_key")
    keys = {"publisher": F.lower(X.compact(c("publisher"))), "book": book, "programme": F.concat_ws("/", "level", "subject"), "source_root": F.concat(F.lit("root:"), book), "course": F.concat(F.lit("course:"), book), "course_run": F.concat(F.lit("run:"), book), "book_course_binding": F.concat(F.lit("binding:"), book), "outbox_event": F.concat(F.lit("ingest:"), book)}
    fan = F.array(*(F.struct(F.lit(t).alias("table"), k.alias("key")) for t, k in keys.items()))
    rows = candidates.filter("review = 'approved'").select("candidate_id", F.explode(fan).alias("r")).select("r.*", "candidate_id").filter("key IS NOT NULL")
    return rows.groupBy("table", "key").agg(F.min("candidate_id").alias("candidate_id")).join(existing.select("table", "key"), ["table", "key"], "left_anti")
