"""Who may see what: payload filters before recall, checks after it, course authorisation, withheld solutions, trailers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels by rank, and the rank of an unknown one after recall; classes that are withheld in assessments.
RANKS = {"public": 0, "enrolled": 1, "staff_only": 2, "restricted": 3}
UNKNOWN_RANK = 1
WITHHELD = ("exercise_solution", "assessment")
MARKER = "CITATIONS:"


def rank_of(label: Column, unknown: int | None = None) -> Column:
    """The rank of a label; null, or ``unknown``, where there is no such label."""
    known = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    found = F.try_element_at(known, label)
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def payload_filter(chunks: DataFrame, tenant: Column, course: Column, rank: int, version: Column | None = None, sources: list | None = None, scopes: tuple[str, ...] = (), pages: tuple[int, int] | None = None, classes: tuple[str, ...] | None = None) -> DataFrame:
    """The chunks of a tenant's course that a caller of ``rank`` may recall.

    Sources, where they are given, take the place of the version; scopes need one in common; pages hold for chunks
    anchored to pages; unknown labels are left out. All of it is pushed to the scan where the columns are stored.
    """
    allowed = [k for k, r in RANKS.items() if r <= rank]
    kept = chunks.filter((F.col("tenant_id") == tenant) & (F.col("course_id") == course) & F.col("access_label").isin(allowed))
    if sources is not None:
        kept = kept.filter(F.col("source_id").isin(sources))
    elif version is not None:
        kept = kept.filter(F.col("version_id") == version)
    if scopes:
        kept = kept.filter(F.arrays_overlap("scopes", F.array(*map(F.lit, scopes))))
    if pages is not None:
        kept = kept.filter((F.col("anchor_type") == "page") & page_number(F.col("anchor_type"), F.col("anchor_value")).between(*pages))
    return kept if classes is None else kept.filter(F.col("chunk_class").isin(*classes))


def page_number(anchor_type: Column, anchor_value: Column) -> Column:
    """The page of an anchor of digits on a page, else null."""
    return F.when((anchor_type == "page") & F.rlike(anchor_value, F.lit(r"^\d+$")), anchor_value.try_cast("int"))


def recheck(candidates: DataFrame, rank: Column, label: str = "access_label") -> DataFrame:
    """Candidates that the caller may see after recall, where an unknown label counts as enrolled."""
    return candidates.filter(rank_of(F.col(label), UNKNOWN_RANK) <= rank)


def authorised(principals: DataFrame, runs: DataFrame) -> DataFrame:
    """(principal, course) that a principal may read: of its tenant, by role, by claim, or where a run is open to the tenant.

    principals (principal, tenant_id, role, courses); runs (course_id, tenant_id, access_policy). An equal join on the
    tenant; a course has a row whatever the number of its runs.
    """
    courses = runs.groupBy("tenant_id", "course_id").agg(F.bool_or(F.col("access_policy") == "tenant_authenticated").alias("open"))
    may = F.col("role").isin("admin", "instructor") | F.array_contains("courses", F.col("course_id")) | F.col("open")
    return principals.join(courses, "tenant_id").filter(may).select("principal", "course_id")


def previews(principals: DataFrame, courses: DataFrame) -> DataFrame:
    """(principal, course) that an instructor may preview: of its tenant and assigned to it; admins may not."""
    assigned = principals.filter("role = 'instructor'").select("principal", "tenant_id", F.explode("courses").alias("course_id"))
    return assigned.join(courses.select("tenant_id", "course_id").distinct(), ["tenant_id", "course_id"]).select("principal", "course_id").distinct()


def withhold_solutions(evidence: DataFrame, assessment: Column, attempts: Column, threshold: int) -> DataFrame:
    """Evidence (qid, citation, chunk_class) without solutions in an assessment before ``threshold`` attempts, citations counted anew."""
    kept = evidence.filter(~(assessment & (attempts < threshold) & F.col("chunk_class").isin(*WITHHELD)))
    return kept.withColumn("citation", F.row_number().over(Window.partitionBy("qid").orderBy("citation")).cast("long"))


def split_trailer(answers: DataFrame, text: str = "text") -> DataFrame:
    """``visible`` text before the marker, and ``claims`` (source, chunk_id) of the JSON list after it (empty if it can't be read).

    The list is decoded as far as it goes, whatever follows it; its items may hold lists and brackets. Items that aren't
    objects or whose source isn't a whole number are no claims.
    """
    at = F.instr(text, MARKER)
    visible = F.when(at > 0, F.substring(F.col(text), F.lit(1), at - 1)).otherwise(F.col(text))
    listed = F.regexp_extract(F.substring(F.col(text), at + len(MARKER), F.length(text)), r"(?s)^\s*(\[.*)", 1)
    items = F.transform(F.from_json(listed, "array<string>"), F.try_parse_json)
    whole = F.filter(items, lambda v: F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.source", "variant")) == "BIGINT", F.lit(False)))
    read = F.transform(whole, lambda v: F.struct(F.try_variant_get(v, "$.source", "bigint").alias("source"), F.try_variant_get(v, "$.chunk_id", "string").alias("chunk_id")))
    claims = F.when(at > 0, read)
    return answers.withColumn("visible", visible).withColumn("claims", F.coalesce(claims, F.array().cast("array<struct<source:bigint,chunk_id:string>>")))


def cited(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, place, citation, cid) of the claims that name evidence rightly, each chunk once, in order."""
    each = answers.select("qid", F.posexplode("claims").alias("place", "c")).select("qid", "place", F.col("c.source").alias("citation"), F.col("c.chunk_id").alias("chunk_id"))
    found = each.join(evidence.select("qid", "citation", "cid", F.col("cid").cast("string").alias("chunk_id")), ["qid", "citation", "chunk_id"])
    first = Window.partitionBy("qid", "cid").orderBy("place")
    once = found.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return once.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("place"))).cast("long").alias("place"), "citation", "cid")


def practice_sources(bindings: DataFrame, books: DataFrame, runs: DataFrame, courses: DataFrame, versions: DataFrame) -> DataFrame:
    """(book_id, source_id) that a practice job may use: the whole chain is published, active, and of one tenant.

    Every table is filtered first, so the joins see published rows only; keys join in the order of their selectivity.
    """
    live = versions.filter("status = 'published'").select("version_id", "course_id", "run_id")
    active = runs.filter("access_policy = 'tenant_authenticated'").select("run_id", F.col("active_version").alias("version_id"), "course_id")
    chain = active.join(live, ["version_id", "course_id", "run_id"])
    chain = chain.join(courses.select("course_id", F.col("tenant_id").alias("tenant"), F.col("active_version").alias("version_id")), ["course_id", "version_id"])
    own = books.filter("lifecycle = 'published'").select("book_id", F.col("tenant_id").alias("tenant"))
    return bindings.join(chain, ["run_id", "version_id"]).join(own, ["book_id", "tenant"]).select("book_id", "source_id").distinct()
