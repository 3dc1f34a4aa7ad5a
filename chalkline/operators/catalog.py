"""Catalog: path parsing, identity, facets, search with keyset pages, published bindings, ordered lookups."""

import base64
import json
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels by the first characters of the top folder, and numerals of grades.
LEVELS = {"小学": "primary", "初中": "middle_school", "高中": "high_school"}
GRADES = {"一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9"}
# What a path says about its book.
SERIES_PUBLISHER, TITLE_GRADE, TITLE_TERM = r"^(.+?)版(?:[（(]|$)", "([一二三四五六七八九])年级", "(上册|下册|全一册)"
START_GRADE, EDITOR = r"[（(]([一二三四五六七八九])年级起点[）)]", r"[（(]主编[：:]\s*([^）)]+)[）)]"
IDENTITY_FIELDS = ("education_level", "editor", "grade", "publisher", "series", "start_grade", "subject", "term", "title")


def parse_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Metadata of ``level/subject/series/title.pdf`` paths, with sorted issue codes; other trees are left out."""
    parts = F.split(F.col(path), "/")
    title = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    found = files.withColumn("__p", parts).filter(F.size("__p") >= 4).withColumn("title", title)
    level = F.coalesce(*(F.when(F.startswith(F.element_at("__p", 1), F.lit(k)), v) for k, v in LEVELS.items()))
    grades = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))
    grade_of = lambda c, pattern: F.try_element_at(grades, F.regexp_extract(c, pattern, 1))
    some = lambda c: F.nullif(c, F.lit(""))
    series = F.element_at("__p", 3)
    rows = found.select(
        "*",
        level.alias("education_level"),
        F.element_at("__p", 2).alias("subject"),
        series.alias("series"),
        some(F.regexp_extract(series, SERIES_PUBLISHER, 1)).alias("publisher"),
        grade_of(F.col("title"), TITLE_GRADE).alias("grade"),
        some(F.regexp_extract("title", TITLE_TERM, 1)).alias("term"),
        F.coalesce(grade_of(series, START_GRADE), grade_of(F.col("title"), START_GRADE)).alias("start_grade"),
        some(F.trim(F.regexp_extract(series, EDITOR, 1))).alias("editor"),
        F.when(F.element_at("__p", 2) == "英语", "en").otherwise("zh-CN").alias("language"),
    ).filter("education_level IS NOT NULL")
    issue = lambda cond, code: F.when(cond, F.lit(code))
    issues = F.array(issue(F.size("__p") != 4, "nested_layout_requires_review"), issue(F.col("publisher").isNull(), "publisher_unparsed"), issue(F.col("grade").isNull(), "grade_unparsed"), issue(F.col("term").isNull(), "term_unparsed"))
    rows = rows.withColumn("issues", F.array_sort(F.array_compact(issues)))
    return rows.withColumn("status", F.when(F.size("issues") > 0, "needs_review").otherwise("staged")).drop("__p")


def identity_key(normal: dict[str, Column], prefix: str) -> Column:
    """A digest of normalised fields, written as JSON with sorted keys; the fields come normalised already."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), quote(normal[k])) for k in sorted(normal)))
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 32))


def facets(books: DataFrame, families: list[tuple[str, ...]]) -> DataFrame:
    """Counts of all families of keys in one pass: (family, one column for each key, n)."""
    keys = list(dict.fromkeys(k for f in families for k in f))
    sets = [[F.col(k) for k in f] for f in families]
    grouped = books.groupingSets(sets, *map(F.col, keys)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*map(F.col, keys)).alias("__g"))
    name = F.coalesce(*(F.when(F.col("__g") == sum(0 if k in f else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)), "+".join(f)) for f in families))
    return grouped.select(name.alias("family"), *keys, "n").filter("n > 0")


def with_publishers(books: DataFrame, publishers: DataFrame) -> DataFrame:
    """Books with their publisher's name; publishers are few, so Spark broadcasts them."""
    return books.join(publishers.select("publisher_id", "publisher"), "publisher_id")


def outline_of(outlines: DataFrame, bindings: DataFrame, runs: DataFrame, courses: DataFrame, versions: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, version_id, outline_id): the newest outline of each published book's active, published version.

    Outlines meet bindings on book and version; the version must be active in both the run and its course.
    """
    live = versions.filter("status = 'published'").select("version_id")
    active = runs.join(courses.select("course_id", F.col("active_version").alias("__c")), "course_id").filter(F.col("active_version") == F.col("__c")).select("run_id", F.col("active_version").alias("version_id"))
    bound = bindings.join(active, ["run_id", "version_id"]).join(live, "version_id", "left_semi").select("book_id", "version_id").distinct()
    found = outlines.join(bound, ["book_id", "version_id"]).join(books.filter("lifecycle = 'published'").select("book_id"), "book_id", "left_semi")
    newest = F.max_by("outline_id", F.struct("created_at", "outline_id"))
    return found.groupBy("book_id", "version_id").agg(newest.alias("outline_id"))


def catalog_files(files: DataFrame, prefix: str = "", series: str | None = None, path: str = "path") -> DataFrame:
    """PDF files of the taught trees: visible, below ``prefix``, four parts or more deep, of a series that contains ``series``."""
    parts = F.split(F.col(path), "/")
    kept = files.filter(F.startswith(F.col(path), F.lit(prefix)) & F.lower(F.col(path)).endswith(".pdf") & ~F.rlike(path, F.lit(r"(^|/)\.")) & (F.size(parts) >= 4))
    kept = kept.filter(F.substring(F.element_at(parts, 1), 1, 2).isin(*LEVELS))
    return kept if series is None else kept.filter(F.contains(F.element_at(parts, 3), F.lit(series)))


def public_view(files: DataFrame) -> DataFrame:
    """Without paths of the host."""
    return files.drop("relative_path", "absolute_path", "path")


def published(books: DataFrame, bindings: DataFrame, runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Books with a binding to a run's active version that is published: a semi-join of the chain."""
    live = bindings.join(runs, "run_id").filter("active_version = version_id").join(versions.filter("status = 'published'").select("version_id"), "version_id")
    return books.join(live.select("book_id"), "book_id", "left_semi")


def search(books: DataFrame, needle: str | None, columns: list[str], filters: dict[str, object]) -> DataFrame:
    """Equality filters that are set, and the needle (spaces folded) in any of the columns, whatever the case."""
    for name, value in filters.items():
        if value is not None:
            books = books.filter(F.col(name) == F.lit(value))
    folded = " ".join(unicodedata.normalize("NFKC", needle or "").split()).casefold()
    if folded:
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(folded))
        books = books.filter(found)
    return books


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows and one more after a cursor, by ``keys`` with null as the empty text."""
    kinds = dict(rows.dtypes)
    key = F.struct(*((F.coalesce(F.col(k), F.lit("")) if kinds[k] == "string" else F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)))
    if after is not None:
        rows = rows.filter(key > F.struct(*(F.lit(v).cast(kinds[k]).alias(f"k{i}") for i, (k, v) in enumerate(zip(keys, after, strict=True)))))
    return rows.orderBy(key).limit(limit + 1)


def encode_cursor(values: tuple) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(values), separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple:
    return tuple(json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))))


def resolve_ordered(requests: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Targets of requested ids (request_id, position, key) in request order, the first of repeats."""
    first = Window.partitionBy("request_id", key).orderBy("position")
    wanted = requests.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n").join(targets, key)
    return wanted.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("position", key)).cast("long"))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key neither exists nor repeats an earlier one of ``new``."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with their keys."""
    return new.unionByName(existing.join(new.select(*keys), keys, "left_anti"))
