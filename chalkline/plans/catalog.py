"""Catalog queries: ``part`` are books, ``supplier`` publishers, ``orders`` and ``lineitem`` runs and bindings."""

from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.functions import text as X
from chalkline.operators import catalog as K
from chalkline.sources.tables import table


def _books(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("edition"), F.col("p_brand").alias("level"), F.col("p_type").alias("subject"), (F.col("p_size") % 9).cast("long").alias("grade"))


def facet_counts(spark, d):
    books = K.with_publishers(_books(spark, d).withColumn("publisher_id", F.col("book_id") % 30), _publishers(spark, d))
    return K.facets(books, [("level",), ("level", "subject"), ("level", "subject", "grade"), ("publisher",)])


def _publishers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("publisher_id"), F.col("s_name").alias("publisher"))


def books_with_publishers(spark, d):
    return K.with_publishers(_books(spark, d).withColumn("publisher_id", F.col("book_id") % 30), _publishers(spark, d)).select("book_id", "title", "publisher")


def outline_of_book(spark, d):
    k = F.col("o_orderkey")
    bindings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") % 5).alias("version_id"))
    runs = table(spark, d, "orders").select(k.alias("run_id"), (F.col("o_custkey") % 5).alias("active_version"), (F.col("o_custkey") % 40).alias("course_id"))
    courses = spark.range(40).select(F.col("id").alias("course_id"), (F.col("id") % 5).alias("active_version"))
    versions = spark.range(5).select(F.col("id").alias("version_id"), F.when(F.col("id") != 3, "published").otherwise("ready").alias("status"))
    outlines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("book_id"), (F.col("l_suppkey") % 5).alias("version_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("outline_id"), F.floor(F.col("l_orderkey") / 7).alias("created_at"))
    books = table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.when(F.col("p_size") % 4 != 0, "published").otherwise("draft").alias("lifecycle"))
    return K.outline_of(outlines, bindings, runs, courses, versions, books)


def catalog_files(spark, d):
    files = table(spark, d, "pages").select("page_id", _path(F.col("page_id")).alias("path"))
    return K.public_view(K.catalog_files(files, series="社")).select("page_id")


def _chain(spark, d):
    bindings = table(spark, d, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 7).alias("version_id"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 7).alias("active_version"), "o_custkey")
    versions = spark.range(7).select(F.col("id").alias("version_id"), F.when(F.col("id") % 3 == 0, "published").otherwise("ready").alias("status"))
    return bindings, runs, versions


def published_semi_join(spark, d):
    return K.published(_books(spark, d), *_chain(spark, d)).select("book_id", "title")


def book_search_ilike(spark, d):
    return K.search(_books(spark, d), "An", ["title", "edition", "subject"], {"grade": 3, "level": None}).select("book_id", "title", "grade")


def keyset_page(spark, d):
    books = _books(spark, d)
    return K.keyset_page(books, ["title", "edition", "book_id"], ("g", "", 0), 50).select("book_id", "title", "edition")


def multiway_course_join(spark, d):
    bindings, runs, versions = _chain(spark, d)
    live = bindings.join(runs, "run_id").filter("active_version = version_id")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = live.join(versions, "version_id").join(customers, "o_custkey").join(nations, "c_nationkey").join(_books(spark, d), "book_id")
    return joined.groupBy("n_name", "status").agg(F.count(F.lit(1)).alias("n_bindings"), F.countDistinct("book_id").alias("n_books"))


def citation_resolve_ordered(spark, d):
    requests = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).cast("long").alias("position"), (F.col("l_partkey") % 50).alias("book_id"))
    return K.resolve_ordered(requests, _books(spark, d).select("book_id", "level"), "book_id").select("request_id", "book_id", "place", "level")


def insert_if_absent_anti(spark, d):
    existing = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("k"), "o_orderpriority").distinct()
    new = table(spark, d, "customer").select((F.col("c_custkey") % 60).alias("k"), F.lit("1-URGENT").alias("o_orderpriority"))
    return K.insert_if_absent(existing, new, ["k", "o_orderpriority"])


def upsert_rows(spark, d):
    existing = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("v"))
    new = existing.filter("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), F.lit(-1).cast("long").alias("v"))
    return K.upsert(existing, new, ["s_suppkey"])


def identity_key(spark, d):
    ship(spark)
    fields = {"education_level": X.nfkc_casefold("level"), "subject": X.nfkc_casefold("subject"), "title": X.nfkc_casefold("title"), "grade": F.col("grade").cast("string"), "editor": F.lit(None).cast("string"), "publisher": F.lit(""), "series": X.nfkc_casefold("edition"), "start_grade": F.lit(""), "term": F.lit("")}
    return _books(spark, d).select("book_id", K.identity_key(fields, "catalog").alias("stable_key"))


_PATH = ["小学", "初中", "高中", "大学"], ["英语", "数学"], ["外研社版（主编：陈琳）（一年级起点）", "人教版", "未知"], ["三年级上册", "七年级下册", "十年级", "全一册"]


def _path(n):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.floor(n / by) % len(values) + 1).cast("int"))
    return F.concat(pick(_PATH[0], 1), F.lit("/"), pick(_PATH[1], 4), F.lit("/"), pick(_PATH[2], 8), F.when(n % 11 == 0, "/x").otherwise(""), F.lit("/"), pick(_PATH[3], 24), F.lit(".pdf"))


def path_parse_issues(spark, d):
    files = table(spark, d, "pages").select("page_id", _path(F.col("page_id")).alias("path"))
    return K.parse_paths(files).select("page_id", "education_level", "publisher", "grade", "term", "start_grade", "editor", "language", F.array_join("issues", ",").alias("issues"), "status")


_B = "b AS (SELECT p_partkey AS book_id, p_name AS title, CASE WHEN p_size % 5 <> 0 THEN p_type END AS edition, p_brand AS level, p_type AS subject, (p_size % 9)::BIGINT AS grade FROM part)"
_C = "v AS (SELECT range AS version_id, CASE WHEN range % 3 = 0 THEN 'published' ELSE 'ready' END AS status FROM range(7)), live AS (SELECT l_partkey AS book_id, o_custkey, l_suppkey % 7 AS version_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 = l_suppkey % 7)"
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_PICK = lambda i, by: f"{_LIST(_PATH[i])}[(page_id // {by}) % {len(_PATH[i])} + 1]"
_G = "MAP {'一': '1', '二': '2', '三': '3', '四': '4', '五': '5', '六': '6', '七': '7', '八': '8', '九': '9'}"

QUERIES = {f.__name__: f for f in (facet_counts, books_with_publishers, outline_of_book, catalog_files, published_semi_join, book_search_ilike, keyset_page, multiway_course_join, citation_resolve_ordered, insert_if_absent_anti, upsert_rows, identity_key, path_parse_issues)}

SQL = {
    "facet_counts": f"""WITH {_B}, w AS (SELECT b.*, s_name AS publisher FROM b JOIN supplier ON s_suppkey = book_id % 30)
SELECT CASE WHEN grouping(level) = 1 THEN 'publisher' WHEN grouping(subject) = 1 THEN 'level' WHEN grouping(grade) = 1 THEN 'level+subject' ELSE 'level+subject+grade' END AS family, level, subject, grade, publisher, count(*) AS n
FROM w GROUP BY GROUPING SETS ((level), (level, subject), (level, subject, grade), (publisher))""",
    "books_with_publishers": f"WITH {_B} SELECT book_id, title, s_name AS publisher FROM b JOIN supplier ON s_suppkey = book_id % 30",
    "outline_of_book": """WITH l AS (SELECT DISTINCT l_partkey AS book_id, l_orderkey % 5 AS version_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 5 = o_custkey % 5 AND o_custkey % 5 = o_custkey % 40 % 5 AND l_orderkey % 5 <> 3)
SELECT l_partkey AS book_id, l_suppkey % 5 AS version_id, arg_max(l_orderkey * 10 + l_linenumber, {'a': l_orderkey // 7, 'b': l_orderkey * 10 + l_linenumber}) AS outline_id FROM lineitem JOIN l ON l.book_id = l_partkey AND l.version_id = l_suppkey % 5 JOIN part ON p_partkey = l_partkey WHERE p_size % 4 <> 0 GROUP BY ALL""",
    "catalog_files": f"SELECT page_id FROM (SELECT page_id, {_PICK(0, 1)} AS l, {_PICK(2, 8)} AS series FROM pages) WHERE l <> '大学' AND contains(series, '社')",
    "published_semi_join": f"WITH {_B}, {_C} SELECT book_id, title FROM b WHERE EXISTS (SELECT 1 FROM live JOIN v USING (version_id) WHERE live.book_id = b.book_id AND status = 'published')",
    "book_search_ilike": f"WITH {_B} SELECT book_id, title, grade FROM b WHERE grade = 3 AND (title ILIKE '%An%' OR edition ILIKE '%An%' OR subject ILIKE '%An%')",
    "keyset_page": f"WITH {_B} SELECT book_id, title, edition FROM b WHERE (title, coalesce(edition, ''), book_id) > ('g', '', 0) ORDER BY title, coalesce(edition, ''), book_id LIMIT 51",
    "multiway_course_join": f"WITH {_C} SELECT n_name, status, count(*) AS n_bindings, count(DISTINCT book_id) AS n_books FROM live JOIN v USING (version_id) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = book_id GROUP BY ALL",
    "citation_resolve_ordered": f"""WITH {_B}, r AS (SELECT l_orderkey AS request_id, (l_linenumber * 1000 + l_suppkey % 1000) AS position, l_partkey % 50 AS book_id FROM lineitem),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY request_id, book_id ORDER BY position) = 1)
SELECT request_id, book_id, row_number() OVER (PARTITION BY request_id ORDER BY position, book_id) AS place, level FROM f JOIN b USING (book_id)""",
    "insert_if_absent_anti": "SELECT DISTINCT c_custkey % 60 AS k, '1-URGENT' AS o_orderpriority FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey % 40 = c_custkey % 60 AND o_orderpriority = '1-URGENT')",
    "upsert_rows": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_nationkey END::BIGINT AS v FROM supplier",
    "identity_key": f"""WITH {_B}, e AS (SELECT book_id, '{{"editor": "", "education_level": "' || lower(level) || '", "grade": "' || grade || '", "publisher": "", "series": "' || coalesce(lower(edition), '') || '", "start_grade": "", "subject": "' || lower(subject) || '", "term": "", "title": "' || lower(title) || '"}}' AS j FROM b)
SELECT book_id, 'catalog:' || left(sha256(j), 32) AS stable_key FROM e""",
    "path_parse_issues": f"""WITH q AS (SELECT page_id, {_PICK(0, 1)} AS l, {_PICK(1, 4)} AS s, {_PICK(2, 8)} AS series, {_PICK(3, 24)} AS title, page_id % 11 = 0 AS nested FROM pages),
r AS (SELECT page_id, CASE l WHEN '小学' THEN 'primary' WHEN '初中' THEN 'middle_school' WHEN '高中' THEN 'high_school' END AS education_level, nullif(regexp_extract(series, '^(.+?)版(?:[（(]|$)', 1), '') AS publisher,
{_G}[regexp_extract(title, '([一二三四五六七八九])年级', 1)] AS grade, nullif(regexp_extract(title, '(上册|下册|全一册)', 1), '') AS term, {_G}[regexp_extract(series, '[（(]([一二三四五六七八九])年级起点[）)]', 1)] AS start_grade,
nullif(trim(regexp_extract(series, '[（(]主编[：:]\\s*([^）)]+)[）)]', 1)), '') AS editor, CASE WHEN s = '英语' THEN 'en' ELSE 'zh-CN' END AS language, nested FROM q),
i AS (SELECT *, list_filter(['grade_unparsed', 'nested_layout_requires_review', 'publisher_unparsed', 'term_unparsed'], lambda x: CASE x WHEN 'grade_unparsed' THEN grade IS NULL WHEN 'nested_layout_requires_review' THEN nested WHEN 'publisher_unparsed' THEN publisher IS NULL ELSE term IS NULL END) AS iss FROM r WHERE education_level IS NOT NULL)
SELECT page_id, education_level, publisher, grade, term, start_grade, editor, language, array_to_string(iss, ',') AS issues, CASE WHEN len(iss) > 0 THEN 'needs_review' ELSE 'staged' END AS status FROM i""",
}
