"""Outline queries: forty consecutive ``documents`` are a book, each with a line of contents or a node of its own."""

from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.operators import outline as O
from chalkline.sources.tables import table

_BOOK, _PAGES = 40, 120


def _docs(spark, d):
    return table(spark, d, "documents").withColumn("book", F.floor(F.col("doc_id") / _BOOK)).withColumn("word", F.coalesce(F.regexp_extract(F.lower("text"), r"([a-z]{3,})", 1), F.lit("")))


def _records(spark, d):
    page = (F.floor(F.col("doc_id") % _BOOK * 5 / 2) + F.col("n_chars") % 3 + 1).cast("int")
    title = F.when(F.col("n_chars") % 7 == 0, F.concat(F.lit("Vocabulary "), "word")).otherwise(F.concat(F.lit("unit"), F.col("doc_id") % 12, F.lit("  "), F.col("word")))
    return _docs(spark, d).select("book", F.col("doc_id").alias("ordinal"), (F.col("n_chars") % 6 - F.col("doc_id") % 2).cast("int").alias("depth"), title.alias("title"), page.alias("page_start"), F.lit(_PAGES).alias("n_pages"), F.lit(_PAGES).alias("last_page"))


def outline_parents(spark, d):
    return O.nodes(_records(spark, d)).select("ordinal", "depth", "parent")


def _ranges(spark, d):
    return O.page_ranges(O.nodes(_records(spark, d)))


def outline_page_range(spark, d):
    return _ranges(spark, d).select("ordinal", "page_start", "page_end")


def page_in_outline(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("cid"), F.floor(F.col("vec_id") / _BOOK).alias("book"), (F.col("vec_id") * 7 % _PAGES + 1).cast("int").alias("page"))
    return O.pages_in_nodes(e, _ranges(spark, d)).select("cid", "ordinal", "page")


def instruction_pages(spark, d):
    return O.instruction_range(O.nodes(_records(spark, d)))


def clean_titles(spark, d):
    ship(spark)
    return _records(spark, d).select("ordinal", O.clean_title(F.col("title")).alias("title"))


def _lines(spark, d):
    docs = _docs(spark, d).withColumn("k", F.col("n_chars") % 5).withColumn("at", (F.col("doc_id") * 3 % 130 + 1).cast("string"))
    line = F.when(F.col("k") == 0, F.concat(F.lit("Module  "), F.col("doc_id") % 9)).when(F.col("k") < 3, F.concat(F.lit("Unit"), F.col("doc_id") % 12, F.lit(" "), "word", F.lit(" ..... "), "at"))
    line = line.when(F.col("k") == 3, F.concat("word", F.lit(" ……… "), "at")).otherwise(F.concat(F.lit("Lesson 3 "), "word"))
    return docs.select("doc_id", "book", (F.floor(F.col("doc_id") % _BOOK / 10) + 1).cast("int").alias("page"), (F.col("doc_id") % 10).cast("int").alias("n"), line.alias("line"))


def toc_line_kinds(spark, d):
    return _lines(spark, d).select("doc_id", O.line_kind(F.col("line")).alias("kind"))


def toc_records(spark, d):
    ship(spark)
    lines = _lines(spark, d)
    lines = lines.filter("book % 4 <> 3 OR NOT line RLIKE '[0-9]$'")  # every fourth book has headings only
    books = lines.select("book").distinct().select("book", F.lit(_PAGES).alias("n_pages"), (F.col("book") % 3).cast("int").alias("page_offset"))
    return O.text_records(lines, books).select("book", "ordinal", "title", "page", "depth", "source")


def bookmark_flatten(spark, d):
    ship(spark)
    path = F.when(F.col("n_chars") % 3 == 0, F.array(F.col("doc_id"))).when(F.col("n_chars") % 3 == 1, F.array(F.col("doc_id") - F.col("doc_id") % 4, F.col("doc_id"))).otherwise(F.array(F.col("doc_id") - F.col("doc_id") % 4, F.col("doc_id") - F.col("doc_id") % 2, F.col("doc_id")))
    entries = _docs(spark, d).select("book", path.alias("path"), F.col("word").alias("title"), F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") % 90).alias("page"))
    return O.bookmark_records(entries).select("book", "ordinal", "title", "page", "depth")


_D = f"d AS (SELECT *, doc_id // {_BOOK} AS book, coalesce(regexp_extract(lower(text), '([a-z]{{3,}})', 1), '') AS word FROM documents)"
_TITLE = "trim(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '\\b(module|unit|lesson|chapter)\\s*(\\d+)\\b', '\\1 \\2', 'gi'))"
_R = f"""{_D}, r AS (SELECT book, doc_id AS ordinal, (n_chars % 6 - doc_id % 2)::INT AS raw, CASE WHEN n_chars % 7 = 0 THEN 'Vocabulary ' || word ELSE 'unit' || (doc_id % 12) || '  ' || word END AS title,
  (doc_id % {_BOOK} * 5 // 2 + n_chars % 3 + 1)::INT AS page_start FROM d)"""
# Depths one after the other, as the rule is told; parents by a look back
_N = f"""{_R}, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ordinal) AS n FROM r),
f AS (SELECT book, n, ordinal, 0 AS depth FROM o WHERE n = 1 UNION ALL SELECT o.book, o.n, o.ordinal, least(greatest(0, least(8, raw)), f.depth + 1) FROM f JOIN o ON o.book = f.book AND o.n = f.n + 1),
nodes AS (SELECT a.book, a.ordinal, a.depth, title, page_start, (SELECT max(b.ordinal) FROM f b WHERE b.book = a.book AND b.ordinal < a.ordinal AND b.depth = a.depth - 1) AS parent FROM f a JOIN r USING (book, ordinal))"""
_P = f"""{_N}, ranges AS (SELECT a.book, a.ordinal, a.page_start, coalesce((SELECT arg_min(b.page_start, b.ordinal) FROM nodes b WHERE b.book = a.book AND b.ordinal > a.ordinal AND b.depth <= a.depth AND b.page_start > a.page_start) - 1, {_PAGES}) AS page_end FROM nodes a)"""
_L = f"""{_D}, l AS (SELECT doc_id, book, (doc_id % {_BOOK} // 10 + 1)::INT AS page, (doc_id % 10)::INT AS n, CASE WHEN n_chars % 5 = 0 THEN 'Module  ' || (doc_id % 9) WHEN n_chars % 5 < 3 THEN 'Unit' || (doc_id % 12) || ' ' || word || ' ..... ' || (doc_id * 3 % 130 + 1)
  WHEN n_chars % 5 = 3 THEN word || ' ……… ' || (doc_id * 3 % 130 + 1) ELSE 'Lesson 3 ' || word END AS line FROM d)"""

QUERIES = {f.__name__: f for f in (outline_parents, outline_page_range, page_in_outline, instruction_pages, clean_titles, toc_line_kinds, toc_records, bookmark_flatten)}

SQL = {
    "outline_parents": f"WITH RECURSIVE {_N} SELECT ordinal, depth, parent FROM nodes",
    "outline_page_range": f"WITH RECURSIVE {_P} SELECT ordinal, page_start, page_end FROM ranges",
    "page_in_outline": f"WITH RECURSIVE {_P}, e AS (SELECT vec_id AS cid, vec_id // {_BOOK} AS book, (vec_id * 7 % {_PAGES} + 1)::INT AS page FROM embeddings) SELECT cid, ordinal, page FROM e JOIN ranges USING (book) WHERE page BETWEEN page_start AND page_end",
    "instruction_pages": f"""WITH RECURSIVE {_N}, t AS (SELECT book, min(page_start) AS first, min(page_start) FILTER (page_start >= 72 AND regexp_matches(title, '^(?i)(vocabulary|glossary|index)')) AS tail FROM nodes WHERE depth = 0 GROUP BY book)
SELECT book, first, tail - 1 AS last FROM t WHERE first < tail AND tail <= {_PAGES}""",
    "clean_titles": f"WITH {_R} SELECT ordinal, {_TITLE.format('title')} AS title FROM r",
    "toc_line_kinds": f"WITH {_L} SELECT doc_id, CASE WHEN regexp_matches(line, '(\\.{{5}}|…) ?\\d+$') AND NOT regexp_matches(line, '^ ?[…]') THEN 'toc' WHEN line LIKE 'Module%' THEN 'parent' WHEN line LIKE 'Lesson%' THEN 'heading' ELSE 'text' END AS kind FROM l",
    "toc_records": f"""WITH {_L}, k AS (SELECT *, regexp_extract(line, '(\\d+)$', 1) AS p, line LIKE 'Module%' AS parent, line LIKE 'Lesson%' AS heading, {_TITLE.format("regexp_replace(line, ' ?(\\.{5}|…+) \\d+$', '')")} AS title
  FROM l WHERE (book % 4 <> 3 OR NOT regexp_matches(line, '[0-9]$')) AND NOT regexp_matches(line, '^ …')),
t AS (SELECT *, NOT parent AND NOT heading AND TRY_CAST(p AS INT) <= {_PAGES} AS toc FROM k WHERE parent OR heading OR TRY_CAST(p AS INT) <= {_PAGES}), c AS (SELECT *, toc AND title LIKE 'Unit %' AS child FROM t),
w AS (SELECT *, max(CASE WHEN parent THEN n END) OVER b AS pn, max(CASE WHEN toc AND NOT child THEN n END) OVER b AS tn FROM c WINDOW b AS (PARTITION BY book, page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT w.*, CASE WHEN child AND pn IS NOT NULL AND (tn IS NULL OR pn > tn) THEN pn END AS own FROM w),
z AS (SELECT q.*, x.title AS ptitle, row_number() OVER (PARTITION BY q.book, q.page, own ORDER BY q.n) AS nth, CASE WHEN q.toc THEN CASE WHEN TRY_CAST(q.p AS INT) + q.book % 3 <= {_PAGES} THEN TRY_CAST(q.p AS INT) + q.book % 3 ELSE TRY_CAST(q.p AS INT) END END AS anchor FROM q LEFT JOIN c x ON x.book = q.book AND x.page = q.page AND x.n = own),
e AS (SELECT book, page AS ap, n, 0 AS part, ptitle AS title, anchor AS page, 0 AS depth, 'toc' AS source FROM z WHERE own IS NOT NULL AND nth = 1 UNION ALL SELECT book, page, n, 1, title, anchor, CASE WHEN own IS NULL THEN 0 ELSE 1 END, 'toc' FROM z WHERE toc
UNION ALL SELECT book, page, n, 1, trim(line), page, 0, 'heading' FROM z WHERE heading),
o AS (SELECT book, source, title, page, depth, min(ap * 1000 + n * 10 + part) AS place FROM e GROUP BY ALL), u AS (SELECT *, count(*) FILTER (source = 'toc') OVER (PARTITION BY book) AS nt, count(*) FILTER (source = 'heading') OVER (PARTITION BY book) AS nh FROM o)
SELECT book, row_number() OVER (PARTITION BY book ORDER BY place) - 1 AS ordinal, title, page, depth, source FROM u WHERE source = CASE WHEN nt > 0 THEN 'toc' WHEN nh >= 2 THEN 'heading' END""",
    "bookmark_flatten": f"""WITH {_D}, e AS (SELECT book, CASE n_chars % 3 WHEN 0 THEN [doc_id] WHEN 1 THEN [doc_id - doc_id % 4, doc_id] ELSE [doc_id - doc_id % 4, doc_id - doc_id % 2, doc_id] END AS path, word, n_chars % 90 AS page FROM d WHERE n_chars % 11 <> 0 AND word <> '')
SELECT book, row_number() OVER (PARTITION BY book ORDER BY path) - 1 AS ordinal, word AS title, page + 1 AS page, len(path) - 1 AS depth FROM e""",
}
