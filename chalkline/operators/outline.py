"""Outlines of books: titles, lines of contents, nodes with parents, page ranges, and evidence within them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as X

TITLE_CHARS, MAX_DEPTH = 300, 8
#: Pages of a bin in which chunks and nodes meet.
PAGE_BIN = 8
# Lines of contents (leaders follow a title), headings, and headings that are parents or children; sections that aren't taught.
TOC = r"(?i)^(?!\s*[．·…])(.+?)\s*(?:[．·…]{2,}|\.{3,})\s*(\d{1,4})$"
HEADING = r"(?i)^(第\s*[一二三四五六七八九十百0-9]+\s*[章节课单元].{0,200}|(?:module|unit|lesson|chapter)\s*\d+\b.{0,200}|review\s+module|\d+(?:\.\d+){0,3}\s+.{1,200})$"
PARENT_HEADING = r"(?i)^(?:(?:module\s*\d+)|review\s+module|第\s*[一二三四五六七八九十百0-9]+\s*(?:章|单元).*)$"
CHILD_HEADING = r"(?i)^(?:(?:unit|lesson)\s*\d+\b|第\s*[一二三四五六七八九十百0-9]+\s*课\b)"
SUPPLEMENTARY = r"(?i)^(?:words? (?:and expressions|list|poster)|glossary|vocabulary|index|appendix|preface|afterword|acknowledg|词汇|词语表|单词表|附录|后记|编后记|索引|致谢|版权)"


def clean_title(title: Column) -> Column:
    """Compatibility form with single spaces, a space between a kind of section and its number, bounded."""
    return F.substring(F.regexp_replace(X.compact(X.compatible(title)), r"(?i)\b(module|unit|lesson|chapter)\s*(\d+)\b", "$1 $2"), 1, TITLE_CHARS)


def line_kind(line: Column) -> Column:
    """toc, parent, heading or text."""
    return F.when(F.rlike(line, F.lit(TOC)), "toc").when(F.rlike(line, F.lit(PARENT_HEADING)), "parent").when(F.rlike(line, F.lit(HEADING)) & (F.length(line) <= 220), "heading").otherwise("text")


def text_records(lines: DataFrame, books: DataFrame) -> DataFrame:
    """(book, ordinal, title, page, depth) from text lines (book, page, n, line) of books (book, n_pages, page_offset).

    Lines of contents win, else at least two distinct headings. A parent heading holds for the child lines of contents
    that follow it on its page, up to a line of contents that is no child; it stands before the first of them, with
    the first one's page. A printed page counts with the book's offset if that is a page of the book. Windows are by
    page; every line costs a row.
    """
    line = X.compact(F.col("line"))
    rows = lines.withColumn("line", F.substring(line, 1, TITLE_CHARS + 100)).filter("line <> ''").join(books, "book")
    rows = rows.withColumn("printed", F.try_to_number(F.nullif(F.regexp_extract("line", TOC, 2), F.lit("")), F.lit("9999")).cast("int"))
    in_book = F.col("printed").between(1, F.col("n_pages"))
    kind = line_kind(F.col("line"))
    rows = rows.withColumn("kind", F.when((kind == "toc") & ~in_book, F.when(F.rlike("line", F.lit(PARENT_HEADING)), "parent").when(F.rlike("line", F.lit(HEADING)) & (F.length("line") <= 220), "heading").otherwise("text")).otherwise(kind))
    rows = rows.filter("kind <> 'text'").withColumn("title", clean_title(F.when(F.col("kind") == "toc", F.regexp_extract("line", TOC, 1)).otherwise(F.col("line"))))
    child = (F.col("kind") == "toc") & F.rlike("title", F.lit(CHILD_HEADING))
    before = Window.partitionBy("book", "page").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.max(F.when(c, F.col("n"))).over(before)
    rows = rows.withColumn("child", child).withColumn("p", last(F.col("kind") == "parent")).withColumn("t", last((F.col("kind") == "toc") & ~child))
    rows = rows.withColumn("parent_n", F.when(F.col("child") & F.col("p").isNotNull() & F.coalesce(F.col("p") > F.col("t"), F.lit(True)), F.col("p")))
    of_parent = Window.partitionBy("book", "page", "parent_n").orderBy("n")
    parent_title = F.max(F.when(F.col("kind") == "parent", F.struct("n", "title"))).over(before)["title"]
    rows = rows.withColumn("parent_title", parent_title).withColumn("nth", F.row_number().over(of_parent))
    anchor = F.when((F.col("printed") + F.col("page_offset")).between(1, F.col("n_pages")), F.col("printed") + F.col("page_offset")).otherwise(F.col("printed"))
    record = lambda part, title, page, depth: F.struct(F.lit(part).alias("part"), title.alias("title"), page.cast("int").alias("page"), F.lit(depth).alias("depth"))
    own = F.when(F.col("kind") == "heading", F.array(record(1, F.col("line"), F.col("page"), 0)))
    own = own.when(F.col("parent_n").isNotNull() & (F.col("nth") == 1), F.array(record(0, F.col("parent_title"), anchor, 0), record(1, F.col("title"), anchor, 1)))
    own = own.when(F.col("parent_n").isNotNull(), F.array(record(1, F.col("title"), anchor, 1))).when(F.col("kind") == "toc", F.array(record(1, F.col("title"), anchor, 0)))
    each = rows.select("book", F.col("page").alias("at_page"), "n", F.when(F.col("kind") == "heading", "heading").otherwise("toc").alias("source"), F.explode(own).alias("r")).select("book", "at_page", "n", "source", "r.*")
    once = each.groupBy("book", "source", "title", "page", "depth").agg(F.min(F.struct("at_page", "n", "part")).alias("place"))
    counts = Window.partitionBy("book")
    n_toc, n_heading = (F.count(F.when(F.col("source") == k, 1)).over(counts) for k in ("toc", "heading"))
    chosen = once.withColumn("use", F.when(n_toc > 0, "toc").when(n_heading >= 2, "heading")).filter("source = use")
    ordinal = F.row_number().over(Window.partitionBy("book").orderBy("place")) - 1
    return chosen.select("book", ordinal.cast("long").alias("ordinal"), "title", "page", "depth", "source")


def nodes(records: DataFrame, doc: str = "book") -> DataFrame:
    """Records with ``depth`` clamped so that a node's parent exists, and ``parent``, the last node of the depth above.

    A node is at most one deeper than the one before, the first one at 0. Unrolled, its depth is the least of
    (depth of an earlier record or its own, plus the records since): a running minimum. Parents are running maxima for
    each depth. So windows of one pass over a document's sorted records, and no array.
    """
    order = Window.partitionBy(doc).orderBy("ordinal")
    through, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(order)
    bounded = F.greatest(F.lit(0), F.least(F.lit(MAX_DEPTH), F.col("depth")))
    marked = records.withColumn("__n", n).withColumn("__d", F.when(F.col("__n") == 1, 0).otherwise(bounded) - F.col("__n"))
    marked = marked.withColumn("depth", (F.col("__n") + F.min("__d").over(through)).cast("int"))
    above = [F.when(F.col("depth") == k + 1, F.max(F.when(F.col("depth") == k, F.col("ordinal"))).over(before)) for k in range(MAX_DEPTH)]
    return marked.withColumn("parent", F.coalesce(*above)).drop("__n", "__d")


def page_ranges(records: DataFrame, doc: str = "book", last_page: str = "last_page") -> DataFrame:
    """(ordinal, page_start, page_end): a node ends before the next one of its depth or less on a later page.

    A book's nodes come together once, in one row, and each looks ahead in that; books have hundreds of them.
    """
    node = F.struct("ordinal", "depth", "page_start", F.col(last_page).alias("last"))
    books = records.groupBy(doc).agg(F.array_sort(F.collect_list(node)).alias("ns"))

    def end(x: Column, i: Column) -> Column:
        later = F.filter(F.slice("ns", i + 2, F.size("ns")), lambda y: (y["depth"] <= x["depth"]) & (y["page_start"] > x["page_start"]))
        return F.struct(x["ordinal"].alias("ordinal"), x["depth"].alias("depth"), x["page_start"].alias("page_start"), F.coalesce(F.try_element_at(later, F.lit(1))["page_start"] - 1, x["last"]).alias("page_end"))

    return books.select(doc, F.explode(F.transform("ns", end)).alias("n")).select(doc, "n.*")


def pages_in_nodes(chunks: DataFrame, ranges: DataFrame, doc: str = "book") -> DataFrame:
    """Chunks (doc, page) with every outline node whose pages contain theirs: an equal join on document and bin, then the range.

    A node stands in each bin of PAGE_BIN pages that it touches, a chunk in one, so what meets is the result and the few
    nodes that begin or end in a chunk's bin, however many nodes a book has. A null page is in no node.
    """
    valid = ranges.filter("page_start >= 1 AND page_start <= page_end")
    bin_of = lambda c: F.floor(F.col(c) / PAGE_BIN)
    binned = valid.withColumn("__bin", F.explode(F.sequence(bin_of("page_start"), bin_of("page_end"))))
    met = chunks.withColumn("__bin", bin_of("page")).join(binned, [doc, "__bin"])
    return met.filter(F.col("page").between(F.col("page_start"), F.col("page_end"))).drop("__bin")


def instruction_range(records: DataFrame, doc: str = "book", n_pages: str = "n_pages") -> DataFrame:
    """(doc, first, last): the taught pages, from the first root to before the first supplementary root in the last 40 %; else no row."""
    roots = records.filter("depth = 0")
    tail = (F.col("page_start") >= F.col(n_pages) * 0.6) & F.rlike(F.trim("title"), F.lit(SUPPLEMENTARY))
    found = roots.groupBy(doc).agg(F.min("page_start").alias("first"), F.min(F.when(tail, F.col("page_start"))).alias("tail"), F.max(n_pages).alias("n"))
    return found.filter("first >= 1 AND first < tail AND tail <= n").select(doc, "first", (F.col("tail") - 1).alias("last"))


def bookmark_records(entries: DataFrame, doc: str = "book") -> DataFrame:
    """Bookmarks (doc, path of positions, title, page) flattened in tree order; the depth is the nesting, entries without title or page go."""
    kept = entries.filter(F.col("page").isNotNull() & (X.compact(F.col("title")) != ""))
    ordinal = F.row_number().over(Window.partitionBy(doc).orderBy("path")) - 1
    return kept.select(doc, ordinal.cast("long").alias("ordinal"), clean_title(F.col("title")).alias("title"), (F.col("page") + 1).alias("page"), (F.size("path") - 1).alias("depth"))
