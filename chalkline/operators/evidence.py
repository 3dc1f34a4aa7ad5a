"""Evidence as learners see it, and facts, blanks and keys made from exact quotes. Everything happens on the row but the check of facts."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.operators import validation as V

EXCERPT_CHARS, MAX_FRAGMENTS, FRAGMENT_CHARS, CLOZE_CHARS = 240, 4, (12, 120), 100
# Ends of sentences, words, marks of bad recognition, labels of activities, colours and questions for one, words that aren't blanked.
ASCII_STOPS, WIDE_STOPS = ".!?", "。！？"
LATIN_WORD = r"([A-Za-z]+(?:['’][A-Za-z]+)?)"
OCR_MARKS = r"\\?\[_+\]\]+|[�¢§%®©]|[—_]{2,}"
OCR_SIGNS = ("�", "¢", "§", "%", "®", "©", "[_", "__", "—")  # each mark has one of them
ACTIVITY_LABEL = r"(?=[DLMPRUdlmpru])(?i:\blisten(?:,|\s+(?:and|point))|\b(?:look and|read and|do and say|practise|practice|unit\s+\d+|module\s+\d+)\b)"
LEADING_CODE = r"^[\s\"'‘’]*(?:\d+[A-Z]\s|#\s*\d+\s)"
COLOURS = r"\b(red|blue|green|yellow|black|white|pink|purple|orange|brown|grey|gray)\b"
COLOUR_ASKED = (r"(?i)\bnow\s+it['’]s\s+_{2,}", r"这(?:顶|个|件|只).{0,12}颜色是什么", r"(?i)what\s+colou?r\s+is\s+(?:this|that|the)\s+")
CLOZE_STOPS = ("and", "how", "his", "her", "isn't", "its", "my", "please", "point", "that", "the", "their", "this", "what", "where", "which", "with", "you", "your")
CLOZE_PREFIX = {"zh": "补全教材原句：", "en": "Complete the textbook sentence: ", "bilingual": "补全教材原句 / Complete the textbook sentence: "}
SELF_ASSESSMENT = ("i can do this", "can do this")


def quotable(sentence: Column, marks: Column) -> Column:
    """The sentence, or what follows its last mark of bad recognition if that is three words or more, else ''. ``marks`` is the count of its whole text."""
    rest = F.regexp_replace(sentence, rf"(?s)^.*(?:{OCR_MARKS})[ =:;'\"‘’\t]*", "")
    clean = (marks == 0) | ~V.has(sentence, OCR_MARKS)
    return F.when(clean, sentence).when(F.size(F.regexp_extract_all(rest, F.lit(LATIN_WORD), F.lit(1))) >= 3, rest).otherwise("")


#: A word of ``words`` that is all capitals, of two to five characters, and what every one of them begins with.
_CAPITALS, _TWO_CAPITALS = r" (?=[A-Z'’]{2,5}(?![^ ]))[A-Z]+(?:['’][A-Z]+)?(?![^ ])", r" [A-Z](?:[A-Z]|['’])"


def readable(x: Column, marks: Column) -> Column:
    """Letters enough, no marks, labels or codes, and no sign of broken lines: repeats, mixed case, scattered capitals.

    ``x`` is a sentence with its words, each behind one space so that each sign is one pattern, and counts: (text, words,
    n, capitals). Letters are counted only where those of the words (all but a space and perhaps an apostrophe each) aren't enough.
    """
    sentence, words, n, capitals = (x[c] for c in ("text", "words", "n", "capitals"))
    share = capitals / n
    scattered = ((n >= 6) & (capitals >= 3) & (share >= 0.3)) | ((n <= 3) & (capitals >= 2) & (share >= 0.5))
    repeated = V.has(words, r"(?i) ([^ ]++ [^ ]++(?: [^ ]++)?) \1(?![^ ])")
    broken = V.has(words, "^ [a-z]") & (F.regexp_count(words, F.lit(" [A-Z]")) >= 2)
    latin = V.has(sentence, r"^\p{Ll}") | V.has(words, "(?<=[a-z]{4})[A-Z]") | scattered | broken | repeated
    enough = lambda k: (k >= 3) & (k / F.length(sentence) >= 0.45)
    lettered = enough(F.length(words) - 2 * n) | enough(F.length(F.regexp_replace(sentence, r"\P{L}+", "")))
    return (sentence != "") & lettered & ((marks == 0) | ~V.has(sentence, OCR_MARKS)) & ~V.has(sentence, LEADING_CODE, ACTIVITY_LABEL) & F.when(n > 0, ~latin).otherwise(True)


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def behind_stops(text: Column) -> Column:
    """A text's parts, each with the stops that end it.

    It is split behind stops, not matched by what isn't one, and by wide stops only where it has some: Java takes long for classes beyond Latin-1.
    """
    ends = lambda stops: rf"(?<=[{stops}])(?![{stops}])"
    parts = F.when(holds_any(text, WIDE_STOPS), F.split(text, ends(ASCII_STOPS + WIDE_STOPS))).otherwise(F.split(text, ends(ASCII_STOPS)))
    return F.filter(parts, lambda s: (s != "") & ~F.rlike(s, F.lit(f"^[{ASCII_STOPS}{WIDE_STOPS}]")))


def marks_of(text: Column) -> Column:
    """How many marks of bad recognition (none has white space, so the text needn't be compacted); null for null."""
    return F.when(holds_any(text, OCR_SIGNS), F.regexp_count(text, F.lit(OCR_MARKS))).when(text.isNotNull(), 0)


def sentences(text: Column, marks: Column) -> Column:
    """Sentences as (raw, text: what of it may be quoted, ok: is that readable?). Each step is an array of its own, so nothing is computed twice.

    ``marks`` is ``marks_of`` the text, by which most sentences are known to have none.
    """
    raw = F.flatten(F.transform(F.array(X.compact(text)), lambda t: F.transform(behind_stops(t), lambda s: F.trim(s))))
    quoted = F.transform(raw, lambda s: F.struct(s.alias("raw"), quotable(s, marks).alias("text")))
    spaced = lambda s: F.rtrim(F.regexp_replace(s, rf"[^A-Za-z]*+{LATIN_WORD}?", " $1"))
    worded = F.transform(quoted, lambda s: F.struct(s["raw"].alias("raw"), s["text"].alias("text"), spaced(s["text"]).alias("words")))
    n = lambda w: F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit("")))
    capitals = lambda w: F.when(F.rlike(w, F.lit(_TWO_CAPITALS)), F.regexp_count(w, F.lit(_CAPITALS))).otherwise(0)
    counted = F.transform(worded, lambda s: F.struct(*(s[c].alias(c) for c in ("raw", "text", "words")), n(s["words"]).alias("n"), capitals(s["words"]).alias("capitals")))
    return F.transform(counted, lambda s: F.struct(s["raw"].alias("raw"), s["text"].alias("text"), readable(s, marks).alias("ok")))


def displayed(docs: DataFrame, text: Column, excerpt: str = "excerpt", fragments: str = "fragments") -> DataFrame:
    """``docs`` with the excerpt and the fragments of a text, whose marks and sentences are found once."""
    made = docs.withColumn("__text", text).withColumn("__marks", marks_of(F.col("__text"))).withColumn("__sentences", sentences(F.col("__text"), F.col("__marks")))
    found = {"found": F.col("__sentences"), "marks": F.col("__marks")}
    shown = {excerpt: display_excerpt(F.col("__text"), **found), fragments: display_fragments(F.col("__text"), **found)}
    return made.withColumns(shown).drop("__text", "__marks", "__sentences")


def display_excerpt(text: Column, limit: int = EXCERPT_CHARS, found: Column | None = None, marks: Column | None = None) -> Column:
    """The longest run of consecutive readable sentences (the first of the longest), cut at a word; '' where several marks make the order doubtful."""
    marks = marks_of(text) if marks is None else marks
    state = F.struct(F.lit("").alias("best"), F.lit("").alias("run"), F.lit(0).alias("n"))
    longer = lambda s: F.when(F.length(s["run"]) > F.length(s["best"]), s["run"]).otherwise(s["best"])
    step = lambda s, x: F.when(x["ok"], F.struct(s["best"].alias("best"), F.concat_ws(" ", F.nullif(s["run"], F.lit("")), x["text"]).alias("run"), (s["n"] + 1).alias("n"))).otherwise(F.struct(longer(s).alias("best"), F.lit("").alias("run"), s["n"].alias("n")))
    found = F.aggregate(sentences(text, marks) if found is None else found, state, step, lambda s: F.struct(longer(s).alias("text"), s["n"].alias("n")))
    doubtful = marks >= 2

    def cut(f: Column) -> Column:
        head = F.substring(f["text"], 1, limit - 1)
        space = F.length(head) - F.instr(F.reverse(head), " ")
        words = F.when((F.instr(head, " ") > 0) & (space > limit // 2), F.substring(head, F.lit(1), space)).otherwise(head)
        return F.when(doubtful & (f["n"] > 1), "").when(F.length(f["text"]) <= limit, f["text"]).otherwise(F.concat(F.rtrim(words), F.lit("…")))

    return F.element_at(F.transform(F.array(found), cut), 1)


def display_fragments(text: Column, limit: int = EXCERPT_CHARS, found: Column | None = None, marks: Column | None = None) -> Column:
    """Up to MAX_FRAGMENTS distinct readable sentences of a text with several marks, skipping those that would exceed the limit in total."""
    marks = marks_of(text) if marks is None else marks
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("total"), F.lit(False).alias("label"))

    def step(s: Column, x: Column) -> Column:
        unit, c = F.rlike(x["raw"], F.lit(r"(?i)^Unit\s+\d+[.]$")), x["text"]
        fits = ~s["label"] & x["ok"] & F.length(c).between(*FRAGMENT_CHARS) & ~F.exists(s["kept"], lambda k: F.lower(k) == F.lower(c)) & (s["total"] + F.length(c) <= limit) & (F.size(s["kept"]) < MAX_FRAGMENTS)
        take = ~unit & fits
        return F.struct(F.when(take, F.concat(s["kept"], F.array(c))).otherwise(s["kept"]).alias("kept"), (s["total"] + F.when(take, F.length(c)).otherwise(0)).alias("total"), unit.alias("label"))

    found = F.aggregate(sentences(text, marks) if found is None else found, state, step, lambda s: s["kept"])
    return F.when(marks >= 2, found).otherwise(F.array().cast("array<string>"))


def cloze_span(quote: Column, answer: Column) -> Column:
    """(n, i, sentence, at, length) of the shortest sentence of a quote (or all of it) that a blank for ``answer`` leaves readable, else null.

    Quote and answer are bound as an array's element, so both are computed once, and only short sentences with the answer meet patterns.
    """

    def span(g: Column) -> Column:
        parts = F.concat(F.transform(F.regexp_extract_all(g["quote"], F.lit(r"([^.!?]+(?:[.!?]+|$))"), F.lit(1)), X.strip), F.array(X.strip(g["quote"])))
        plain = F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), F.regexp_replace(x, r"^#+\s*", "").alias("c")))
        short = F.filter(plain, lambda x: F.length(x["c"]) <= CLOZE_CHARS)
        placed = F.transform(short, lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"), x["c"].alias("sentence"), F.instr(F.lower(x["c"]), F.lower(g["answer"])).alias("at"), F.length(g["answer"]).alias("length")))
        return F.array_min(F.filter(F.filter(placed, lambda x: x["at"] > 0), good))

    def good(x: Column) -> Column:
        c = x["sentence"]
        rest = F.concat(F.substring(c, F.lit(1), x["at"] - 1), F.substring(c, x["at"] + x["length"], F.length(c)))
        clean = ~F.contains(c, F.lit("____")) & ~F.rlike(c, F.lit(r"\.{2,}|…")) & ~V.unreadable_cloze(c)
        return clean & (F.regexp_count(rest, F.lit(r"(?U)\w")) >= 4)

    return F.element_at(F.transform(F.array(F.struct(quote.alias("quote"), answer.alias("answer"))), span), 1)


def cloze_answer(quote: Column, answer: Column) -> Column:
    """The answer if it can be blanked, else the longest (then first) content word of it in the quote that can; else null."""
    words = F.array_distinct(F.regexp_extract_all(quote, F.lit(r"(?<![A-Za-z'])([A-Za-z]{3,})(?![A-Za-z'])"), F.lit(1)))
    ranked = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), F.instr(quote, w).alias("at"), w.alias("w")))), lambda x: x["w"])
    usable = F.filter(ranked, lambda w: ~F.lower(w).isin(*CLOZE_STOPS) & F.contains(F.lower(answer), F.lower(w)) & cloze_span(quote, w).isNotNull())
    there = F.contains(F.lower(quote), F.lower(answer))
    return F.when(there, F.when(cloze_span(quote, answer).isNotNull(), answer).otherwise(F.try_element_at(usable, F.lit(1))))


def cloze_prompt(quote: Column, answer: Column, language: Column) -> Column:
    """A prompt with a blank for ``answer`` in its sentence; null where there is none."""
    prefixes = F.create_map(*(F.lit(x) for kv in CLOZE_PREFIX.items() for x in kv))

    def prompt(s: Column) -> Column:
        template = F.concat(F.substring(s["sentence"], F.lit(1), s["at"] - 1), F.lit("____"), F.substring(s["sentence"], s["at"] + s["length"], F.length(s["sentence"])))
        return F.concat(F.try_element_at(prefixes, language), F.lit("“"), template, F.lit("”"))

    return F.element_at(F.transform(F.array(cloze_span(quote, answer)), prompt), 1)


def ambiguous_colour(prompt: Column, source: Column) -> Column:
    colours = F.array_distinct(F.regexp_extract_all(F.lower(source), F.lit(COLOURS), F.lit(1)))
    return (F.size(colours) >= 2) & V.has(prompt, *COLOUR_ASKED)


# A question for a quantity, and what an item says about it, by language.
QUANTITY = r"(?i)(?<![A-Za-z])(How many [A-Za-z]+(?: [A-Za-z]+)?\?)"
QUANTITY_ITEM = {"zh": "英语问句“{}”用于询问数量。", "en": 'The English question "{}" asks for a quantity.', "bilingual": '英语问句“{}”用于询问数量 / The question "{}" asks for a quantity.'}


def quantity_items(chunks: DataFrame, known: DataFrame, language: str) -> DataFrame:
    """(job_id, chunk_id, quote, prompt): a true statement about the first question for a quantity of a job's English chunks.

    chunks (job_id, place, chunk_id, text, path); known (job_id, key) are the keys of expressions asked before, which
    are left out. For jobs that ask for one true/false item and have used up their other drafts.
    """
    quotes = chunks.filter(F.contains("path", F.lit("/英语/"))).select("job_id", "place", "chunk_id", F.posexplode(F.regexp_extract_all("text", F.lit(QUANTITY), F.lit(1))).alias("nth", "quote"))
    keyed = quotes.select("*", F.explode_outer(X.answer_keys(F.col("quote"))).alias("key"))
    asked = keyed.join(known.select("job_id", "key", F.lit(True).alias("asked")).distinct(), ["job_id", "key"], "left").groupBy("job_id", "place", "nth", "chunk_id", "quote").agg(F.bool_or(F.coalesce("asked", F.lit(False))).alias("asked"))
    first = asked.filter(~F.col("asked")).groupBy("job_id").agg(F.min(F.struct("place", "nth", "chunk_id", "quote")).alias("q"))
    return first.select("job_id", "q.chunk_id", "q.quote", F.replace(F.lit(QUANTITY_ITEM[language]), F.lit("{}"), F.col("q.quote")).alias("prompt"))


def whole_answer_key(answer: Column) -> Column:
    """A digest of an expression of 8 characters or more that isn't a single ASCII word; else ''."""
    words = V.found(X.nfkc_casefold(answer), r"(\w+)")
    joined = F.array_join(words, "")
    single = (F.size(words) == 1) & ~F.rlike(answer, F.lit(r"[^\x00-\x7F]"))
    return F.when((F.length(joined) < 8) | single, "").otherwise(F.sha2(joined, 256))


def usable_facts(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts (batch, place, citation_id, quote, answer, objective) with ``reason``, null for accepted ones.

    A fact needs a cited chunk of its batch that holds the quote, which holds the answer; an objective that no accepted fact before
    has; three words; no marks of bad recognition; and more than self-assessment. Of the facts of an objective that
    are good otherwise the first is accepted, so the check against earlier ones is a window minimum.
    """
    n = X.nfkc_casefold
    held = facts.join(chunks.select("batch", F.col("chunk_id").alias("citation_id"), F.col("text").alias("__t")), ["batch", "citation_id"], "left")
    c = F.col
    first = F.when(c("__t").isNull(), "unknown_citation").when(~F.contains(n(c("__t")), n(c("quote"))), "quote_not_contiguous").when(~F.contains(n(c("quote")), n(c("answer"))), "answer_not_in_quote")
    later = F.when(F.size(V.found(c("quote"), r"(\w+)")) < 3, "short_quote").when(V.has(c("quote"), V.OCR_GARBAGE), "ocr_garbage").when(F.rtrim(n(c("answer")), F.lit(".")).isin(*SELF_ASSESSMENT), "self_assessment")
    marked = held.withColumn("__a", first).withColumn("__b", later).withColumn("__o", n(c("objective")))
    good = F.min(F.when(c("__a").isNull() & c("__b").isNull(), c("place"))).over(Window.partitionBy("batch", "__o"))
    reason = F.coalesce("__a", F.when(c("place") > c("__good"), "duplicate_objective"), "__b")
    return marked.withColumn("__good", good).withColumn("reason", reason).drop("__t", "__a", "__b", "__o", "__good")
