"""Text functions as Spark columns; Python only where Unicode normalisation or sequence matching needs it."""

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no relevance.
STOP_WORDS = ("about", "and", "are", "does", "for", "from", "how", "into", "the", "this", "what", "when", "where", "which", "who", "why", "will", "with")
# Words of generic expressions.
GENERIC_WORDS = ("a", "am", "an", "and", "are", "i", "is", "it", "my", "the", "this", "that", "your")
# Fixed value: the pattern of personal or secret data.
SENSITIVE = (
    r"(?i)(?:password|passcode|api[_ -]?key|secret|home address|postal address|social security|national insurance|passport|medical diagnosis"
    r"|银行卡|密码|住址|身份证|护照|诊断|\b\+?\d[\d ()-]{8,}\d\b|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b)"
)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for empty or null text."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def approximate_tokens(text: Column) -> Column:
    """Runs of word characters and single other visible characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+|[^\s\w]")), F.lit(0)).cast("long")


def keyword_hits(query: Column, text: Column) -> Column:
    """Distinct query words of three characters or more that occur anywhere in the text."""
    words = F.array_distinct(F.split(F.lower(query), r"\s+"))
    return F.size(F.filter(words, lambda w: (F.length(w) >= 3) & F.contains(F.lower(text), w))).cast("long")


def relevance_terms(text: Column) -> Column:
    """Distinct lower-case words of three characters or more that aren't stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w*]+)"), F.lit(1)))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*map(F.lit, STOP_WORDS)))


def scopes(text: Column) -> Column:
    """Distinct references such as ``unit:2`` or ``week:7``, in order of first occurrence."""
    found = F.regexp_extract_all(F.lower(F.replace(text, F.lit("\\"), F.lit("/"))), F.lit(r"(?<![a-z0-9])((?:unit|week)[\s_/-]*\d+)(?!\d)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.substring(x, 1, 4), F.lit(":"), F.regexp_extract(x, r"(\d+)$", 1).cast("bigint").cast("string"))))


def normal_key(text: Column) -> Column:
    """Runs of other characters than a-z and 0-9 as one underscore, none at the ends, 255 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), 1, 255)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bounded(text: Column, tokens: int, tail: bool = False) -> Column:
    """The first (or last) 4 characters a token of the text with single spaces."""
    short = compact(text)
    return F.trim(F.right(short, F.lit(4 * tokens)) if tail else F.substring(short, 1, 4 * tokens))


def is_sensitive(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(SENSITIVE)), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fake_embedding(text: Column, dim: int = 16) -> Column:
    """A deterministic unit vector from the text's SHA-256 bytes, for runs without a provider."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)


def shingle_phrases(words: Column, least: int = 2, most: int = 6) -> Column:
    """All joined runs of ``least`` to ``most`` words, by length and then place."""
    starts = lambda n: F.sequence(F.lit(1), F.size(words) - n + 1)
    of = lambda n: F.when(F.size(words) >= n, F.transform(starts(n), lambda i: F.slice(words, i, n))).otherwise(F.array().cast("array<array<string>>"))
    return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), of))


def answer_keys(text: Column) -> Column:
    """SHA-256 keys of a text's meaningful word groups and of the whole expression, sorted."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(?<=[a-z])['’](?=[a-z])", ""), F.lit("([a-z]+|[一-鿿]+)"), F.lit(1))
    generic = F.array(*map(F.lit, GENERIC_WORDS))
    groups = F.filter(shingle_phrases(words), lambda g: (F.length(F.array_join(g, "")) >= 6) & (F.size(F.array_except(g, generic)) > 0))
    whole = F.array_join(words, "")
    phrases = F.concat(F.transform(groups, lambda g: F.array_join(g, "")), F.when(F.length(whole) >= 8, F.array(whole)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(phrases, lambda p: F.sha2(p, 256)))))


#: Texts that are their own compatibility form, whose lower case is their folded one, and whose spaces Java's patterns know.
PLAIN = r"\A[\t\n\f\r\x20-\x7E]*\z"


def once(change: Callable[[str], str], values: pd.Series) -> pd.Series:
    """``change`` of every value but nulls; a value that repeats in the batch is changed once."""
    codes, distinct = pd.factorize(values)
    changed = [change(v) for v in distinct]
    return pd.Series([None if c < 0 else changed[c] for c in codes], dtype=object)


def fold(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def clean(text: str) -> str:
    normal = unicodedata.normalize("NFKC", text).replace("�", " ")
    return "".join(c for c in normal if c in "\n\t" or unicodedata.category(c)[0] != "C")


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return once(fold, text)


@F.pandas_udf(T.StringType())
def _cleaned(text: pd.Series) -> pd.Series:
    return once(clean, text)


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return once(lambda t: unicodedata.normalize("NFKC", t), text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_folded(texts: pd.Series) -> pd.Series:
    flat = once(fold, texts.explode())
    flat.index = texts.explode().index
    lists = flat.groupby(level=0).agg(list)
    return pd.Series([None if t is None else [] if not len(t) else lists[i] for i, t in texts.items()], dtype=object)


def is_plain(text: Column) -> Column:
    return F.rlike(text, F.lit(PLAIN))


def nfkc_casefold(text: Column | str) -> Column:
    """Compatibility form, single spaces, case folded. Plain texts stay on the JVM, only others go to Python."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(is_plain(c), F.lower(compact(F.regexp_replace(c, r"[\t\n\f\r]", " ")))).otherwise(_folded(F.when(~is_plain(c), c)))


def clean_unicode(text: Column | str) -> Column:
    """Compatibility form; replacement characters become spaces, other control characters go (not \\n and \\t)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(is_plain(c), F.regexp_replace(c, r"[\f\r]", "")).otherwise(_cleaned(F.when(~is_plain(c), c)))


def compatible(text: Column) -> Column:
    """Compatibility form alone."""
    return F.when(is_plain(text), text).otherwise(_compatible(F.when(~is_plain(text), text)))


def nfkc_casefold_all(texts: Column) -> Column:
    """``nfkc_casefold`` of the items of an array."""
    plain = F.forall(texts, lambda t: F.coalesce(is_plain(t), F.lit(True)))
    return F.when(plain, F.transform(texts, lambda t: F.lower(compact(F.regexp_replace(t, r"[\t\n\f\r]", " "))))).otherwise(_all_folded(F.when(~plain, texts)))


def matching_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The matching-blocks ratio of two strings, or its upper bound where that is ``least`` at most."""
    matcher = SequenceMatcher(a=a, b=b)
    for bound in (matcher.real_quick_ratio, matcher.quick_ratio):
        if (value := bound()) <= least:
            return value
    return matcher.ratio()


def text_similarity(a: str | None, b: str | None) -> float:
    """As ``similarity``, of two values in Python."""
    left, right = (" ".join((x or "").split()).casefold() for x in (a, b))
    x, y = (set(re.findall(r"\w+", t)) for t in (left, right))
    overlap = len(x & y) / len(x | y) if x | y else 0.0
    return 1.0 if left == right else max(overlap, matching_ratio(left, right, overlap))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two strings, computed only where quick bounds leave it above ``least``."""
    return pd.Series([matching_ratio(x or "", y or "", z) for x, y, z in zip(a, b, least, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """The larger of word overlap and sequence ratio; 1 for equal texts.

    The ratio is quadratic in the length, so it runs only where bounds by the characters in common exceed the overlap.
    """
    left, right = F.lower(compact(a)), F.lower(compact(b))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1)))
    overlap = jaccard(words(left), words(right))
    return F.when(left == right, 1.0).otherwise(F.greatest(overlap, F.least(sequence_ratio(left, right, overlap), F.lit(1.0))))
