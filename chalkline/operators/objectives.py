"""Learning objectives: their content tokens, and skills that go by many names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.operators.validation import has

# Words that carry no objective, and the phrases of skills.
STOPS = ("a", "about", "an", "and", "are", "as", "at", "by", "for", "from", "how", "in", "is", "of", "on", "the", "their", "this", "to", "using", "when", "with", "you", "your")
INTRODUCTION = (
    r"\bintroduc(?:e|es|ed|ing)\s+(?:oneself|yourself|themselves)\b",
    r"\bself[- ]introduction\b",
    r"\b(?:stat(?:e|es|ed|ing)|giv(?:e|es|ing)|say(?:s|ing)?|tell(?:s|ing)?)\s+(?:one'?s|your|their)\s+(?:own\s+)?name\b",
    r"\bmy\s+name\s+is\b",
)
COUNTING, NUMBERS = r"\b(?:recit(?:e|es|ed|ing)|count(?:s|ed|ing)?)\b", r"\b(?:numerals?|numbers?|one|two|three|four|five|six|seven|eight|nine|ten)\b"
NAME_ASKED, ASKING, NAMED, OF_THINGS = r"\bwhat(?:'s| is) your name\b", r"\b(?:ask(?:s|ed|ing)?|inquir(?:e|es|ed|ing)|request(?:s|ed|ing)?)\b", r"\bname\b", r"\b(?:object|item|thing)\b"


def tokens(text: Column) -> Column:
    """Distinct Latin words that aren't stop words, and the pairs of neighbouring CJK characters, of the folded text."""
    runs = F.regexp_extract_all(X.nfkc_casefold(text), F.lit("([a-z]+|[一-鿿]+)"), F.lit(1))
    pairs = lambda w: F.when(F.length(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))
    each = F.transform(runs, lambda w: F.when(F.rlike(w, F.lit("^[一-鿿]")), pairs(w)).otherwise(F.array(w)))
    return F.array_except(F.array_distinct(F.flatten(each)), F.array(*map(F.lit, STOPS)))


def skill(text: Column) -> Column:
    """The skill that an objective names whatever its words, else null."""
    t = F.replace(X.nfkc_casefold(text), F.lit("’"), F.lit("'"))
    asked = has(t, NAME_ASKED) | (has(t, ASKING) & has(t, NAMED) & ~has(t, OF_THINGS))
    return F.when(has(t, *INTRODUCTION), "self_introduction").when(has(t, COUNTING) & has(t, NUMBERS), "number_sequence").when(asked, "name_inquiry")


def repeated_in_job(objectives: DataFrame) -> DataFrame:
    """(job_id, a, b): pairs of a job's objectives (job_id, id, objective) that are near-duplicates, the smaller id first.

    A job has some tens of objectives, so pairs are made within it; over a corpus ``practice.similar_objectives`` is for that.
    """
    read = objectives.select("job_id", "id", tokens(F.col("objective")).alias("words"), skill(F.col("objective")).alias("skill"))
    x, y = (read.select("job_id", F.col("id").alias(k), F.col("words").alias(f"words_{k}"), F.col("skill").alias(f"skill_{k}")) for k in "ab")
    same = alike(*(F.col(c) for c in ("words_a", "words_b", "skill_a", "skill_b")))
    return x.join(y, "job_id").filter((F.col("a") < F.col("b")) & same).select("job_id", "a", "b")


def alike(x: Column, y: Column, skill_x: Column, skill_y: Column, least: float = 0.72, common: int = 3) -> Column:
    """The same skill, or enough of two token sets in common."""
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(skill_x == skill_y, F.lit(False)) | ((F.least(F.size(x), F.size(y)) >= common) & (shared >= common) & (X.jaccard(x, y) >= least))


def near_duplicate(a: Column, b: Column, least: float = 0.72, common: int = 3) -> Column:
    """The same skill, or enough tokens in common."""
    return alike(tokens(a), tokens(b), skill(a), skill(b), least, common)
