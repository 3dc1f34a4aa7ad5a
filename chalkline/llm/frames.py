"""Small DataFrame helpers of the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra columns never clash with its own."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def with_text(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns ``keep`` and the text, and the text's name there: a text that is kept is passed once."""
    if text in keep:
        return pick(docs, *keep), text
    return docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text")), "__text"
