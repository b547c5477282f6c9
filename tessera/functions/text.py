"""Words: lower case, ASCII punctuation and digits deleted, split at white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOPWORDS = ("the", "a", "an", "of", "and", "to", "in", "is", "was", "it", "that", "for", "on", "with", "de", "la", "der", "die")


def clean_words(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[\p{Punct}0-9]", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def words(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., word), a row an occurrence."""
    return df.select(*keep, F.explode(clean_words(F.col(text))).alias("word"))


def without_stopwords(found: DataFrame, stop: DataFrame) -> DataFrame:
    """stop is a list that people keep by hand; Spark broadcasts it below its own size limit."""
    return found.join(stop, "word", "left_anti")


def comma_list(text: Column) -> Column:
    """Trimmed parts of a comma-separated string; null counts as the one part "None"."""
    return F.transform(F.split(F.coalesce(text, F.lit("None")), ","), lambda x: F.trim(x))
