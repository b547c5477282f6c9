"""Exploration: counts, averages, rankings, joins that keep or drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def count_in_year(df: DataFrame, date: str, year: int) -> DataFrame:
    return df.where(F.year(date) == year).agg(F.count("*").alias("n"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def count_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; ties by key. Fewer groups than n give fewer rows."""
    return count_by(df, key).orderBy(F.desc("n"), key).limit(n)


def top_words(docs: DataFrame, n: int, text: str = "text", stop: DataFrame | None = None) -> DataFrame:
    found = words(docs, text)
    if stop is not None:
        found = found.join(stop, "word", "left_anti")
    return top_counts(found, "word", n)


def category_averages(reviews: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(category, average): reviews(item, stars) are averaged by item, then by each category of items(item, categories).

    An item's categories are an array; an item without reviews counts for nothing.
    """
    by_item = reviews.groupBy("item").agg(F.avg("stars").alias("stars"))
    each = by_item.join(items, "item").select(F.explode("categories").alias("category"), "stars")
    average = each.groupBy(F.trim("category").alias("category")).agg(F.round(F.avg("stars"), 6).alias("average"))
    return average.orderBy(F.desc("average"), "category").limit(n)


def busy_keys(df: DataFrame, key: str, least: int) -> DataFrame:
    """Keys with more than `least` rows."""
    return count_by(df, key).where(F.col("n") > least)


def semi_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def key_sample(df: DataFrame, key: str, per_mille: int) -> DataFrame:
    """A sample without replacement that any engine draws alike: keys whose hash is low."""
    from tessera.functions.hashing import text_number

    return df.where(F.pmod(text_number(F.col(key).cast("string")), F.lit(1000)) < per_mille)
