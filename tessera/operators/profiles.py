"""Content-based recommendation: TF-IDF profiles of items, profiles of users, cosine predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.functions.vectors import cosine
from tessera.session import cut


def document_frequency(occurrences: DataFrame) -> DataFrame:
    """(word, df): in how many of (id, word)'s ids each word occurs."""
    return occurrences.distinct().groupBy("word").agg(F.count("*").alias("df"))


def tfidf(docs: DataFrame, id: str, text: str = "text", stop: DataFrame | None = None) -> DataFrame:
    """(id, word, score): frequency over the id's highest, times log2(ids / ids with the word)."""
    found = words(docs.withColumnRenamed(id, "id") if id != "id" else docs, text, ("id",))
    if stop is not None:
        found = found.join(stop, "word", "left_anti")
    tf = cut(found.groupBy("id", "word").agg(F.count("*").alias("tf")))  # four uses
    most = tf.groupBy("id").agg(F.max("tf").alias("most"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = tf.agg(F.countDistinct("id").alias("n"))
    scored = tf.join(most, "id").join(df, "word").crossJoin(F.broadcast(n))  # n is one row
    return scored.select("id", "word", F.round(F.col("tf") / F.col("most") * F.log2(F.col("n") / F.col("df")), 6).alias("score"))


def item_profiles(docs: DataFrame, id: str, n: int = 200, text: str = "text", stop: DataFrame | None = None) -> DataFrame:
    """(id, word, score, rank): the n best words of each item; ties by word."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "word")).cast("long")
    return tfidf(docs, id, text, stop).withColumn("rank", rank).where(F.col("rank") <= n)


def user_profiles(reviews: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user, word): the words of all items that the user reviewed; reviews is (user, id)."""
    return reviews.distinct().join(profiles.select("id", "word"), "id").select("user", "word").distinct()


def content_predictions(pairs: DataFrame, users: DataFrame, profiles: DataFrame, least: float = 0.01) -> DataFrame:
    """pairs(user, id) with sim, the cosine of their word sets, where it is >= least; unknown ones have none."""
    items = profiles.select("id", "word").distinct()
    nu = users.groupBy("user").agg(F.count("*").alias("nu"))
    ni = items.groupBy("id").agg(F.count("*").alias("ni"))
    both = pairs.join(users, "user").join(items, ["id", "word"]).groupBy(*pairs.columns).agg(F.count("*").alias("both"))
    scored = both.join(nu, "user").join(ni, "id").withColumn("sim", F.round(cosine(F.col("both"), F.col("nu"), F.col("ni")), 6))
    return scored.where(F.col("sim") >= least).select(*pairs.columns, "sim")
