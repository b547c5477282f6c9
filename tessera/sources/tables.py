"""Readers: text, JSON lines, CSV and Parquet, always with a schema that is given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, stars double, state string, city string"
USER_ITEM = "user_id string, business_id string"
PAIR_MODEL = "id1 string, id2 string, sim double"
TWEET = "entities struct<hashtags:array<struct<text:string>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timestamped(df: DataFrame, *columns: str) -> DataFrame:
    """df with its TIMESTAMP_NTZ columns as timestamps, which watermarks need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing key is null."""
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def points(spark: SparkSession, path: str | list[str], dims: int) -> DataFrame:
    """(id, v) of a headerless CSV: a number and `dims` coordinates."""
    names = [f"x{k}" for k in range(dims)]
    rows = spark.read.schema("id double, " + ", ".join(f"{n} double" for n in names)).csv(path)
    return rows.select(F.col("id").cast("long").alias("id"), F.array(*names).alias("v"))


def chunks(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """The files of a folder in the order of their names, for jobs that take one each round."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in status if s.isFile() and s.getPath().getName().endswith(suffix) and s.getPath().getName()[0] not in "._")


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word), one a line, trimmed; empty lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def symmetric_model(model: DataFrame) -> DataFrame:
    """(id1, id2, sim) in both directions, from a model that stores each pair once."""
    return model.select("id1", "id2", "sim").unionByName(model.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "sim"))


def models(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The tables of a model that sinks.write_models wrote."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def tags(tweets: DataFrame) -> DataFrame:
    """(tag) of each hashtag that is ASCII letters throughout; tweets without one give no row."""
    return tweets.select(F.explode("entities.hashtags.text").alias("tag")).where(F.col("tag").rlike("^[A-Za-z]+$"))
