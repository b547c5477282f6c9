"""Writers: JSON, CSV, Parquet and the text reports. Text is formatted by Spark, where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """A block of rows a round or micro-batch."""
    df.write.mode("append").option("header", True).csv(path)


def write_model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_models(parts: dict[str, DataFrame], folder: str) -> None:
    """A model of several tables, each in a folder of its name."""
    for name, df in parts.items():
        write_model(df, f"{folder}/{name}")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def quoted(items: Column) -> Column:
    """'a', 'b' of an array of strings."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(size, line): the itemsets(items) of each size on one line, ('a', 'b'),('a', 'c'), in their order."""
    shown = itemsets.select(F.size("items").alias("size"), "items", F.concat(F.lit("("), quoted(F.col("items")), F.lit(")")).alias("shown"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("items", "shown"))), lambda x: x["shown"]), ",")
    return shown.groupBy("size").agg(line.alias("line"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """(value): the report's lines in order: Candidates, a line a size, then the frequent itemsets."""

    def section(title: str, at: int, itemsets: DataFrame) -> DataFrame:
        spark = itemsets.sparkSession
        head = spark.createDataFrame([(at, 0, title)], "part int, size int, value string")
        return head.union(itemset_lines(itemsets).select(F.lit(at), "size", "line"))

    both = section("Candidates:", 0, candidates).union(section("Frequent Itemsets:", 1, frequent))
    return both.orderBy("part", "size").select("value")


def edge_lines(edges: DataFrame, value: str) -> DataFrame:
    """('u', 'v'), value by falling value, then by edge."""
    return edges.orderBy(F.desc(value), "src", "dst").select(F.format_string("('%s', '%s'), %s", F.col("src").cast("string"), F.col("dst").cast("string"), F.col(value).cast("string")).alias("value"))


def community_lines(members: DataFrame) -> DataFrame:
    """One community(members) a line, small ones first."""
    return members.orderBy(F.size("members"), "members").select(quoted(F.col("members")).alias("value"))


def cluster_map(assigned: DataFrame) -> DataFrame:
    """(value): one JSON object {point: cluster}, -1 where there is none."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("id").alias("key"), F.coalesce("cluster", F.lit(-1)).alias("value"))))
    text = F.transform(entries, lambda e: F.format_string('"%d": %d', e["key"], e["value"].cast("long")))
    return assigned.agg(F.concat(F.lit("{"), F.array_join(text, ", "), F.lit("}")).alias("value"))


def bit_line(predictions: DataFrame) -> DataFrame:
    """(value): predictions(row, hit) as 0 and 1, in the order of row, with spaces."""
    bits = F.transform(F.array_sort(F.collect_list(F.struct("row", F.col("hit").cast("int").alias("hit")))), lambda x: x["hit"].cast("string"))
    return predictions.agg(F.array_join(bits, " ").alias("value"))


def board_lines(ranked: DataFrame) -> DataFrame:
    """(value): "tag : count" of ranked(tag, n, rank), best first: one block of a trending board."""
    return ranked.orderBy("rank", "tag").select(F.format_string("%s : %d", "tag", "n").alias("value"))
