"""Dense numbers for keys of any type that can be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.session import cut


def dense_index(ids: DataFrame, id: str = "id", ranges: int | None = None) -> DataFrame:
    """(id, index): 0, 1, ... in the order of the distinct ids, numbers, strings or dates; null has none.

    Ids are partitioned by ranges, numbered within them, and ranges are offset by their counts, so no task
    sorts them all. The ranges are kept once they are drawn, as they are sampled.
    """
    rows = ids.select(F.col(id).alias("id")).where("id is not null").distinct()
    rows = rows.repartitionByRange(*([ranges] if ranges else []), "id")
    rows = cut(rows.select("id", F.spark_partition_id().alias("range")))
    counts = rows.groupBy("range").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select("range", before.alias("before"))  # a row a partition
    number = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    return rows.withColumn("number", number).join(offset, "range").select("id", (F.col("before") + F.col("number")).alias("index"))


def numbered(pairs: DataFrame, column: str) -> DataFrame:
    """pairs with a column of keys replaced by their dense index; whole numbers stay as they are."""
    if isinstance(pairs.schema[column].dataType, IntegralType):
        return pairs
    index = dense_index(pairs, column)
    joined = pairs.join(index.withColumnRenamed("id", column), column)
    return joined.select(*(F.col("index").alias(c) if c == column else F.col(c) for c in pairs.columns))
