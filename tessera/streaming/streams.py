"""Structured Streaming: windows, distinct counts, trending tags, sessions and a stateful reservoir.

drain() runs a stream over what there is and returns its last result as a table in the shared folder;
the same plans run for ever with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.hashing import text_number
from tessera.operators.sketch import fm_combined, ranked, zero_runs
from tessera.session import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EVENTS) -> DataFrame:
    """A file stream of one table of a folder; ts becomes a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def socket_lines(spark: SparkSession, port: int, host: str = "localhost") -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def json_stream(lines: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON lines; a line that isn't JSON gives nulls."""
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def drain(stream: DataFrame, mode: str = "complete", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The result of a stream over all that is available; `each` is applied to every micro-batch."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    held = each(spark.createDataFrame([], stream.schema)) if each else stream

    def write(batch: DataFrame, _: int) -> None:
        out = each(batch) if each else batch
        out.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode != "complete":
        spark.createDataFrame([], held.schema).write.mode("append").parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


def run_for(stream: DataFrame, sink: Callable[[DataFrame, int], None], seconds: int, mode: str = "update", every: str = "5 seconds", settled: bool = False):
    """Starts a micro-batch stream, waits `seconds` for it, or only until it has read all there is, stops it and returns the query.

    Its state is in the shared folder.
    """
    state = f"{shared_folder(stream.sparkSession)}/stream-{uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(sink).trigger(processingTime=every).start()
    if settled:
        query.processAllAvailable()
    else:
        query.awaitTermination(seconds)
    query.stop()
    return query


def sliding(size: str = "3 days", slide: str = "1 day", ts: str = "ts"):
    return F.window(ts, size, slide)


def window_counts(events: DataFrame, size: str = "3 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, n_events, n_users): rows and distinct users of each sliding window; of a stream (start, user_id, n), see windows_of.

    A stream's state is a number for each window and user, never a set in one row.
    """
    if events.isStreaming:
        users = events.withWatermark("ts", late).groupBy(sliding(size, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
        return users.select(F.col("w.start").alias("start"), "user_id", "n")
    counts = events.groupBy(sliding(size, slide).alias("w")).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))
    return counts.select(F.col("w.start").alias("start"), "n_events", "n_users")


def windows_of(users: DataFrame) -> DataFrame:
    """(start, n_events, n_users) of a batch of (start, user_id, n)."""
    return users.groupBy("start").agg(F.sum("n").alias("n_events"), F.count("user_id").alias("n_users"))


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def window_estimates(events: DataFrame, size: str = "3 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, estimate): Flajolet-Martin count of the distinct users of each window; the state is 24 numbers a window."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(sliding(size, slide).alias("w")).agg(F.array(*zero_runs(F.col("user_id").cast("string"))).alias("runs"))
    return rows.select(F.col("w.start").alias("start"), fm_combined(F.col("runs")).alias("estimate"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events that are less than gap apart."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tag_counts(events: DataFrame, tag: str = "event_type") -> DataFrame:
    return events.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))


def board(counts: DataFrame, ranks: int = 3) -> DataFrame:
    """(tag, n, rank) of a batch of (tag, n)."""
    return ranked(counts.select("tag", "n"), ranks)


def stateful_reservoir(events: DataFrame, key: str, n: int, shards: int = 8) -> DataFrame:
    """(shard, key, priority): each shard's n rows of lowest hash priority so far, kept in state.

    The n lowest of all shards together are the sample; see lowest().
    """
    rows = events.select(F.col(key).cast("long").alias("key"), text_number(F.col(key).cast("string")).alias("priority"))
    rows = rows.withColumn("shard", F.pmod(F.col("priority"), F.lit(shards)))

    def keep(shard, batches, state: GroupState):
        held = pd.DataFrame(list(zip(*state.get)) if state.exists else [], columns=["key", "priority"], dtype="int64")
        for rows in batches:
            held = pd.concat([held, rows[["key", "priority"]]]).sort_values(["priority", "key"]).head(n)
        state.update((held["key"].tolist(), held["priority"].tolist()))
        yield held.assign(shard=shard[0])[["shard", "key", "priority"]]

    return rows.groupBy("shard").applyInPandasWithState(keep, "shard long, key long, priority long", "keys array<long>, priorities array<long>", "update", GroupStateTimeout.NoTimeout)


def lowest(rows: DataFrame, n: int) -> DataFrame:
    """The n of lowest priority of the shards' samples, whichever batches they were written by."""
    return rows.select("key", "priority").distinct().orderBy("priority", "key").limit(n)
