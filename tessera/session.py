"""One session factory, and the two ways of cutting a loop's lineage and timing a step."""

from __future__ import annotations

import functools
import logging
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("tessera")


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution, which deletes checkpoints nobody uses; further settings as keywords, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where none is named, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder: a loop's plan stays short, and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def timed(step: Callable) -> Callable:
    """Logs how long step took."""

    @functools.wraps(step)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return step(*args, **kwargs)
        finally:
            log.info("%s took %.3f s", step.__name__, time.perf_counter() - began)

    return run


def partition_sizes(df: DataFrame) -> DataFrame:
    """(partition, n_rows) of df as it is laid out now."""
    from pyspark.sql import functions as F

    return df.groupBy(F.spark_partition_id().cast("long").alias("partition")).agg(F.count("*").alias("n_rows"))
