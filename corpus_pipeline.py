"""From raw documents to training windows, in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. run() writes each stage's rows as Parquet in the shared folder and reads them again, so no
stage is ever computed twice, whatever is lost.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents
from tessera.llm.exact_dedup import without_copies
from tessera.llm.ngram_join import without_near_copies
from tessera.llm.packing import packed
from tessera.llm.substring import without_repeats
from tessera.llm.toxicity import without_toxic
from tessera.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity grammar rejects; the labels beside the documents teach it.

    Rows with a null or empty text or a null doc_id are judged like any other, repeated rows each; an empty
    table stays empty. All columns stay, whatever their names.
    """
    return without_toxic(docs, documents(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of byte-identical texts, that of the lowest doc_id; of repeated rows one stays.

    Rows with a null doc_id or text stay, and so do other texts of a copy's doc_id. Empty texts are copies of each other.
    """
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the lowest doc_id.

    Rows with a null doc_id, and null, empty and wordless texts have no near copies and stay.
    """
    return without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier out of the texts, however long these are; no row is dropped.

    Rows with a null doc_id or text are unchanged; a text of which nothing is left stays as an empty one.
    """
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training windows of several sizes; texts without words, null ones too, have no row."""
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Toxicity, substring dedup and packing aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed windows of the documents in sf_dir; an empty table gives no rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stage's rows once the next stage's are written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
