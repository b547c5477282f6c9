"""Sketches: Bloom filters, Flajolet-Martin counts, hash-priority samples and trending tags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import family, text_number, trailing_zeros, universal
from tessera.functions.vectors import percent_error

HASHES, BITS = 8, 10_000
GROUPS, GROUP_SIZE = 4, 6


def bit_positions(text: Column, hashes: int, bits: int) -> Column:
    x = text_number(text)
    return F.array(*(F.pmod(universal(F.pmod(x, F.lit(2147483647)), a, b), F.lit(bits)) for a, b in family(hashes, seed=6)))


def bloom_bits(keys: DataFrame, key: str, hashes: int = HASHES, bits: int = BITS) -> DataFrame:
    """(pos): the bits that are set, `bits` at most however many keys there are; null and empty keys set none."""
    named = keys.where(F.col(key).cast("string") != "").select(F.col(key).cast("string").alias("key"))
    return named.select(F.explode(bit_positions(F.col("key"), hashes, bits)).alias("pos")).distinct()


def bit_words(set_bits: DataFrame, bits: int = BITS) -> DataFrame:
    """One row with words: the filter as an array of 64-bit numbers, bits / 64 of them."""
    word = set_bits.groupBy(F.floor(F.col("pos") / 64).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))).alias("word"))
    held = word.agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("held"))
    every = F.sequence(F.lit(0).cast("long"), F.lit((bits - 1) // 64).cast("long"))
    return held.select(F.transform(every, lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long"))).alias("words"))


def bloom_probe(rows: DataFrame, key: str, set_bits: DataFrame, hashes: int = HASHES, bits: int = BITS) -> DataFrame:
    """Distinct keys of rows with hit: 1 if all their bits are set, 0 if not or if the key is null or empty."""
    text = F.col(key).cast("string")
    keys = rows.select(text.alias("key")).distinct()
    filled = keys.crossJoin(F.broadcast(bit_words(set_bits, bits)))  # one row of bits / 8 bytes
    all_set = F.forall(bit_positions(F.col("key"), hashes, bits), lambda p: F.getbit(F.element_at("words", F.floor(p / 64).cast("int") + 1), (p % 64).cast("int")) == 1)
    return filled.select("key", F.when(F.coalesce("key", F.lit("")) == "", 0).otherwise(all_set.cast("int")).alias("hit"))


def bloom_error_rate(keys: int, hashes: int = HASHES, bits: int = BITS) -> float:
    return (1 - math.exp(-hashes * keys / bits)) ** hashes


def zero_runs(text: Column) -> list[Column]:
    """For each hash of the family, the longest run of zeros at a hash's end; aggregates."""
    x = F.pmod(text_number(text), F.lit(2147483647))
    return [F.max(trailing_zeros(universal(x, a, b))) for a, b in family(GROUPS * GROUP_SIZE, seed=36)]


def fm_combined(runs: Column) -> Column:
    """Mean over the groups of 2 ** (upper median of the group's runs); 0 if there were no rows."""
    groups = [F.element_at(F.array_sort(F.slice(runs, g * GROUP_SIZE + 1, GROUP_SIZE)), GROUP_SIZE // 2 + 1) for g in range(GROUPS)]
    return F.coalesce(sum((F.pow(F.lit(2.0), g) for g in groups), F.lit(0.0)) / GROUPS, F.lit(0.0))


def distinct_estimates(events: DataFrame, key: str, *by: Column) -> DataFrame:
    """(by..., truth, estimate, error): exact and Flajolet-Martin counts of distinct keys, in constant space."""
    text = F.col(key).cast("string")
    rows = events.groupBy(*by).agg(F.countDistinct(key).alias("truth"), F.array(*zero_runs(text)).alias("runs"))
    rows = rows.withColumn("estimate", fm_combined(F.col("runs"))).drop("runs")
    return rows.withColumn("error", F.round(percent_error(F.col("estimate"), F.col("truth")), 6))


def reservoir(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows drawn without replacement: those whose hash priority is lowest; ties by key. Samples merge."""
    return rows.withColumn("priority", text_number(F.col(key).cast("string"))).orderBy("priority", key).limit(n)


def trending(rows: DataFrame, tag: str, ranks: int = 3) -> DataFrame:
    """(tag, n, rank): all tags whose count is among the `ranks` highest counts. Tags are counted first, so the one window holds a row a tag."""
    return ranked(rows.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n")), ranks)


def ranked(counts: DataFrame, ranks: int = 3) -> DataFrame:
    """(tag, n, rank) of counts(tag, n), those among the `ranks` highest counts."""
    top = counts.select("n").distinct().orderBy(F.desc("n")).limit(ranks)
    rank = F.dense_rank().over(Window.orderBy(F.desc("n"))).cast("long")
    return counts.join(top.select("n", rank.alias("rank")), "n").select("tag", "n", "rank")
