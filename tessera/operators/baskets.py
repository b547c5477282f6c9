"""Frequent itemsets: baskets, A-Priori by levels, SON in two passes, and FP-growth as a third way."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from tessera.operators.similarity import met
from tessera.session import cut

#: Candidates that SON sends to every task, at most; with more, itemsets are counted by levels.
CANDIDATES = 200_000


def long_baskets(df: DataFrame, basket: str, item: str, over: int = 0) -> DataFrame:
    """Distinct (basket, item) of baskets with more than `over` items."""
    pairs = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    if not over:
        return pairs
    return pairs.join(pairs.groupBy("basket").count().where(F.col("count") > over).select("basket"), "basket")


def basket_rows(pairs: DataFrame) -> DataFrame:
    """(basket, items, n): sorted items of each basket."""
    return pairs.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("n", F.size("items").cast("long"))


def candidates(frequent: DataFrame, k: int) -> DataFrame:
    """(items) of size k whose subsets of size k - 1 are all in frequent(items)."""
    head = F.slice("items", 1, k - 2) if k > 2 else F.array().cast(frequent.schema["items"].dataType)
    sided = frequent.select(head.alias("head"), F.element_at("items", -1).alias("last"))
    right = sided.select("head", F.col("last").alias("next"))
    made = sided.join(right, "head").where("last < next").select(F.concat("head", F.array("last", "next")).alias("items"))
    if k == 2:
        return made
    subsets = made.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.filter("items", lambda x, j: j + 1 != i))).alias("subset"))
    whole = subsets.join(frequent.select(F.col("items").alias("subset")), "subset", "left_semi").groupBy("items").count()
    return whole.where(F.col("count") == k).select("items")


def itemset_levels(pairs: DataFrame, support: int, most: int | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """[(candidates(items), frequent(items, support))] for sizes 1, 2, ... until a level is empty.

    Pairs are counted without a list of candidates, which would be all pairs of frequent items. From there on a level's
    occurrences, one row for each basket and frequent itemset in it, are kept and extended by a later item of the same
    basket; so no basket is compared with every candidate. Items that are in no frequent itemset of a level are left out after it.
    """
    pairs = cut(pairs)
    first = pairs.groupBy("item").count()
    frequent = cut(first.where(F.col("count") >= support).select(F.array("item").alias("items"), F.col("count").alias("support")))
    levels = [(first.select(F.array("item").alias("items")), frequent)]
    items = pairs.join(frequent.select(F.col("items")[0].alias("item")), "item", "left_semi")
    held = None
    k = 2
    while (most is None or k <= most) and not frequent.isEmpty():
        made = candidates(frequent.select("items"), k)
        if k == 2:
            found = met(items.select(F.col("basket").alias("g"), F.col("item").alias("m")), support)
            frequent = found.select(F.array("a", "b").alias("items"), F.col("n").alias("support"))
        else:
            made = cut(made)
            longer = held.join(items, "basket").where(F.col("item") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("item")).alias("items"))
            held = longer.join(made, "items", "left_semi")
            frequent = held.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support)
        frequent = cut(frequent.select("items", "support"))
        if frequent.isEmpty():
            break
        levels.append((made, frequent))
        if most is None or k < most:
            items = cut(items.join(frequent.select(F.explode("items").alias("item")).distinct(), "item", "left_semi"))
            if k == 2:
                held = items.join(items.select("basket", F.col("item").alias("next")), "basket").where("item < next").select("basket", F.array("item", "next").alias("items"))
            held = cut(held.join(frequent.select("items"), "items", "left_semi").select("basket", "items"))
        k += 1
    return levels


def frequent_itemsets(pairs: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """(size, items, support) of all frequent itemsets."""
    out = None
    for k, (_, frequent) in enumerate(itemset_levels(pairs, support, most), 1):
        level = frequent.select(F.lit(k).cast("long").alias("size"), "items", "support")
        out = level if out is None else out.union(level)
    return out


def itemsets_of_size(pairs: DataFrame, support: int, k: int) -> DataFrame:
    """(items, support) of the frequent itemsets of size k."""
    return frequent_itemsets(pairs, support, k).where(F.col("size") == k).select("items", "support")


def fp_growth(pairs: DataFrame, support: int) -> DataFrame:
    """(size, items, support), by MLlib's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    rows = basket_rows(pairs).select("items")
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).cast("long").alias("size"), "items", F.lit(0).cast("long").alias("support"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (support - 0.5) / n)).fit(rows).freqItemsets
    return found.select(F.size("items").cast("long").alias("size"), F.sort_array("items").alias("items"), F.col("freq").alias("support"))


def bitmaps(basket: pa.Array, item: pa.Array, share: float, only: set | None = None) -> tuple[list, np.ndarray, int]:
    """(items, bits, baskets): the baskets, as packed bits, of each item of `share` of them at least, or of `only`; items in order."""
    codes, names = basket.dictionary_encode().indices.to_numpy(), item.dictionary_encode()
    n, of, known = int(codes.max(initial=-1)) + 1, names.indices.to_numpy(), names.dictionary.to_pylist()
    enough = np.bincount(of, minlength=len(known)) >= max(1.0, share * n)
    keep = sorted((name, k) for k, name in enumerate(known) if enough[k] and (only is None or name in only))
    place = np.full(len(known), -1)
    place[[k for _, k in keep]] = np.arange(len(keep))
    bits = np.zeros((len(keep), -(-n // 8)), np.uint8)
    row = place[of]
    np.bitwise_or.at(bits, (row[row >= 0], codes[row >= 0] // 8), np.uint8(128) >> (codes[row >= 0] % 8).astype(np.uint8))
    return [name for name, _ in keep], bits, n


def local_itemsets(bits: np.ndarray, support: float, most: int | None) -> list[tuple[int, ...]]:
    """Itemsets of at least `support` of a partition's baskets: each is extended by later items while it is frequent."""
    found, stack = [], [((), np.flatnonzero(np.bitwise_count(bits).sum(1) >= support), None)]
    while stack:
        head, tail, common = stack.pop()
        for j, k in enumerate(tail.tolist()):
            mine = bits[k] if common is None else common & bits[k]
            found.append((*head, k))
            rest = tail[j + 1 :]
            if len(rest) and (most is None or len(head) + 1 < most):
                rest = rest[np.bitwise_count(bits[rest] & mine).sum(1) >= support]
                if len(rest):
                    stack.append(((*head, k), rest, mine))
    return found


def son(pairs: DataFrame, support: int, most: int | None = None) -> DataFrame:
    """(size, items, support) of all frequent itemsets, in SON's two passes over baskets(basket, item).

    First each partition finds what is frequent among its own baskets, at a support scaled to its share of
    them: no itemset is frequent that isn't so in some partition. Then all partitions count those candidates.
    Candidates travel to the tasks only if they are CANDIDATES at most; else itemset_levels counts by joins.
    """
    # So many partitions at most that each still asks for some baskets.
    parts = max(1, min(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), support // 4))
    held = cut(pairs.where("basket is not null and item is not null").distinct().repartition(parts, "basket"))
    total = max(1, held.select("basket").distinct().count())
    items = f"array<{held.schema['item'].dataType.simpleString()}>"
    kind = to_arrow_type(ArrayType(held.schema["item"].dataType))

    def read(batches, share, only=None):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return None
        rows = pa.Table.from_batches(batches)
        return bitmaps(rows["basket"].combine_chunks(), rows["item"].combine_chunks(), share, only)

    def local(batches):
        part = read(batches, support / total)
        if part is not None:
            names, bits, n = part
            found = local_itemsets(bits, max(1.0, support * n / total), most)
            yield pa.RecordBatch.from_arrays([pa.array([[names[k] for k in x] for x in found], kind)], ["items"])

    candidates = cut(held.mapInArrow(local, f"items {items}").distinct())
    if candidates.count() > CANDIDATES:
        return frequent_itemsets(pairs, support, most)
    asked = [r[0] for r in candidates.collect()]

    def count(batches):
        part = read(batches, 0.0, {i for x in asked for i in x})
        if part is not None:
            names, bits, _ = part
            at = {name: k for k, name in enumerate(names)}
            mine = [x for x in asked if all(i in at for i in x)]
            n = [int(np.bitwise_count(np.bitwise_and.reduce(bits[[at[i] for i in x]])).sum()) for x in mine]
            yield pa.RecordBatch.from_arrays([pa.array(mine, kind), pa.array(n, pa.int64())], ["items", "n"])

    counts = held.mapInArrow(count, f"items {items}, n long").groupBy("items").agg(F.sum("n").alias("support"))
    return counts.where(F.col("support") >= support).select(F.size("items").cast("long").alias("size"), "items", "support")
