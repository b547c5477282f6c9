"""Set similarity: exact co-occurrence, MinHash signatures, LSH bands and verified pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.hashing import family, universal
from tessera.functions.vectors import jaccard
from tessera.operators.index import numbered
from tessera.session import cut

#: Pairs that meet in one task, about; all pairs of one member meet in one.
TASK_PAIRS = 1 << 21
#: Items of lists that are laid out at once.
LAID_OUT = 1 << 18
#: Pairs a row up to which LSH isn't asked which pairs to verify.
PAIRS_A_ROW = 100


def met(rows: DataFrame, least: int = 1, near: float = 0.0) -> DataFrame:
    """(a, b, n), a < b, of the members that share n groups, `least` of them at least, of rows(g, m); a null g or m makes no pair.

    With a column size, which is a member's own, there are also its sizes na and nb, and only pairs of Jaccard >= near. With a column
    stars there are also sx, sy, sxx, syy and sxy, sums over the groups shared, where a null counts as 0.

    Pairs are never shuffled, as they grow with the square of a group, but lists of its members: members are parted into
    ranges that make about TASK_PAIRS pairs each, and a group's list goes to the parts that its members are in, once to each
    and from its first member there on. A part is a task, which counts its pairs; so its memory doesn't grow with the input.
    """
    names = [c for c in rows.columns if c != "g"]
    items = F.sort_array(F.collect_list(F.struct(*names))).alias("items")
    groups = rows.where("g is not null and m is not null").groupBy("g").agg(items).where(F.size("items") > 1)
    groups = cut(groups.select(*(F.col(f"items.{c}").alias(c) for c in names)))
    kinds = {f.name: to_arrow_type(f.dataType) for f in groups.schema}
    lists, kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema), rows.schema["m"].dataType.simpleString()

    def bounds(batches):
        total, last = 0, -1
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = total + np.cumsum(n)
            part = (ends - n) // TASK_PAIRS
            total, new = int(ends[-1]) if len(n) else total, np.flatnonzero(np.diff(part, prepend=last))
            last = part[-1] if len(n) else last
            yield pa.RecordBatch.from_arrays([batch.column("m").take(pa.array(new))], ["m"])

    each = groups.select(F.posexplode("m").alias("i", "m"), F.size("m").alias("k"))
    weights = each.groupBy("m").agg(F.sum(F.col("k") - 1 - F.col("i")).alias("n")).repartitionByRange("m").sortWithinPartitions("m")
    low = np.sort(weights.mapInArrow(bounds, f"m {kind}").toArrow()["m"].to_numpy())

    def route(batches):
        for batch in batches:
            start = batch.column("m").offsets.to_numpy().astype(np.int64)
            start, flat = start - start[0], {c: batch.column(c).flatten() for c in names}
            part = np.searchsorted(low, flat["m"].to_numpy(zero_copy_only=False), side="right") - 1
            new = np.append(np.ones(min(1, len(part)), bool), part[1:] != part[:-1])
            new[start[:-1]] = True
            first = np.flatnonzero(new)
            heads = np.append(first[1:], len(part)) - first
            many = start[np.searchsorted(start, first, side="right")] - first
            first, heads, many = (x[many > 1] for x in (first, heads, many))
            for k in np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(many) // LAID_OUT)) + 1):
                at, offsets = pa.array(ranges(first[k], many[k])), pa.array(np.append(0, np.cumsum(many[k])).astype(np.int32))
                columns = [pa.ListArray.from_arrays(offsets, flat[c].take(at)).cast(kinds[c]) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(part[first[k]].astype(np.int32)), pa.array(heads[k].astype(np.int32)), *columns], ["part", "heads", *names])

    def count(batches):
        held, waiting, pairs = None, [], 0
        for batch in batches:
            heads, many = batch.column("heads").to_numpy().astype(np.int64), np.diff(batch.column("m").offsets.to_numpy()).astype(np.int64)
            waiting.append((heads, many, {c: batch.column(c).flatten() for c in names}))
            pairs += int((heads * many - heads * (heads + 1) // 2).sum())
            if pairs > 2 * TASK_PAIRS:
                held, waiting, pairs = counted(held, waiting), [], 0
        if held is not None or waiting:
            yield from counted(held, waiting, least, near).to_batches()

    columns = f"a {kind}, b {kind}, n long" + ", na long, nb long" * ("size" in names) + "".join(f", {c} double" for c in SUMS if "stars" in names)
    routed = groups.mapInArrow(route, f"part int, heads int, {lists}").repartitionById(max(1, len(low)), "part")
    return routed.mapInArrow(count, columns)


SUMS = ("sx", "sy", "sxx", "syy", "sxy")


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[k] successive numbers from first[k] on, for each k."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def counted(held: pa.Table | None, lists: list[tuple], least: int = 1, near: float = 0.0) -> pa.Table:
    """held, as met returns it, with the pairs of further lists (heads, sizes, columns), of which the first heads[k] members meet all after them."""
    flat = {c: pa.chunked_array([x[2][c] for x in lists]) for c in (lists[0][2] if lists else ())}
    old = 0 if held is None else held.num_rows
    member = pa.chunked_array([*(held["a"].chunks + held["b"].chunks if old else ()), *(flat["m"].chunks if flat else ())]).combine_chunks().dictionary_encode()
    of, name, known = member.indices.to_numpy().astype(np.int64), member.dictionary, len(member.dictionary)
    a, b, of = of[:old], of[old : 2 * old], of[2 * old :]
    heads, many = (np.concatenate([x[k] for x in lists] or [np.zeros(0, np.int64)]) for k in (0, 1))
    begin = np.cumsum(many) - many
    x = ranges(begin, heads)
    after = np.repeat(begin + many, heads) - x - 1
    y, x = ranges(x + 1, after), np.repeat(x, after)
    code = np.concatenate((a * known + b, of[x] * known + of[y]))
    n = np.concatenate((held["n"].to_numpy(), np.ones(len(x), np.int64))) if old else None
    value = np.sort(code)
    new = np.flatnonzero(np.append(np.ones(min(1, len(value)), bool), value[1:] != value[:-1]))
    value, total = value[new], np.diff(np.append(new, len(value)))
    if old:
        total = np.bincount(np.searchsorted(value, code), n, len(value)).astype(np.int64)
    ok = (total >= least) & (value // known != value % known)
    if "size" in flat or old and "na" in held.column_names:
        size = np.zeros(known, np.int64)
        size[of] = flat["size"].to_numpy() if flat else 0
        if old:
            size[a], size[b] = held["na"].to_numpy(), held["nb"].to_numpy()
        na, nb = size[value // known], size[value % known]
        ok &= total / (na + nb - total) >= near
        na, nb = na[ok], nb[ok]
    value, total = value[ok], total[ok]
    out = {"a": name.take(pa.array(value // known)), "b": name.take(pa.array(value % known)), "n": pa.array(total)}
    if "size" in flat or old and "na" in held.column_names:
        out |= {"na": pa.array(na), "nb": pa.array(nb)}
    if "stars" in flat or old and "sx" in held.column_names:
        at = np.searchsorted(value, code)
        mine = np.append(value, -1)[at] == code
        at, pair = at[mine], np.flatnonzero(mine[old:])
        stars = flat["stars"].combine_chunks().fill_null(0.0).to_numpy() if flat else np.zeros(0)
        p, q = stars[x[pair]], stars[y[pair]]
        for c, each in zip(SUMS, (p, q, p * p, q * q, p * q)):
            weight = np.concatenate((held[c].to_numpy()[mine[:old]], each)) if old else each
            out[c] = pa.array(np.bincount(at, weight, len(value)))
    return pa.table(out)


def co_counts(pairs: DataFrame, member: str, group: str, least: int = 1) -> DataFrame:
    """(a, b, n), a < b: members that share at least `least` groups.

    Members meet in the groups that they share and are counted, so no member is compared with one it shares nothing with.
    """
    return met(pairs.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct(), least)


def set_sizes(pairs: DataFrame, member: str, group: str) -> DataFrame:
    return pairs.select(member, group).distinct().groupBy(F.col(member).alias("id")).agg(F.count("*").alias("size"))


def with_jaccard(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, sim) of (a, b, n)."""
    left, right = sizes.select(F.col("id").alias("a"), F.col("size").alias("na")), sizes.select(F.col("id").alias("b"), F.col("size").alias("nb"))
    return shared.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("n"), F.col("na"), F.col("nb")).alias("sim"))


def jaccard_pairs(pairs: DataFrame, member: str, group: str, least: float) -> DataFrame:
    """(a, b, sim) of all pairs of members that share a group and whose sets of groups have Jaccard >= least. Sizes travel with the members."""
    rows = pairs.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    sized = rows.withColumn("size", F.count("*").over(Window.partitionBy("m")))
    return met(sized, near=least).select("a", "b", jaccard(F.col("n"), F.col("na"), F.col("nb")).alias("sim"))


def minhash(pairs: DataFrame, member: str, number: str, n: int) -> DataFrame:
    """(id, signature): array of n minima, made in one aggregation with partial minima; keys that aren't whole numbers are indexed first."""
    minima = [F.min(universal(F.col(number), a, b)) for a, b in family(n)]
    return numbered(pairs, number).groupBy(F.col(member).alias("id")).agg(F.array(*minima).alias("signature"))


def signature_rows(signatures: DataFrame) -> DataFrame:
    """(id, h, value), h from 0."""
    return signatures.select("id", F.posexplode("signature").alias("h", "value")).withColumn("h", F.col("h").cast("long"))


def band_keys(rows: int) -> Column:
    count = F.size("signature") / rows
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda k: F.array_join(F.transform(F.slice("signature", k * rows + 1, rows), lambda v: v.cast("string")), "-"))


def bands(signatures: DataFrame, rows: int) -> DataFrame:
    """(id, band, key): key holds the band's values themselves, so only equal bands meet."""
    return signatures.select("id", F.posexplode(band_keys(rows)).alias("band", "key"))


def lsh_candidates(signatures: DataFrame, rows: int) -> DataFrame:
    """(a, b), a < b: members that agree in some band of `rows` values."""
    one = bands(signatures, rows)
    two = one.select("band", "key", F.col("id").alias("b"))
    return one.withColumnRenamed("id", "a").join(two, ["band", "key"]).where("a < b").select("a", "b").distinct()


def crowded(pairs: DataFrame, group: str, signatures: DataFrame, rows: int) -> bool:
    """Whether more pairs of members share a group than agree in some band, counted as often as they do; up to PAIRS_A_ROW a row nothing else is counted."""
    k = F.col("count").cast("double")
    both = F.coalesce(F.sum(k * (k - 1) / 2), F.lit(0.0))
    shared, n = pairs.where(F.col(group).isNotNull()).groupBy(group).count().agg(both, F.coalesce(F.sum(k), F.lit(0.0))).first()
    return shared > PAIRS_A_ROW * n and shared > bands(signatures, rows).groupBy("band", "key").count().agg(both).first()[0]


def agreeing(pairs: DataFrame, signatures: DataFrame, rows: int) -> DataFrame:
    """The pairs(a, b, ...) whose signatures agree in some band of `rows` values."""
    keys = signatures.select("id", band_keys(rows).alias("keys"))
    both = pairs.join(keys.select(F.col("id").alias("a"), F.col("keys").alias("left")), "a").join(keys.select(F.col("id").alias("b"), F.col("keys").alias("right")), "b")
    return both.where(F.exists(F.zip_with("left", "right", lambda x, y: x == y), lambda same: same)).select(*pairs.columns)


def lsh_similar_pairs(pairs: DataFrame, member: str, number: str, n: int, rows: int, least: float) -> DataFrame:
    """(a, b, sim): candidates of LSH whose exact Jaccard is >= least.

    Where fewer pairs share a group than agree in some band, those are verified first, and the few that are left must agree.
    """
    sets = cut(pairs.select(F.col(member).alias("id"), F.col(number).alias("g")).distinct())
    signatures = minhash(sets, "id", "g", n)
    if least > 0 and not crowded(sets, "g", signatures, rows):
        return agreeing(jaccard_pairs(sets, "id", "g", least), signatures, rows)
    found = lsh_candidates(signatures, rows)
    left, right = sets.withColumnRenamed("id", "a"), sets.withColumnRenamed("id", "b")
    shared = found.join(left, "a").join(right, ["b", "g"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return with_jaccard(shared, set_sizes(sets, "id", "g")).where(F.col("sim") >= least)


def mllib_similar_pairs(pairs: DataFrame, member: str, number: str, dims: int, tables: int, least: float) -> DataFrame:
    """(a, b, sim) by MLlib's MinHashLSH, as a second way."""
    from pyspark.ml.feature import MinHashLSH
    from pyspark.ml.feature import CountVectorizerModel

    items = F.collect_set(F.col(number).cast("string")).alias("items")
    sets = pairs.groupBy(F.col(member).alias("id")).agg(items)
    sparse = CountVectorizerModel.from_vocabulary([str(k) for k in range(dims)], "items", "features")
    rows = sparse.transform(sets).select("id", "features")
    found = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=tables, seed=553).fit(rows).approxSimilarityJoin(rows, rows, 1.0 - least, "distance")
    return found.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), (1.0 - F.col("distance")).alias("sim")).where("a < b")
