"""Collaborative filtering: Pearson models between items or users, and weighted predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.similarity import agreeing, crowded, lsh_candidates, met, minhash, set_sizes, with_jaccard
from tessera.session import cut

#: Below it a variance is noise, and a correlation undefined.
FLAT = 1e-9


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """From sums; null where either side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > FLAT) & (vy > FLAT), (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))


def co_rated(ratings: DataFrame, member: str, other: str, least: int, candidates: DataFrame | None = None) -> DataFrame:
    """(a, b, n, sim), a < b: Pearson over the `other`s that both rated, at least `least` of them."""
    if candidates is None:
        return correlated(met(rated(ratings, member, other), least))
    one = ratings.select(F.col(other).alias("o"), F.col(member).alias("a"), F.col("stars").alias("x"))
    two = ratings.select(F.col(other).alias("o"), F.col(member).alias("b"), F.col("stars").alias("y"))
    both = candidates.select("a", "b").join(one, "a").join(two, ["b", "o"])
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    return correlated(sums.where(F.col("n") >= least))


def rated(ratings: DataFrame, member: str, other: str) -> DataFrame:
    """(g, m, stars) for similarity.met."""
    return ratings.select(F.col(other).alias("g"), F.col(member).alias("m"), F.col("stars").cast("double").alias("stars"))


def correlated(sums: DataFrame) -> DataFrame:
    return sums.select("a", "b", "n", F.round(pearson(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))), 6).alias("sim"))


def at_least(ratings: DataFrame, member: str, other: str, least: int) -> DataFrame:
    """Ratings of members with at least `least` others."""
    enough = ratings.groupBy(member).agg(F.countDistinct(other).alias("k")).where(F.col("k") >= least)
    return ratings.join(enough.select(member), member, "left_semi")


def item_model(ratings: DataFrame, item: str = "b", user: str = "u", least: int = 3) -> DataFrame:
    """(a, b, n, sim) of items with `least` raters and co-raters, where Pearson is positive."""
    return co_rated(at_least(ratings, item, user, least), item, user, least).where("sim > 0")


def user_model(ratings: DataFrame, user: str = "u", item: str = "b", least: int = 3, hashes: int = 30, rows: int = 1, jaccard: float = 0.01) -> DataFrame:
    """(a, b, n, sim) of users: LSH candidates, verified by Jaccard and co-ratings, where Pearson is positive.

    Where fewer pairs share an item than agree in some band, those are correlated first, and the few that are left must agree.
    """
    enough = cut(at_least(ratings, user, item, least))
    signatures = minhash(enough, user, item, hashes)
    if not crowded(enough, item, signatures, rows):
        sized = rated(enough, user, item).withColumn("size", F.count("*").over(Window.partitionBy("m")))
        return agreeing(correlated(met(sized, least, jaccard)).where("sim > 0"), signatures, rows)
    found = lsh_candidates(signatures, rows)
    left, right = enough.select(F.col(user).alias("a"), F.col(item).alias("g")), enough.select(F.col(user).alias("b"), F.col(item).alias("g"))
    shared = found.join(left, "a").join(right, ["b", "g"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    near = with_jaccard(shared, set_sizes(enough, user, item)).where(F.col("sim") >= jaccard)
    return co_rated(enough, user, item, least, near).where("sim > 0")


def both_ways(model: DataFrame) -> DataFrame:
    """Each pair from both sides; the model is made once."""
    model = cut(model.select("a", "b", "sim"))
    return model.select("a", "b", "sim").unionByName(model.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def top_neighbours(model: DataFrame, n: int) -> DataFrame:
    """(a, rank, b, sim): the n most similar partners of each; ties by partner."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")).cast("long")
    return both_ways(model).withColumn("rank", rank).where(F.col("rank") <= n).select("a", "rank", "b", "sim")


def weighted_mean() -> Column:
    return F.round(F.try_divide(F.sum(F.col("sim") * F.col("stars")), F.sum("sim")), 6)


def item_predictions(pairs: DataFrame, ratings: DataFrame, model: DataFrame, n: int | None = None) -> DataFrame:
    """(u, b, prediction): mean of the user's ratings of the item's neighbours, weighted by similarity.

    All neighbours count, or the n nearest. Pairs without a rated neighbour have no row.
    """
    near = both_ways(model).select(F.col("a").alias("b"), F.col("b").alias("other"), "sim")
    rated = ratings.select("u", F.col("b").alias("other"), "stars")
    found = pairs.select("u", "b").join(near, "b").join(rated, ["u", "other"])
    if n is not None:
        rank = F.row_number().over(Window.partitionBy("u", "b").orderBy(F.desc("sim"), "other"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= n)
    return found.groupBy("u", "b").agg(weighted_mean().alias("prediction")).where("prediction >= 0")


def user_predictions(pairs: DataFrame, ratings: DataFrame, model: DataFrame, n: int = 5, least: int = 5) -> DataFrame:
    """(u, b, prediction): weighted mean of the n nearest users who rated the item, if there are `least`."""
    near = both_ways(model).select(F.col("a").alias("u"), F.col("b").alias("other"), "sim")
    rated = ratings.select(F.col("u").alias("other"), "b", "stars")
    found = pairs.select("u", "b").join(near, "u").join(rated, ["other", "b"])
    each = Window.partitionBy("u", "b")
    found = found.withColumn("rank", F.row_number().over(each.orderBy(F.desc("sim"), "other"))).withColumn("k", F.count("*").over(each))
    found = found.where((F.col("rank") <= n) & (F.col("k") >= least))
    return found.groupBy("u", "b").agg(weighted_mean().alias("prediction")).where("prediction >= 0")
