"""Clustering: farthest-first seeds, K-Means, outliers, additive statistics, Mahalanobis assignment, BFR.

points(id, v) have array<double> vectors. Clusters are few, so their statistics are one row each and travel
to the points; points never travel to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import deviation, euclidean, mahalanobis
from tessera.session import cut


def dimensions(points: DataFrame) -> int:
    row = points.select(F.size("v")).first()
    return row[0] if row else 0


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points with cluster and distance of the nearest of centres(cluster, centre); ties by cluster.

    centres has one row for each cluster, k of them, whatever the points are: they travel as one row, and
    each point finds its own without a shuffle.
    """
    every = centres.agg(F.collect_list(F.struct("cluster", "centre")).alias("centres"))
    choice = F.array_min(F.transform("centres", lambda c: F.struct(euclidean(F.col("v"), c["centre"]).alias("distance"), c["cluster"].alias("cluster"))))
    found = points.crossJoin(F.broadcast(every)).withColumn("best", choice)
    return found.select(*points.columns, F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))


def centre_frame(spark, centres: list[tuple[int, list[float]]]) -> DataFrame:
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in centres], "cluster long, centre array<double>")


def farthest_first(points: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """k (id, v): the lowest id, then each time the point farthest from all chosen; ties by lowest id.

    The few chosen ones travel to the points each time; nothing is kept for a point in between.
    """
    points = cut(points.select("id", "v"))
    first = points.orderBy("id").first()
    chosen = [(first.id, first.v)] if first else []
    while chosen and len(chosen) < k:
        away = nearest(points, centre_frame(points.sparkSession, list(enumerate(v for _, v in chosen))))
        best = away.agg(F.max_by(F.struct("id", "v", "distance"), F.struct("distance", -F.col("id"))).alias("p")).first().p
        if best.distance == 0:
            break
        chosen.append((best.id, best.v))
    return chosen


def kmeans(points: DataFrame, k: int, rounds: int = 26, moved: float = 0.005, seeds: list | None = None) -> DataFrame:
    """(id, v, cluster, distance) by Lloyd's rounds from farthest-first seeds; clusters are 0, 1, ....

    It stops after `rounds`, or when at most the share `moved` of the points changed (never early if
    it is negative). A cluster that loses its last point keeps its centre.
    """
    points = cut(points.select("id", "v"))
    dims = dimensions(points)
    centres = [(j, list(v)) for j, (_, v) in enumerate(seeds or farthest_first(points, k))]
    if not centres:
        return points.select("id", "v", F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("distance"))
    total, before = points.count(), None
    for _ in range(rounds):
        new = nearest(points, centre_frame(points.sparkSession, centres))
        if before is not None and moved >= 0:
            # Where a point was follows from the centres before: nothing is kept for a point.
            was = nearest(points.select("id", "v"), centre_frame(points.sparkSession, before)).select("v", F.col("cluster").alias("was"))
            both = nearest(was, centre_frame(points.sparkSession, centres))
            sums = both.groupBy("cluster").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(dims))).alias("centre"), F.count_if(F.col("cluster") != F.col("was")).alias("changed")).collect()
            if sum(r.changed for r in sums) <= moved * total:
                break
        else:
            sums = new.groupBy("cluster").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(dims))).alias("centre")).collect()
        means = {r.cluster: r.centre for r in sums}
        before, centres = centres, [(j, means.get(j, centre)) for j, centre in centres]
    return nearest(points, centre_frame(points.sparkSession, centres))


def centres_of(assigned: DataFrame) -> DataFrame:
    dims = dimensions(assigned)
    return assigned.groupBy("cluster").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(dims))).alias("centre"), F.count("*").alias("n"))


def mllib_kmeans(points: DataFrame, k: int, seed: int = 553) -> DataFrame:
    """(id, cluster) by MLlib, as a second way."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select("id", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("cluster"))


def outlier_split(assigned: DataFrame, factor: float) -> DataFrame:
    """(id, cluster, distance, outlier): farther than factor times its cluster's mean radius from the centre.

    The centre is the mean of the cluster's points and stays put while points are tested.
    """
    centre = centres_of(assigned).select("cluster", "centre")
    away = assigned.select("id", "v", "cluster").join(centre, "cluster").withColumn("distance", euclidean(F.col("v"), F.col("centre")))
    radius = away.groupBy("cluster").agg((F.avg("distance") * factor).alias("most"))
    return away.join(radius, "cluster").select("id", "cluster", F.round("distance", 6).alias("distance"), (F.col("distance") > F.col("most")).alias("outlier"))


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """(cluster, n, s, sq): size, and sums and sums of squares by dimension, made without exploding the vectors."""
    dims = dimensions(assigned)
    s = F.array(*(F.sum(F.col("v")[i]) for i in range(dims))).alias("s")
    sq = F.array(*(F.sum(F.col("v")[i] * F.col("v")[i]) for i in range(dims))).alias("sq")
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), s, sq)


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Statistics of the same clusters, added up."""
    every = stats[0]
    for more in stats[1:]:
        every = every.unionByName(more)
    dims = every.select(F.size("s")).first()
    sums = [F.array(*(F.sum(F.col(c)[i]) for i in range(dims[0] if dims else 0))).alias(c) for c in ("s", "sq")]
    return every.groupBy("cluster").agg(F.sum("n").alias("n"), *sums)


def stats_rows(stats: DataFrame) -> DataFrame:
    """(cluster, dim, n, sum, sumsq), a row a dimension, from 0."""
    rows = stats.select("cluster", "n", F.posexplode(F.arrays_zip("s", "sq")).alias("dim", "x"))
    return rows.select("cluster", F.col("dim").cast("long").alias("dim"), "n", F.round("x.s", 6).alias("sum"), F.round("x.sq", 6).alias("sumsq"))


def with_shape(stats: DataFrame) -> DataFrame:
    """stats with centre and std."""
    centre = F.transform("s", lambda x: x / F.col("n"))
    std = F.zip_with("s", "sq", lambda s, q: deviation(F.col("n"), s, q))
    return stats.withColumn("centre", centre).withColumn("std", std)


def mahalanobis_assign(points: DataFrame, stats: DataFrame, alpha: float = 2.0) -> DataFrame:
    """(id, v, cluster, distance): the nearest cluster below alpha * sqrt(d), else null in both.

    stats has one row for each cluster, however many points there are; they travel to the points as one row.
    """
    dims = dimensions(points)
    every = with_shape(stats).agg(F.collect_list(F.struct("cluster", "centre", "std")).alias("shapes"))
    choice = F.array_min(F.transform("shapes", lambda c: F.struct(mahalanobis(F.col("v"), c["centre"], c["std"]).alias("distance"), c["cluster"].alias("cluster"))))
    best = points.select("id", "v").crossJoin(F.broadcast(every)).select("id", "v", choice.alias("best"))
    near = F.col("best.distance") < alpha * math.sqrt(max(dims, 1))
    return best.select("id", "v", F.when(near, F.col("best.cluster")).alias("cluster"), F.when(near, F.col("best.distance")).alias("distance"))


Stats = dict[int, tuple[int, list[float], list[float]]]


def collected(stats: DataFrame, first: int = 0) -> Stats:
    """Statistics of few clusters on the driver, numbered from `first` in the order of their clusters."""
    return {first + k: (r.n, list(r.s), list(r.sq)) for k, r in enumerate(stats.orderBy("cluster").collect())}


def stats_frame(spark, stats: Stats) -> DataFrame:
    return spark.createDataFrame([(k, n, s, q) for k, (n, s, q) in stats.items()], "cluster long, n long, s array<double>, sq array<double>")


def added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])], [x + y for x, y in zip(a[2], b[2])]


def between(a: tuple, b: tuple) -> float:
    """Mahalanobis distance of a's centre from b."""
    out = 0.0
    for sa, sb, qb in zip(a[1], b[1], b[2]):
        std = math.sqrt(abs(qb / b[0] - (sb / b[0]) ** 2)) or 1.0
        out += ((sa / a[0] - sb / b[0]) / std) ** 2
    return math.sqrt(out)


def merge_close(stats: Stats, most: float) -> tuple[Stats, dict[int, int]]:
    """Merges the closest pair below `most` until there is none; also returns {old cluster: new}."""
    stats, into = dict(stats), {k: k for k in stats}
    while True:
        pairs = [(between(stats[a], stats[b]), a, b) for a in stats for b in stats if a < b]
        if not pairs or min(pairs)[0] >= most:
            return stats, into
        _, a, b = min(pairs)
        stats[a] = added(stats[a], stats.pop(b))
        into = {k: a if v == b else v for k, v in into.items()}


class Bfr:
    """BFR over chunks of points: discard set, compression set and retained points.

    Only statistics and (id, cluster) remain of points once they are assigned. Compression clusters are
    numbered from 1,000,000, so no number is ever used for both kinds.
    """

    APART = 1_000_000

    def __init__(self, k: int, alpha: float = 2.0, spread: int = 3, trigger: int = 6, factor: float = 2.0):
        self.k, self.alpha, self.spread, self.trigger, self.factor = k, alpha, spread, trigger, factor
        self.discard: Stats = {}
        self.compression: Stats = {}
        self.retained: DataFrame | None = None
        self.assigned: list[DataFrame] = []
        self.renamed: dict[int, int] = {}
        self.next, self.report = self.APART, []

    def limit(self) -> float:
        return self.alpha * math.sqrt(self.dims)

    def _take(self, points: DataFrame, stats: Stats) -> tuple[DataFrame, Stats]:
        """Assigns what is near enough; returns the points that are left and the grown statistics."""
        if not stats:
            return points, stats
        found = cut(mahalanobis_assign(points, stats_frame(points.sparkSession, stats), self.alpha))
        near = found.where("cluster is not null")
        self.assigned.append(near.select("id", "cluster"))
        grown = {r.cluster: (r.n, list(r.s), list(r.sq)) for r in cluster_stats(near).collect()}
        stats = {k: added(s, grown[k]) if k in grown else s for k, s in stats.items()}
        return found.where("cluster is null").select("id", "v"), stats

    def _group(self, points: DataFrame, k: int) -> tuple[DataFrame, Stats, DataFrame]:
        """(points alone, statistics of clusters of two or more, their (id, cluster)); outliers are alone."""
        found = cut(kmeans(points, k))
        split = outlier_split(found, self.factor).where("not outlier").select("id", "cluster")
        crowd = split.join(split.groupBy("cluster").count().where("count > 1").select("cluster"), "cluster")
        inner = cut(points.join(crowd, "id"))
        stats = cluster_stats(inner).orderBy("cluster").collect()
        number = {r.cluster: self.next + j for j, r in enumerate(stats)}
        self.next += len(stats)
        names = points.sparkSession.createDataFrame(list(number.items()), "cluster long, named long")
        member = inner.join(F.broadcast(names), "cluster").select("id", F.col("named").alias("cluster"))
        return points.join(inner.select("id"), "id", "left_anti"), {number[r.cluster]: (r.n, list(r.s), list(r.sq)) for r in stats}, member

    def add(self, points: DataFrame, last: bool = False) -> None:
        points = cut(points.select("id", "v"))
        if not self.discard:
            self.dims = dimensions(points)
            found = cut(kmeans(points, self.k))
            split = cut(found.join(outlier_split(found, self.factor).select("id", "outlier"), "id"))
            inner = split.where("not outlier")
            self.discard = {r.cluster: (r.n, list(r.s), list(r.sq)) for r in cluster_stats(inner).collect()}
            self.assigned.append(inner.select("id", "cluster"))
            rest = split.where("outlier").select("id", "v")
        else:
            rest, self.discard = self._take(points, self.discard)
            rest, self.compression = self._take(rest, self.compression)
        self.retained = cut(rest if self.retained is None else self.retained.unionByName(rest))
        if self.retained.count() > self.trigger * self.k:
            alone, stats, member = self._group(self.retained, self.spread * self.k)
            self.retained, self.compression = cut(alone), self.compression | stats
            self.assigned.append(cut(member))
        self.compression, into = merge_close(self.compression, self.limit())
        self._rename(into)
        if last:
            for c, stats in sorted(self.compression.items()):
                near = min(((between(stats, d), k) for k, d in self.discard.items()), default=(math.inf, None))
                if near[0] < self.limit():
                    self.discard[near[1]] = added(self.discard[near[1]], self.compression.pop(c))
                    self._rename({c: near[1]})
        row = (len(self.report) + 1, len(self.discard), sum(s[0] for s in self.discard.values()), len(self.compression), sum(s[0] for s in self.compression.values()), self.retained.count())
        self.report.append(row)

    def _rename(self, into: dict[int, int]) -> None:
        self.renamed = {k: into.get(v, v) for k, v in self.renamed.items()} | {k: v for k, v in into.items() if k not in self.renamed}

    def rounds(self, spark) -> DataFrame:
        names = "round_id long, nof_cluster_discard long, nof_point_discard long, nof_cluster_compression long, nof_point_compression long, nof_point_retained long"
        return spark.createDataFrame(self.report, names)

    def clusters(self) -> DataFrame:
        """(id, cluster) of all points; null for those that are still retained."""
        every = self.retained.select("id", F.lit(None).cast("long").alias("cluster"))
        for part in self.assigned:
            every = every.unionByName(part.select("id", "cluster"))
        moved = {k: v for k, v in self.renamed.items() if k != v}
        if not moved:
            return every
        names = every.sparkSession.createDataFrame(list(moved.items()), "cluster long, named long")
        return every.join(F.broadcast(names), "cluster", "left").select("id", F.coalesce("named", "cluster").alias("cluster"))
