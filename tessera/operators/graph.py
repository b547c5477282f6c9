"""Graphs: co-review edges, communities by labels, components and betweenness cuts, modularity.

edges(src, dst) holds each undirected edge once, src < dst.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import dense_index as dense_index
from tessera.operators.similarity import co_counts
from tessera.session import cut

#: Edges of a graph that is sent to all tasks, which then share out the roots; paths of larger ones are found by joins.
SENT_EDGES = 1_000_000


def coreview_edges(pairs: DataFrame, member: str, group: str, least: int) -> DataFrame:
    """(src, dst, n): members that share at least `least` groups; others aren't in the graph."""
    return co_counts(pairs, member, group, least).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


def strongest(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("n"), "src", "dst").limit(n)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after `rounds` synchronous rounds; of equally frequent labels the lowest wins."""
    links = cut(both_ways(edges))
    labels = links.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        heard = links.join(labels, links.dst == labels.id).groupBy("src", "label").agg(F.count("*").alias("k"))
        labels = cut(heard.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct(-F.col("k"), "label")).alias("label")))
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(members): the sorted ids of each label."""
    return labels.groupBy(label).agg(F.sort_array(F.collect_list("id")).alias("members")).select("members")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each vertex's component, named by its lowest id. Large and small stars in turn."""
    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    known = None
    while (now := e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != known:
        known = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def shortest_paths(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, level, sigma): distance and number of shortest paths from each root (all vertices if none)."""
    links = cut(both_ways(edges))
    start = links.select(F.col("src").alias("id")).distinct() if roots is None else roots
    frontier = cut(start.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).cast("long").alias("level"), F.lit(1.0).alias("sigma")))
    reached, before, level = frontier, frontier.limit(0), 0
    while not frontier.isEmpty():
        level += 1
        step = frontier.join(links, frontier.node == links.src).groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        # In an undirected graph a step leads to this level, the one before it, or a new one.
        old = frontier.select("root", "node").union(before.select("root", "node"))
        new = cut(step.join(old, ["root", "node"], "left_anti").select("root", "node", F.lit(level).cast("long").alias("level"), "sigma"))
        before, frontier = frontier, new
        reached = reached.union(new)
    return reached


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness): credits of all shortest paths, handed from each level to the one above it."""
    edges = cut(edges.select("src", "dst"))
    if edges.count() <= SENT_EDGES:
        return betweenness_by_roots(edges)
    links = both_ways(edges)
    paths = cut(shortest_paths(edges))
    deepest = paths.agg(F.max("level")).first()[0] or 0
    credit = paths.where(F.col("level") == deepest).select("root", "node", "sigma", F.lit(1.0).alias("credit"))
    parts = None
    for level in range(deepest, 0, -1):
        above = paths.where(F.col("level") == level - 1).select("root", F.col("node").alias("parent"), F.col("sigma").alias("paths"))
        down = credit.join(links, credit.node == links.src).select("root", "node", F.col("dst").alias("parent"), "sigma", "credit")
        flow = cut(down.join(above, ["root", "parent"]).select("root", "node", "parent", (F.col("credit") * F.col("paths") / F.col("sigma")).alias("flow")))
        parts = flow if parts is None else parts.union(flow)
        gained = flow.groupBy("root", F.col("parent").alias("node")).agg(F.sum("flow").alias("gained"))
        here = paths.where(F.col("level") == level - 1)
        credit = here.join(gained, ["root", "node"], "left").select("root", "node", "sigma", (1.0 + F.coalesce("gained", F.lit(0.0))).alias("credit"))
    if parts is None:
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness"))
    ends = parts.groupBy(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    return ends.agg(F.round(F.sum("flow") / 2, 6).alias("betweenness"))


def betweenness_by_roots(edges: DataFrame) -> DataFrame:
    """As edge_betweenness, for a graph that a task can hold: each task takes some roots and sums up their credits."""
    spark, rows = edges.sparkSession, edges.toArrow()
    m = rows.num_rows
    if not m:
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness"))
    both = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks]).combine_chunks().dictionary_encode()
    src, dst, n = both.indices.to_numpy()[:m].astype(np.int64), both.indices.to_numpy()[m:].astype(np.int64), len(both.dictionary)
    order = np.argsort(np.concatenate((src, dst)), kind="stable")
    start = np.searchsorted(np.concatenate((src, dst))[order], np.arange(n + 1))
    graph = spark.sparkContext.broadcast((start, np.concatenate((dst, src))[order], np.concatenate((np.arange(m), np.arange(m)))[order]))

    def run(batches):
        start, to, edge = graph.value
        n, total = len(start) - 1, np.zeros(len(to) // 2)
        for root in (r for batch in batches for r in batch.column("id").to_pylist()):
            level, sigma, credit = np.full(n, -1), np.zeros(n), np.ones(n)
            level[root], sigma[root], frontier, layers = 0, 1.0, np.array([root]), []
            while len(frontier):
                size = start[frontier + 1] - start[frontier]
                at = np.repeat(start[frontier] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                above, below = np.repeat(frontier, size), to[at]
                fresh = np.unique(below[level[below] < 0])
                level[fresh] = len(layers) + 1
                down = level[below] == len(layers) + 1
                above, below = above[down], below[down]
                sigma += np.bincount(below, sigma[above], n)
                layers.append((above, below, edge[at][down]))
                frontier = fresh
            for above, below, edges in reversed(layers):
                flow = credit[below] * sigma[above] / sigma[below]
                total += np.bincount(edges, flow, len(total))
                credit += np.bincount(above, flow, n)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["edge", "flow"])

    roots = spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism)))
    flows = roots.mapInArrow(run, "edge long, flow double").groupBy("edge").agg(F.round(F.sum("flow") / 2, 6).alias("betweenness"))
    names = spark.createDataFrame(rows.append_column("edge", pa.array(np.arange(m))))
    return names.join(flows, "edge").select("src", "dst", "betweenness")


def modularity(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """(q): sum over communities of inner edges / m - (degree / 2m) ** 2, over the edges given."""
    a, b = labels.select(F.col("id").alias("src"), F.col(label).alias("la")), labels.select(F.col("id").alias("dst"), F.col(label).alias("lb"))
    m = edges.agg(F.count("*").alias("m"))
    inner = edges.join(a, "src").join(b, "dst").where("la = lb").groupBy(F.col("la").alias("c")).agg(F.count("*").alias("inner"))
    degree = degrees(edges).join(labels, "id").groupBy(F.col(label).alias("c")).agg(F.sum("degree").alias("degree"))
    each = degree.join(inner, "c", "left").crossJoin(F.broadcast(m))  # m is one row
    share = F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2.0 * F.col("m")), 2)
    return each.agg(F.round(F.sum(share), 6).alias("q"))


def girvan_newman(edges: DataFrame, cuts: int | None = None) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """(id, community) of the best division, and the cuts as (src, dst, modularity after it).

    Each cut takes the edge of highest betweenness (ties by edge), and modularity is always that of the
    original edges. It stops at the first decrease, or after `cuts` cuts if they are given. Only the community
    that is cut is computed again.
    """
    whole = cut(edges.select("src", "dst"))

    def divided(ids: DataFrame, left: DataFrame) -> DataFrame:
        return ids.join(components(left), "id", "left").select("id", F.coalesce("component", "id").alias("community"))

    best = now = cut(divided(vertices(whole), whole))
    score, made = modularity(whole, best, "community").first()[0], []
    last, between = score, cut(edge_betweenness(whole))
    while (top := between.orderBy(F.desc("betweenness"), "src", "dst").first()) and (cuts is None or len(made) < cuts):
        community = now.where(F.col("id") == top.src).first().community
        inside = cut(now.where(F.col("community") == community).select("id"))
        ends = inside.select(F.col("id").alias("src"))
        left = cut(between.join(ends, "src", "left_semi").where((F.col("src") != top.src) | (F.col("dst") != top.dst)).select("src", "dst"))
        now = cut(now.where(F.col("community") != community).union(divided(inside, left)))
        between = cut(between.join(ends, "src", "left_anti").select("src", "dst", "betweenness").union(edge_betweenness(left)))
        q = modularity(whole, now, "community").first()[0]
        made.append((top.src, top.dst, q))
        if cuts is None and q < last - 1e-9:
            break
        if q > score + 1e-9:
            score, best = q, now
        last = q
    return best, made
