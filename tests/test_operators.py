"""Operators on hand-made rows, and on a golden graph."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, text, vectors
from tessera.operators import aggregates, baskets, cf, cluster, graph, profiles, similarity, sketch
from tessera.session import partition_sizes, timed


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_clean_words(spark):
    df = spark.createDataFrame([("It's 2 GOOD, really\tgood!",), ("123 !!",), (None,)], "text string")
    assert rows(text.words(df)) == [("good",), ("good",), ("its",), ("really",)]


def test_comma_list(spark):
    df = spark.createDataFrame([("A, B ,C",), (None,)], "c string").select(text.comma_list(F.col("c")).alias("x"))
    assert [r.x for r in df.collect()] == [["A", "B", "C"], ["None"]]


def test_bytes_mod(spark):
    df = spark.createDataFrame([("Las Vegas",), ("",), ("Zürich",)], "s string")
    got = [r[0] for r in df.select(hashing.bytes_mod(F.col("s"), 10_000)).collect()]
    assert got == [8307, 0, int.from_bytes("Zürich".encode(), "big") % 10_000]


def test_trailing_zeros(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (1,), (8,), (12,)], "h long").select(hashing.trailing_zeros(F.col("h"))).collect()]
    assert got == [1, 0, 3, 2]


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 3.0], [2.0, 0.0])], "a array<double>, b array<double>, s array<double>")
    assert df.select(vectors.euclidean(F.col("a"), F.col("b")), vectors.mahalanobis(F.col("a"), F.col("b"), F.col("s"))).first() == (4.0, 2.0)


def test_category_averages_are_means_of_item_means(spark):
    reviews = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, 4.0)], "item long, stars double")
    items = spark.createDataFrame([(1, ["x ", "y"]), (2, ["x"]), (3, ["z"])], "item long, categories array<string>")
    assert rows(aggregates.category_averages(reviews, items, 9)) == [("x", 3.5), ("y", 3.0)]


def test_top_counts_with_fewer_groups_than_asked(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "k string")
    assert [tuple(r) for r in aggregates.top_counts(df, "k", 10).collect()] == [("a", 2), ("b", 1)]


def test_partition_sizes_cover_all_rows(spark):
    assert sum(r.n_rows for r in partition_sizes(spark.range(100).repartition(5, "id")).collect()) == 100


def test_timed_returns_the_result():
    assert timed(lambda x: x + 1)(2) == 3


def brute_itemsets(pairs, support):
    from itertools import combinations

    held = {}
    for basket, item in pairs:
        held.setdefault(basket, set()).add(item)
    count = {}
    for items in held.values():
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                count[c] = count.get(c, 0) + 1
    return {c: n for c, n in count.items() if n >= support}


def test_frequent_itemsets(spark):
    import random

    draw = random.Random(5)
    pairs = [(b, i) for b in range(60) for i in draw.sample("abcdefgh", draw.randrange(1, 6))]
    df = spark.createDataFrame(pairs, "basket long, item string")
    want = brute_itemsets(pairs, 6)
    got = {tuple(r["items"]): r.support for r in baskets.frequent_itemsets(df, 6).collect()}
    assert got == want
    assert {tuple(r["items"]): r.support for r in baskets.fp_growth(df, 6).collect()} == want
    made, frequent = baskets.itemset_levels(df, 6)[1]
    assert {tuple(r[0]) for r in frequent.select("items").collect()} <= {tuple(r[0]) for r in made.collect()}


def test_pairs_of_frequent_items_are_not_listed(spark, monkeypatch):
    """3,000 frequent items, of which two meet often: their four million pairs are never written."""
    written = []
    monkeypatch.setattr(baskets, "cut", lambda df, real=baskets.cut: written.append(real(df)) or written[-1])
    pairs = [(b, i) for i in range(3000) for b in (i, i + 1, i + 2)] + [(b, i) for b in range(9000, 9004) for i in (5, 2000, 2999)]
    df = spark.createDataFrame(pairs, "basket long, item long")
    got = {tuple(r["items"]): r.support for r in baskets.frequent_itemsets(df, 4, 3).collect()}
    assert got == {(5,): 7, (2000,): 7, (2999,): 7, (5, 2000): 4, (5, 2999): 4, (2000, 2999): 4, (5, 2000, 2999): 4}
    got = {tuple(r["items"]): r.support for r in baskets.frequent_itemsets(df, 3, 3).collect()}
    assert len(got) == 3000 + 3 + 1 and got[5, 2000, 2999] == 4
    assert max(df.count() for df in written) <= len(pairs)


def test_baskets_over_a_size(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "u long, i string")
    assert rows(baskets.long_baskets(df, "u", "i", over=1)) == [(1, "a"), (1, "b")]


def test_lsh_pairs_are_exact_pairs(spark):
    import random

    draw = random.Random(3)
    pairs = [(m, g) for m in range(30) for g in draw.sample(range(20), 8)]
    df = spark.createDataFrame(pairs, "m long, g long").distinct()
    exact = {(r.a, r.b): r.sim for r in similarity.jaccard_pairs(df, "m", "g", 0.4).collect()}
    found = {(r.a, r.b): r.sim for r in similarity.lsh_similar_pairs(df, "m", "g", 60, 1, 0.4).collect()}
    assert found.items() <= exact.items()
    assert len(found) >= 0.95 * len(exact) > 0
    ml = {(r.a, r.b) for r in similarity.mllib_similar_pairs(df, "m", "g", 20, 40, 0.4).collect()}
    assert ml <= {p for p in exact}


def meeting_rows():
    """(member, group, stars): one group holds nearly all members, and one member is in nearly all groups."""
    import random

    draw = random.Random(11)
    held = {(m, g) for g in range(40) for m in {*draw.sample(range(60), draw.randrange(0, 9)), 7}} | {(m, 40) for m in range(55)}
    return [(m, g, float(draw.randrange(1, 6))) for m, g in sorted(held)]


def brute_meetings(pairs):
    """{(a, b): [(x, y)]} of the stars in the groups shared."""
    from itertools import combinations

    groups, found = {}, {}
    for m, g, stars in pairs:
        groups.setdefault(g, []).append((m, stars))
    for held in groups.values():
        for (a, x), (b, y) in combinations(sorted(held), 2):
            found.setdefault((a, b), []).append((x, y))
    return found


@pytest.mark.parametrize("text", [False, True])
def test_pairs_are_counted_in_tasks_of_bounded_size(spark, monkeypatch, text):
    monkeypatch.setattr(similarity, "TASK_PAIRS", 50, raising=False)
    monkeypatch.setattr(similarity, "LAID_OUT", 16, raising=False)
    pairs, kind = meeting_rows(), "string" if text else "long"
    named = [(f"m{m:02}" if text else m, g, s) for m, g, s in pairs]
    df = spark.createDataFrame([*named, (None, 3, 1.0), (named[0][0], None, 1.0)], f"m {kind}, g long, stars double")
    want = brute_meetings(named)
    found = similarity.co_counts(df.union(df), "m", "g", 2)  # repeated rows count once
    assert rows(found) == sorted((*p, len(x)) for p, x in want.items() if len(x) >= 2)
    # Tasks grow with the pairs, and no task makes more than its share and one member's.
    assert found.rdd.getNumPartitions() > 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = {m: len({g for n, g, _ in named if n == m}) + (m == named[0][0]) for m, _, _ in named}  # a null group counts in a size, as ever
    near = {p: len(x) / (size[p[0]] + size[p[1]] - len(x)) for p, x in want.items()}
    got = {(r.a, r.b): r.sim for r in similarity.jaccard_pairs(df, "m", "g", 0.2).collect()}
    assert got == {p: j for p, j in near.items() if j >= 0.2} and got


def test_pearson_sums_are_those_of_the_meetings(spark, monkeypatch):
    from statistics import correlation

    monkeypatch.setattr(similarity, "TASK_PAIRS", 50, raising=False)
    pairs = meeting_rows()
    want = {p: x for p, x in brute_meetings(pairs).items() if len(x) >= 3 and all(len({s[k] for s in x}) > 1 for k in (0, 1))}
    found = cf.co_rated(spark.createDataFrame(pairs, "m long, g long, stars double"), "m", "g", 3)
    got = {(r.a, r.b): (r.n, r.sim) for r in found.where("sim is not null").collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[p][0] == len(x) and abs(got[p][1] - correlation(*zip(*x))) < 2e-6 for p, x in want.items())
    assert found.rdd.getNumPartitions() > 10


def test_counts_that_are_made_in_rounds_add_up():
    import numpy as np
    import pyarrow as pa

    lists = [(np.array([2]), np.array([3]), {"m": pa.array([1, 2, 5]), "size": pa.array([4, 2, 3]), "stars": pa.array([1.0, None, 3.0])})]
    once = similarity.counted(None, lists)
    twice = similarity.counted(similarity.counted(once, lists), [])
    assert once.to_pydict() == {"a": [1, 1, 2], "b": [2, 5, 5], "n": [1, 1, 1], "na": [4, 4, 2], "nb": [2, 3, 3], "sx": [1, 1, 0], "sy": [0, 3, 3], "sxx": [1, 1, 0], "syy": [0, 9, 9], "sxy": [0, 3, 0]}
    assert twice.select("ab").to_pydict() == once.select("ab").to_pydict() and twice["n"].to_pylist() == [2, 2, 2] and twice["sxy"].to_pylist() == [0, 6, 0]
    assert similarity.counted(once, lists, 2, 0.5).select(["a", "b"]).to_pydict() == {"a": [1, 2], "b": [2, 5]}


@pytest.mark.parametrize("bound", [0, 100])
def test_lsh_models_are_the_same_in_both_orders(spark, monkeypatch, bound):
    monkeypatch.setattr(similarity, "PAIRS_A_ROW", bound, raising=False)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 50, raising=False)
    pairs = spark.createDataFrame(meeting_rows(), "m long, g long, stars double")
    exact = {(r.a, r.b): r.sim for r in similarity.jaccard_pairs(pairs, "m", "g", 0.1).collect()}
    cand = {(r.a, r.b) for r in similarity.lsh_candidates(similarity.minhash(pairs, "m", "g", 12), 2).collect()}
    asked = []
    monkeypatch.setattr(similarity, "lsh_candidates", lambda *x, real=similarity.lsh_candidates: asked.append(x) or real(*x))
    got = {(r.a, r.b): r.sim for r in similarity.lsh_similar_pairs(pairs, "m", "g", 12, 2, 0.1).collect()}
    assert got == {p: j for p, j in exact.items() if p in cand} and 0 < len(got) < len(exact)
    assert bool(asked) == (not bound)  # only where the groups are large LSH goes first


def test_pearson_leaves_constant_raters_out(spark):
    ratings = spark.createDataFrame(
        [(u, b, s) for u, (x, y, z) in enumerate([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, 6.0, 3.0)]) for b, s in ((1, x), (2, y), (3, z))], "u long, b long, stars double"
    )
    assert rows(cf.item_model(ratings), "a", "b", "n", "sim") == [(1, 2, 3, 1.0)]


def test_user_predictions_need_enough_neighbours(spark):
    model = spark.createDataFrame([(1, k, 0.5) for k in range(2, 8)], "a long, b long, sim double")
    ratings = spark.createDataFrame([(k, 9, float(k)) for k in range(2, 8)] + [(2, 8, 4.0)], "u long, b long, stars double")
    pairs = spark.createDataFrame([(1, 9), (1, 8), (1, 7)], "u long, b long")
    assert rows(cf.user_predictions(pairs, ratings, model, 5, 5)) == [(1, 9, 4.0)]


def test_content_predictions_drop_unknown_ids(spark):
    users = spark.createDataFrame([("u", "a"), ("u", "b")], "user string, word string")
    items = spark.createDataFrame([("i", "a"), ("i", "c")], "id string, word string")
    pairs = spark.createDataFrame([("u", "i"), ("u", "x"), ("y", "i")], "user string, id string")
    assert rows(profiles.content_predictions(pairs, users, items)) == [("u", "i", 0.5)]


PATH = [(1, 2), (2, 3), (3, 4), (10, 11)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components(spark):
    assert rows(graph.components(edges(spark, PATH))) == [(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10)]
    chain = [(k, k + 1) for k in range(40)]
    assert {r.component for r in graph.components(edges(spark, chain)).collect()} == {0}


def test_betweenness_of_a_path(spark):
    assert rows(graph.edge_betweenness(edges(spark, PATH))) == [(1, 2, 3.0), (2, 3, 4.0), (3, 4, 3.0), (10, 11, 1.0)]


def test_shortest_paths_count(spark):
    square = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert (1, 4, 2, 2.0) in rows(graph.shortest_paths(square))


def test_girvan_newman_splits_two_triangles(spark):
    two = edges(spark, [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)])
    best, made = graph.girvan_newman(two, cuts=2)
    assert rows(best) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    assert made[0][:2] == (3, 4)


def test_dense_index_over_ranges(spark):
    ids = spark.createDataFrame([(5,), (900,), (17,), (5,), (None,)], "id long")
    assert rows(graph.dense_index(ids, ranges=2)) == [(5, 0), (17, 1), (900, 2)]
    names = spark.createDataFrame([(w,) for w in "cab"], "id string")
    assert rows(graph.dense_index(names)) == [("a", 0), ("b", 1), ("c", 2)]


def test_string_keys_have_the_signatures_of_their_numbers(spark):
    text = spark.createDataFrame([("x", "b"), ("x", "c"), ("y", "a")], "m string, k string")
    plain = spark.createDataFrame([("x", 1), ("x", 2), ("y", 0)], "m string, k int")
    assert rows(similarity.minhash(text, "m", "k", 7)) == rows(similarity.minhash(plain, "m", "k", 7))


def test_points_that_share_an_id_stay_apart(spark):
    p = spark.createDataFrame([(1, [0.0]), (1, [9.0]), (None, [1.0])], "id long, v array<double>")
    centres = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "cluster long, centre array<double>")
    assert sorted((r.v[0], r.cluster) for r in cluster.nearest(p, centres).collect()) == [(0.0, 0), (1.0, 0), (9.0, 1)]
    stats = cluster.cluster_stats(spark.createDataFrame([(0, [-1.0]), (0, [1.0])], "cluster long, v array<double>"))
    assert cluster.mahalanobis_assign(p, stats).count() == 3


def test_son_equals_the_levels(spark, monkeypatch):
    import random

    draw = random.Random(4)
    pairs = spark.createDataFrame([(b, i) for b in range(300) for i in {int(draw.paretovariate(0.8)) for _ in range(9)} if i < 40], "basket int, item int")
    want = rows(baskets.frequent_itemsets(pairs, 25))
    assert rows(baskets.son(pairs, 25)) == want and max(r[0] for r in want) >= 3
    assert rows(baskets.son(pairs, 25, 2)) == [r for r in want if r[0] <= 2]
    monkeypatch.setattr(baskets, "CANDIDATES", 3)
    assert rows(baskets.son(pairs, 25)) == want
    assert baskets.son(pairs.limit(0), 3).count() == 0


def golden(name):
    """Lines of a file of published results, which an environment variable names."""
    import os

    if not os.path.isfile(os.environ.get(name, "")):
        pytest.skip(f"{name} names no file")
    with open(os.environ[name]) as f:
        return f.read().splitlines()


@pytest.fixture(scope="module")
def published(spark):
    found = {}
    for line in golden("GOLDEN_BETWEENNESS"):
        ends, value = line.rsplit("), ", 1)
        found[tuple(sorted(x.strip(" '") for x in ends.strip("(").split(",")))] = float(value)
    return found, spark.createDataFrame(list(found), "src string, dst string")


def test_betweenness_equals_the_published_one(published):
    want, graph_edges = published
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(graph_edges).collect()}
    assert got.keys() == want.keys() and len(want) == 498
    assert all(math.isclose(got[e], v, rel_tol=1e-9, abs_tol=1e-6) for e, v in want.items())


def test_modularity_of_the_published_communities(spark, published):
    groups = [[x.strip(" '") for x in line.split(",")] for line in golden("GOLDEN_COMMUNITIES") if line.strip()]
    labels = spark.createDataFrame([(x, k) for k, g in enumerate(groups) for x in g], "id string, label int")
    assert len(groups) == 19 and graph.modularity(published[1], labels).first()[0] == 0.687255




def test_label_propagation_is_a_partition(spark):
    got = rows(graph.label_propagation(edges(spark, PATH), 5))
    assert [r[0] for r in got] == [1, 2, 3, 4, 10, 11]


def brandes(pairs):
    """Edge betweenness of an undirected graph, from each root in turn."""
    from collections import defaultdict, deque

    near, total = defaultdict(set), defaultdict(float)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for root in near:
        level, sigma, order, queue = {root: 0}, defaultdict(float, {root: 1.0}), [], deque([root])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in near[u]:
                if v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
                if level[v] == level[u] + 1:
                    sigma[v] += sigma[u]
        credit = dict.fromkeys(order, 1.0)
        for v in reversed(order):
            for u in near[v]:
                if level[u] == level[v] - 1:
                    share = credit[v] * sigma[u] / sigma[v]
                    credit[u] += share
                    total[min(u, v), max(u, v)] += share / 2
    return total


@pytest.mark.parametrize("sent", [0, 1000])
def test_betweenness_of_a_random_graph(spark, monkeypatch, sent):
    import random

    monkeypatch.setattr(graph, "SENT_EDGES", sent)
    draw = random.Random(21)
    pairs = sorted({tuple(sorted(draw.sample(range(40), 2))) for _ in range(70)})
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges(spark, pairs)).collect()}
    want = brandes(pairs)
    assert got.keys() == set(pairs)
    assert all(math.isclose(got[p], want[p], abs_tol=2e-6) for p in pairs)


def test_modularity_of_two_triangles(spark):
    two = edges(spark, [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)])
    labels = spark.createDataFrame([(k, int(k > 3)) for k in range(1, 7)], "id long, label int")
    assert graph.modularity(two, labels).first()[0] == round(6 / 7 - 0.5, 6)


def blobs(spark, n=40):
    import random

    draw = random.Random(9)
    data = [(k, [10.0 * (k % 3) + draw.gauss(0, 0.3), 5.0 * (k % 3) + draw.gauss(0, 0.3)]) for k in range(n)]
    return spark.createDataFrame(data, "id long, v array<double>")


def test_kmeans_finds_blobs(spark):
    got = {r.id: r.cluster for r in cluster.kmeans(blobs(spark), 3).collect()}
    assert len({(k % 3, c) for k, c in got.items()}) == 3


def test_outliers(spark):
    data = [(k, [float(k % 2)]) for k in range(10)] + [(99, [50.0])]
    df = spark.createDataFrame(data, "id long, v array<double>").withColumn("cluster", F.lit(0).cast("long"))
    assert [r.id for r in cluster.outlier_split(df, 2.0).where("outlier").collect()] == [99]


def test_merged_stats_equal_whole_stats(spark):
    p = blobs(spark).withColumn("cluster", F.col("id") % 3)
    whole = cluster.stats_rows(cluster.cluster_stats(p))
    parts = cluster.stats_rows(cluster.merge_stats(*(cluster.cluster_stats(p.where(F.col("id") % 2 == k)) for k in (0, 1))))
    assert rows(whole) == rows(parts)


def test_bfr_conserves_points(spark):
    p, job = blobs(spark, 120), cluster.Bfr(3)
    for k in range(3):
        job.add(p.where((F.col("id") / 40).cast("int") == k), last=k == 2)
    final = job.rounds(spark).orderBy(F.desc("round_id")).first()
    assert final.nof_point_discard + final.nof_point_compression + final.nof_point_retained == 120
    assert job.clusters().count() == 120 == job.clusters().select("id").distinct().count()


def test_bloom_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(200)] + [("",), (None,)], "k string")
    got = {r.key: r.hit for r in sketch.bloom_probe(keys, "k", sketch.bloom_bits(keys, "k")).collect()}
    assert all(got[f"k{i}"] == 1 for i in range(200)) and got[""] == got[None] == 0
    other = spark.createDataFrame([(f"x{i}",) for i in range(300)], "k string")
    wrong = sum(r.hit for r in sketch.bloom_probe(other, "k", sketch.bloom_bits(keys, "k")).collect())
    assert wrong <= 5 + 300 * 3 * sketch.bloom_error_rate(200)


def test_distinct_estimate_is_near(spark):
    rows_ = spark.range(4000).select((F.col("id") % 1000).alias("k"))
    got = sketch.distinct_estimates(rows_, "k").first()
    assert got.truth == 1000 and 250 <= got.estimate <= 4000
    assert sketch.distinct_estimates(rows_.limit(0), "k").first().estimate == 0


def test_trending_ranks_are_dense(spark):
    df = spark.createDataFrame([(t,) for t in "aaabbbccde"], "t string")
    assert rows(sketch.trending(df, "t", 2)) == [("a", 3, 1), ("b", 3, 1), ("c", 2, 2)]


def test_reservoirs_merge(spark):
    df = spark.range(1000)
    whole = rows(sketch.reservoir(df, "id", 20))
    halves = sketch.reservoir(df.where("id % 2 = 0"), "id", 20).union(sketch.reservoir(df.where("id % 2 = 1"), "id", 20))
    assert rows(sketch.reservoir(halves.select("id"), "id", 20)) == whole
