"""Named queries over the test tables, and the SQL that gives the same rows.

Stand-ins: user = o_custkey, item = l_partkey, stars = ceil(l_quantity / 10); an item's categories are
the words of p_name; text = documents by source (item) and lang (user); points = embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uuid import uuid4

from tessera.functions.hashing import bytes_mod
from tessera.functions.text import STOPWORDS, comma_list, words
from tessera.functions.vectors import percent_error
from tessera.operators import aggregates, baskets, cf, cluster, graph, profiles, similarity, sketch
from tessera.plans import oracle
from tessera.session import cut, partition_sizes, shared_folder
from tessera.sources import sinks, tables
from tessera.sources.tables import table, timestamped
from tessera.streaming import push, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- stand-ins -------------------------------------------------------------------------------


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """(u, b, stars), a row a line item."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("b"), F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"))


def user_items(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).select("u", "b").distinct()


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("u", "b").agg(F.avg("stars").alias("stars"))


def held_out() -> F.Column:
    return F.pmod(F.col("u") * 7 + F.col("b") * 13, F.lit(50)) == 0


def brand_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "p_brand")


def brand_baskets(spark: SparkSession, d: str) -> DataFrame:
    return baskets.long_baskets(brand_pairs(spark, d), "l_orderkey", "p_brand")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", "lang", "text")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, for what a query writes and reads again."""
    return f"{shared_folder(spark)}/written-{uuid4().hex}"


def stopwords(spark: SparkSession) -> DataFrame:
    """The list, written as a text file and read again."""
    folder = scratch(spark)
    sinks.write_lines(spark.createDataFrame([(w,) for w in STOPWORDS], "value string"), folder)
    return tables.stopwords(spark, folder)


def top_edges(spark: SparkSession, d: str, n: int = 200) -> DataFrame:
    return cut(graph.strongest(graph.coreview_edges(user_items(spark, d), "u", "b", 2), n).select("src", "dst"))


def points(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"), F.col("label").cast("long").alias("label"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return timestamped(table(spark, d, "events"), "ts")


def shown(itemsets: DataFrame) -> DataFrame:
    return itemsets.withColumn("items", F.array_join("items", ","))


# --- exploration -----------------------------------------------------------------------------


@query
def review_count(spark, d):
    return aggregates.row_count(table(spark, d, "orders"))


@query
def reviews_in_year(spark, d):
    return aggregates.count_in_year(table(spark, d, "orders"), "o_orderdate", 1997)


@query
def reviews_by_year(spark, d):
    year = F.substring(F.col("o_orderdate").cast("string"), 1, 4).cast("long").alias("year")
    return aggregates.count_by(table(spark, d, "orders"), year)


@query
def distinct_users(spark, d):
    return aggregates.distinct_count(table(spark, d, "orders"), "o_custkey")


@query
def top_users(spark, d):
    return aggregates.top_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "user_id", 10)


@query
def top_words(spark, d):
    return aggregates.top_words(texts(spark, d), 50)


@query
def top_words_no_stopwords(spark, d):
    return aggregates.top_words(texts(spark, d), 50, stop=stopwords(spark))


@query
def category_avg_topn(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.split("p_name", " ").alias("categories"))
    return aggregates.category_averages(reviews(spark, d).withColumnRenamed("b", "item"), items, 20)


@query
def busy_items(spark, d):
    return aggregates.busy_keys(table(spark, d, "lineitem").select(F.col("l_partkey").alias("item")), "item", 40)


@query
def items_per_partition(spark, d):
    return partition_sizes(table(spark, d, "lineitem").repartition(8, "l_partkey"))


@query
def semi_join_subset(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return aggregates.semi_join(table(spark, d, "customer"), nations, "c_nationkey").select("c_custkey", "c_nationkey")


@query
def anti_join_subset(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return aggregates.anti_join(table(spark, d, "customer"), nations, "c_nationkey").select("c_custkey", "c_nationkey")


@query
def inner_join_totals(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def json_fields(spark, d):
    k = F.from_json("props", "k long")["k"].alias("k")
    return aggregates.count_by(table(spark, d, "events"), k)


@query
def union_distinct(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b).distinct()


@query
def non_empty_filter(spark, d):
    return table(spark, d, "events").where("event_type <> ''").select("event_type").distinct()


@query
def alphabetic_words(spark, d):
    found = words(texts(spark, d)).where(F.col("word").rlike("^[A-Za-z]+$"))
    return aggregates.top_counts(found, "word", 100)


@query
def hash_sample(spark, d):
    return aggregates.key_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10)


@query
def text_numbers(spark, d):
    return table(spark, d, "nation").select("n_name", bytes_mod(F.col("n_name"), 10_000).alias("h"))


# --- baskets ---------------------------------------------------------------------------------


@query
def basket_case1(spark, d):
    rows = baskets.basket_rows(baskets.long_baskets(user_items(spark, d), "u", "b"))
    return rows.select("basket", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n")


@query
def basket_case2(spark, d):
    rows = baskets.basket_rows(baskets.long_baskets(user_items(spark, d), "b", "u"))
    return rows.select("basket", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n")


@query
def basket_size_filter(spark, d):
    return baskets.long_baskets(user_items(spark, d), "u", "b", over=50).groupBy("basket").agg(F.count("*").alias("n"))


@query
def frequent_itemsets(spark, d):
    return shown(baskets.son(brand_baskets(spark, d), 20))


def _level(k: int) -> Query:
    return lambda spark, d: shown(baskets.itemsets_of_size(brand_baskets(spark, d), 20, k))


QUERIES |= {f"apriori_{k}": _level(k) for k in (1, 2, 3, 4)}


@query
def fpgrowth_itemsets(spark, d):
    return shown(baskets.fp_growth(brand_baskets(spark, d), 20))


@query
def sparse_itemsets(spark, d):
    found = baskets.frequent_itemsets(baskets.long_baskets(user_items(spark, d), "u", "b"), 4, 3)
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query
def itemset_report(spark, d):
    levels = baskets.itemset_levels(brand_baskets(spark, d), 20)
    made = frequent = None
    for candidates, level in levels:
        made = candidates if made is None else made.union(candidates)
        frequent = level.select("items") if frequent is None else frequent.union(level.select("items"))
    return sinks.itemset_report(made, frequent)


# --- similarity ------------------------------------------------------------------------------


@query
def cooccurrence_pairs(spark, d):
    return similarity.co_counts(user_items(spark, d), "b", "u", 5)


@query
def jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(user_items(spark, d), "b", "u", 0.05).withColumn("sim", F.round("sim", 6))


@query
def minhash_signature(spark, d):
    return similarity.signature_rows(similarity.minhash(user_items(spark, d), "b", "u", 30))


@query
def minhash_text_keys(spark, d):
    """As minhash_signature, with users named by strings."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("u"), "c_name")
    pairs = user_items(spark, d).join(names, "u").select("b", "c_name")
    return similarity.signature_rows(similarity.minhash(pairs, "b", "c_name", 30))


@query
def lsh_candidates(spark, d):
    return similarity.lsh_candidates(similarity.minhash(user_items(spark, d), "b", "u", 30), 2)


@query
def lsh_similar_pairs(spark, d):
    return similarity.lsh_similar_pairs(user_items(spark, d), "b", "u", 60, 1, 0.05).withColumn("sim", F.round("sim", 6))


# --- recommendation --------------------------------------------------------------------------


@query
def doc_frequency(spark, d):
    return profiles.document_frequency(words(texts(spark, d), keep=("source",))).where("df > 1")


@query
def tfidf_top_words(spark, d):
    return profiles.item_profiles(texts(spark, d), "source", 200)


@query
def user_profile(spark, d):
    seen = texts(spark, d).select(F.col("lang").alias("user"), F.col("source").alias("id"))
    return profiles.user_profiles(seen, profiles.item_profiles(texts(spark, d), "source", 200))


@query
def model_pair(spark, d):
    """Both profile tables, written as one model and loaded again."""
    seen = texts(spark, d).select(F.col("lang").alias("user"), F.col("source").alias("id"))
    items = cut(profiles.item_profiles(texts(spark, d), "source", 200))
    folder = scratch(spark)
    sinks.write_models({"items": items, "users": profiles.user_profiles(seen, items)}, folder)
    loaded = tables.models(spark, folder, "items", "users")
    counts = [m.groupBy(F.lit(name).alias("model"), F.col(key).alias("id")).agg(F.count("*").alias("n")) for (name, m), key in zip(loaded.items(), ("id", "user"))]
    return counts[0].union(counts[1])


@query
def content_predict(spark, d):
    every = cut(texts(spark, d))
    seen = every.select(F.col("lang").alias("user"), F.col("source").alias("id")).distinct()
    items = cut(profiles.item_profiles(every, "source", 200))
    return profiles.content_predictions(seen, cut(profiles.user_profiles(seen, items)), items)


@query
def item_pearson(spark, d):
    return cf.item_model(ratings(spark, d))


@query
def user_pearson_lsh(spark, d):
    return cf.user_model(ratings(spark, d))


@query
def top_neighbours(spark, d):
    return cf.top_neighbours(cf.item_model(ratings(spark, d)), 5)


@query
def item_cf_predict(spark, d):
    every = cut(ratings(spark, d))
    known = every.where(~held_out())
    return cf.item_predictions(every.where(held_out()), known, cf.item_model(known))


@query
def item_cf_predict_top(spark, d):
    every = cut(ratings(spark, d))
    known = every.where(~held_out())
    return cf.item_predictions(every.where(held_out()), known, cf.item_model(known), n=3)


@query
def user_cf_predict(spark, d):
    every = cut(ratings(spark, d))
    known = every.where(~held_out())
    return cf.user_predictions(every.where(held_out()), known, cf.co_rated(known, "u", "b", 2).where("sim > 0"), n=5, least=2)


@query
def user_cf_published(spark, d):
    """The user model by LSH, five neighbours, at least five."""
    every = cut(ratings(spark, d))
    known = every.where(~held_out())
    return cf.user_predictions(every.where(held_out()), known, cf.user_model(known), n=5, least=5)


@query
def model_json(spark, d):
    """The item model, written as JSON lines and loaded in both directions."""
    folder = scratch(spark)
    sinks.write_json(cf.item_model(ratings(spark, d)).selectExpr("cast(a as string) id1", "cast(b as string) id2", "sim"), folder)
    return tables.symmetric_model(tables.json_lines(spark, folder, tables.PAIR_MODEL))


# --- graphs ----------------------------------------------------------------------------------


@query
def coreview_edges(spark, d):
    return graph.coreview_edges(user_items(spark, d), "u", "b", 7)


@query
def strongest_edges(spark, d):
    return top_edges(spark, d)


@query
def degrees(spark, d):
    return graph.degrees(top_edges(spark, d))


@query
def graph_index(spark, d):
    return graph.dense_index(graph.vertices(top_edges(spark, d)))


@query
def text_index(spark, d):
    return graph.dense_index(table(spark, d, "customer").select(F.col("c_name").alias("id")))


@query
def label_propagation(spark, d):
    return graph.label_propagation(top_edges(spark, d), 5)


@query
def components(spark, d):
    return graph.components(top_edges(spark, d))


@query
def bfs_paths(spark, d):
    return graph.shortest_paths(top_edges(spark, d))


@query
def edge_betweenness(spark, d):
    return graph.edge_betweenness(top_edges(spark, d))


@query
def modularity(spark, d):
    edges = top_edges(spark, d)
    return graph.modularity(edges, graph.components(edges), "component")


@query
def gn_first_cut(spark, d):
    found = graph.edge_betweenness(top_edges(spark, d))
    return found.orderBy(F.desc("betweenness"), "src", "dst").limit(1)


@query
def girvan_newman(spark, d):
    return graph.girvan_newman(top_edges(spark, d, 60), cuts=3)[0]


# --- clusters --------------------------------------------------------------------------------


@query
def farthest_init(spark, d):
    chosen = cluster.farthest_first(points(spark, d), 5)
    return spark.createDataFrame([(k, i) for k, (i, _) in enumerate(chosen)], "cluster long, id long")


@query
def kmeans_fixed(spark, d):
    found = cluster.kmeans(points(spark, d), 5, rounds=3, moved=-1.0)
    return found.select("id", "cluster", F.round("distance", 4).alias("distance"))


@query
def kmeans_mllib(spark, d):
    return cluster.mllib_kmeans(points(spark, d), 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query
def nearest_centre(spark, d):
    p = points(spark, d)
    centres = cluster.centres_of(p.withColumnRenamed("label", "cluster")).select("cluster", "centre")
    return cluster.nearest(p.select("id", "v"), centres).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query
def outlier_split(spark, d):
    return cluster.outlier_split(points(spark, d).withColumnRenamed("label", "cluster"), 1.1)


@query
def cluster_stats(spark, d):
    return cluster.stats_rows(cluster.cluster_stats(points(spark, d).withColumnRenamed("label", "cluster")))


@query
def ds_merge(spark, d):
    p = points(spark, d).withColumnRenamed("label", "cluster")
    parts = [cluster.cluster_stats(p.where(F.col("id") % 4 == k)) for k in range(4)]
    return cluster.stats_rows(cluster.merge_stats(*parts))


@query
def mahalanobis_assign(spark, d):
    p = points(spark, d).withColumnRenamed("label", "cluster")
    stats = cluster.cluster_stats(p.where("id % 4 <> 0"))
    found = cluster.mahalanobis_assign(p.where("id % 4 = 0"), stats, 2.0)
    return found.select("id", "cluster", F.round("distance", 6).alias("distance"))


@query
def bfr_rounds(spark, d):
    p, job = points(spark, d), cluster.Bfr(10)
    for k in range(4):
        job.add(p.where(F.col("id") % 4 == k), last=k == 3)
    return job.rounds(spark)


# --- sketches --------------------------------------------------------------------------------


@query
def bloom_probe(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_name").alias("key"), "c_custkey")
    return sketch.bloom_probe(customers, "key", sketch.bloom_bits(customers.where("c_custkey % 2 = 0"), "key"))


@query
def bloom_fp_rate(spark, d):
    keys = table(spark, d, "customer").where("c_custkey % 2 = 0").agg(F.count("*").alias("keys"))
    return keys.select("keys", F.round(F.pow(1 - F.exp(-8.0 * F.col("keys") / 10000.0), 8), 9).alias("rate"))


@query
def fm_estimate(spark, d):
    return sketch.distinct_estimates(events(spark, d), "user_id", F.window("ts", "3 days", "1 day")["start"].alias("start"))


@query
def hll_estimate(spark, d):
    start = F.window("ts", "3 days", "1 day")["start"].alias("start")
    rows = events(spark, d).groupBy(start).agg(F.countDistinct("user_id").alias("truth"), F.approx_count_distinct("user_id", 0.01).alias("estimate"))
    return rows.withColumn("error", F.round(percent_error(F.col("estimate"), F.col("truth")), 6))


@query
def window_distinct(spark, d):
    return streams.window_counts(events(spark, d))


@query
def reservoir_sample(spark, d):
    return sketch.reservoir(table(spark, d, "events"), "event_id", 100).select("event_id", "event_type", "priority")


@query
def trending_tags(spark, d):
    return sketch.trending(sketch.reservoir(table(spark, d, "events"), "event_id", 100), "event_type")


@query
def trending_users(spark, d):
    return sketch.trending(table(spark, d, "events").select(F.col("user_id").cast("string").alias("user")), "user")


# --- streams ---------------------------------------------------------------------------------


@query
def stream_window_counts(spark, d):
    return streams.drain(streams.window_counts(streams.event_stream(spark, d)), each=streams.windows_of)


@query
def stream_distinct(spark, d):
    return streams.drain(streams.window_estimates(streams.event_stream(spark, d)))


@query
def stream_trending(spark, d):
    return streams.drain(streams.tag_counts(streams.event_stream(spark, d)), each=streams.board)


@query
def stream_session(spark, d):
    return streams.drain(streams.sessions(streams.event_stream(spark, d)))


@query
def stream_tumbling(spark, d):
    return streams.drain(streams.tumbling_counts(streams.event_stream(spark, d)))


@query
def stream_reservoir(spark, d):
    held = streams.drain(streams.stateful_reservoir(streams.event_stream(spark, d), "event_id", 100), mode="update")
    return streams.lowest(held, 100).select(F.col("key").alias("event_id"), "priority")


@query
def stream_micro_batches(spark, d):
    """Micro-batches that are appended as they come, by a stream that is started, awaited and stopped."""
    folder = scratch(spark)
    rows = streams.event_stream(spark, d).select("event_id", "event_type")
    streams.run_for(rows, lambda batch, _: sinks.append_json(batch, folder), 60, "append", "1 second", settled=True)
    return tables.json_lines(spark, folder, "event_id long, event_type string")


@query
def stream_pushed_tags(spark, d):
    """Messages of a push client, spooled, read as a stream and taken apart into tags."""
    folder = scratch(spark)
    spool = push.Spool(spark, f"{folder}/spool", 2)
    for k, r in enumerate(table(spark, d, "region").select("r_name").collect()):  # five rows
        spool.on_data('{"entities": {"hashtags": [{"text": "%s"}, {"text": "n%d"}]}}' % (r.r_name, k))
        if k == 2:
            spool.on_error(420)
    spool.flush()
    found = tables.tags(streams.json_stream(push.spooled(spark, f"{folder}/spool"), tables.TWEET))
    return streams.drain(found, mode="append")


# --- sources and sinks: written and read again -----------------------------------------------


@query
def text_lines(spark, d):
    folder = scratch(spark)
    sinks.write_lines(table(spark, d, "customer").select(F.col("c_name").alias("value")), folder)
    return spark.read.text(folder)


@query
def json_rows(spark, d):
    folder = scratch(spark)
    orders = table(spark, d, "orders")
    sinks.write_json(orders.selectExpr("cast(o_orderkey as string) review_id", "cast(o_custkey as string) user_id", "o_totalprice stars", "date_format(o_orderdate, 'yyyy-MM-dd') date"), folder)
    return tables.json_lines(spark, folder, tables.REVIEW).select("review_id", "user_id", "stars", "date", "text")


@query
def json_runs(spark, d):
    """One JSON object a run, appended to what is there."""
    folder = scratch(spark)
    for year in (1995, 1996, 1997):
        sinks.append_json(aggregates.count_in_year(table(spark, d, "orders"), "o_orderdate", year).withColumn("year", F.lit(year).cast("long")), folder)
    return tables.json_lines(spark, folder, "year long, n long")


@query
def csv_rows(spark, d):
    folder = scratch(spark)
    sinks.write_csv(table(spark, d, "orders").selectExpr("cast(o_custkey as string) user_id", "cast(o_orderkey as string) business_id"), folder)
    return tables.csv(spark, folder, tables.USER_ITEM)


@query
def csv_header_tokens(spark, d):
    """As csv_rows, with the header read as a row and dropped by its names."""
    folder = scratch(spark)
    sinks.write_csv(table(spark, d, "orders").selectExpr("cast(o_custkey as string) user_id", "cast(o_orderkey as string) business_id"), folder)
    return tables.csv(spark, folder, tables.USER_ITEM, header=False).where("user_id <> 'user_id' and business_id <> 'business_id'")


@query
def csv_blocks(spark, d):
    """A block of rows a round, appended."""
    folder = scratch(spark)
    for k in range(3):
        sinks.append_csv(aggregates.count_by(table(spark, d, "orders").where(F.col("o_orderkey") % 3 == k), F.col("o_orderstatus").alias("status")).select(F.lit(k).alias("round"), "status", "n"), folder)
    return tables.csv(spark, folder, "round long, status string, n long")


@query
def csv_points(spark, d):
    folder = scratch(spark)
    points(spark, d).select("id", *(F.col("v")[k].alias(f"x{k}") for k in range(64))).write.csv(folder)
    return tables.points(spark, folder, 64).select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.col("v")[63].alias("last"))


@query
def chunk_files(spark, d):
    """Points in files that are read one after the other: (chunk, points, new ids), chunks in the order of their names."""
    folder = scratch(spark)
    flat_points = points(spark, d).select("id", *(F.col("v")[k].alias(f"x{k}") for k in range(64)))
    flat_points.withColumn("chunk", F.col("id") % 4).repartition(4, "chunk").write.partitionBy("chunk").csv(folder)
    out = None
    for k in range(4):
        files = tables.chunks(spark, f"{folder}/chunk={k}", ".csv")
        rows = tables.points(spark, files, 64).agg(F.lit(k).cast("long").alias("chunk"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = rows if out is None else out.union(rows)
    return out


@query
def bfr_chunks(spark, d):
    """BFR over chunk files, a file or more a round."""
    folder = scratch(spark)
    flat_points = points(spark, d).select("id", *(F.col("v")[k].alias(f"x{k}") for k in range(64)))
    flat_points.withColumn("chunk", F.col("id") % 4).repartition(4, "chunk").write.partitionBy("chunk").csv(folder)
    job = cluster.Bfr(10)
    for k in range(4):
        job.add(tables.points(spark, tables.chunks(spark, f"{folder}/chunk={k}", ".csv"), 64), last=k == 3)
    return job.rounds(spark).selectExpr("round_id", "nof_point_discard + nof_point_compression + nof_point_retained as n")


@query
def sample_dataset(spark, d):
    """A subset by another table's keys, written as CSV and read again."""
    folder = scratch(spark)
    nations = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    sinks.write_csv(aggregates.semi_join(table(spark, d, "customer"), nations, "c_nationkey").selectExpr("cast(c_custkey as string) user_id", "c_name business_id"), folder)
    return tables.csv(spark, folder, tables.USER_ITEM)


@query
def hashtags(spark, d):
    """Tags of JSON objects, those of ASCII letters only."""
    tweets = table(spark, d, "part").select(F.to_json(F.struct(F.struct(F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("text"))).alias("hashtags")).alias("entities"))).alias("value"))
    return aggregates.count_by(tables.tags(streams.json_stream(tweets, tables.TWEET)), F.col("tag"))


@query
def comma_lists(spark, d):
    listed = table(spark, d, "part").select(F.explode(comma_list(F.when(F.col("p_partkey") % 10 > 0, F.regexp_replace("p_name", " ", " , ")))).alias("category"))
    return aggregates.count_by(listed, F.col("category"))


@query
def betweenness_lines(spark, d):
    folder = scratch(spark)
    sinks.write_lines(sinks.edge_lines(graph.edge_betweenness(top_edges(spark, d)), "betweenness"), folder)
    return spark.read.text(folder)


@query
def community_report(spark, d):
    folder = scratch(spark)
    sinks.write_lines(sinks.community_lines(graph.communities(graph.components(top_edges(spark, d)), "component")), folder)
    return spark.read.text(folder)


@query
def cluster_json(spark, d):
    folder = scratch(spark)
    p = points(spark, d).withColumnRenamed("label", "cluster")
    near = cluster.mahalanobis_assign(p.where("id % 4 = 0 and id < 4000"), cluster.cluster_stats(p.where("id % 4 <> 0")), 2.0)
    sinks.write_lines(sinks.cluster_map(near), folder)
    return spark.read.text(folder)


@query
def bloom_line(spark, d):
    folder = scratch(spark)
    customers = table(spark, d, "customer").select(F.col("c_name").alias("key"), "c_custkey")
    found = sketch.bloom_probe(customers, "key", sketch.bloom_bits(customers.where("c_custkey % 2 = 0"), "key"))
    sinks.write_lines(sinks.bit_line(customers.where("c_custkey <= 1500").join(found, "key").select(F.col("c_custkey").alias("row"), "hit")), folder)
    return spark.read.text(folder)


@query
def trending_board(spark, d):
    folder = scratch(spark)
    sinks.write_lines(sinks.board_lines(sketch.trending(table(spark, d, "events").select("event_type"), "event_type")), folder)
    return spark.read.text(folder)


@query
def items_by_number(spark, d):
    """Rows of each partition, where an item's number names its partition."""
    return partition_sizes(table(spark, d, "lineitem").repartitionById(8, F.col("l_partkey").cast("int") % 8))


ORACLE_SQL: dict[str, str] = oracle.SQL
