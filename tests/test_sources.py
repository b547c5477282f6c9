"""Readers, writers and streams."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import sketch
from tessera.sources import sinks, tables
from tessera.session import shared_folder
from tessera.streaming import push, streams


def lines(df):
    return [r.value for r in df.collect()]


def test_json_lines_with_missing_keys(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"business_id": "b", "categories": null}\n{"business_id": "c", "city": ""}\n')
    got = tables.json_lines(spark, str(tmp_path), tables.BUSINESS).orderBy("business_id").collect()
    assert [(r.business_id, r.categories, r.city) for r in got] == [("b", None, None), ("c", None, "")]


def test_csv_headers_and_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,business_id\nu,b\nu,b\n")
    assert tables.csv(spark, str(tmp_path / "a.csv"), tables.USER_ITEM).count() == 2
    (tmp_path / "p.csv").write_text("7,0.5,1\n")
    assert tables.points(spark, str(tmp_path / "p.csv"), 2).first() == (7, [0.5, 1.0])


def test_stopwords_keep_the_last_letter(spark, tmp_path):
    (tmp_path / "s").write_text("the\nof")
    assert sorted(r.word for r in tables.stopwords(spark, str(tmp_path / "s")).collect()) == ["of", "the"]


def test_chunks_are_sorted(spark, tmp_path):
    for name in ("b.txt", "a.txt", "_x.txt", "c.csv"):
        (tmp_path / name).write_text("1")
    assert [p.rsplit("/", 1)[1] for p in tables.chunks(spark, str(tmp_path), ".txt")] == ["a.txt", "b.txt"]


def test_model_is_symmetric(spark):
    model = spark.createDataFrame([("a", "b", 0.5)], tables.PAIR_MODEL)
    assert sorted(map(tuple, tables.symmetric_model(model).collect())) == [("a", "b", 0.5), ("b", "a", 0.5)]


def test_tags(spark):
    raw = spark.createDataFrame([('{"entities": {"hashtags": [{"text": "Ab"}, {"text": "a1"}]}}',), ('{"entities": {"hashtags": []}}',), ("{}",)], "value string")
    assert [r.tag for r in tables.tags(streams.json_stream(raw, tables.TWEET)).collect()] == ["Ab"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    for _ in range(2):
        sinks.append_json(df, str(tmp_path / "j"))
        sinks.write_json(df, str(tmp_path / "o"))
        sinks.append_csv(df, str(tmp_path / "c"))
    sinks.write_csv(df, str(tmp_path / "h"))
    sinks.write_model(df, str(tmp_path / "m"))
    sinks.write_lines(df.select(F.col("k").alias("value")), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.json(str(tmp_path / "o")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).first().k == "a"
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1 and spark.read.text(str(tmp_path / "t")).first().value == "a"


def test_itemset_report(spark):
    one = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "items array<string>")
    assert lines(sinks.itemset_report(one, one.limit(0))) == ["Candidates:", "('a'),('b')", "('a', 'b')", "Frequent Itemsets:"]


def test_text_reports(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 4.0)], "src long, dst long, b double")
    assert lines(sinks.edge_lines(edges, "b")) == ["('2', '3'), 4.0", "('1', '2'), 1.0"]
    groups = spark.createDataFrame([(["b", "c"],), (["a"],)], "members array<string>")
    assert lines(sinks.community_lines(groups)) == ["'a'", "'b', 'c'"]
    assigned = spark.createDataFrame([(2, None), (1, 5)], "id long, cluster long")
    assert lines(sinks.cluster_map(assigned)) == ['{"1": 5, "2": -1}']
    bits = spark.createDataFrame([(1, 0), (0, 1)], "row long, hit int")
    assert lines(sinks.bit_line(bits)) == ["1 0"]
    ranked = sketch.trending(spark.createDataFrame([(t,) for t in "abba"], "t string"), "t")
    assert lines(sinks.board_lines(ranked)) == ["a : 2", "b : 2"]


def test_streams_equal_batches(spark, small):
    events = tables.timestamped(tables.table(spark, small, "events"), "ts")
    for plan, each in ((streams.window_counts, streams.windows_of), (streams.tumbling_counts, None), (streams.sessions, None), (streams.window_estimates, None)):
        batch = sorted(map(tuple, plan(events).collect()))
        assert sorted(map(tuple, streams.drain(plan(streams.event_stream(spark, small)), each=each).collect())) == batch


def test_append_mode_gives_closed_windows_only(spark, small):
    events = tables.timestamped(tables.table(spark, small, "events"), "ts")
    every = set(map(tuple, streams.tumbling_counts(events).collect()))
    closed = set(map(tuple, streams.drain(streams.tumbling_counts(streams.event_stream(spark, small)), mode="append").collect()))
    assert closed < every


def test_boards_are_appended_by_batch(spark, small, tmp_path):
    counts = streams.tag_counts(streams.event_stream(spark, small))
    written = streams.run_for(counts, lambda batch, _: sinks.write_lines(sinks.board_lines(streams.board(batch)), str(tmp_path / "board")), 20, "complete", "1 second")
    assert not written.isActive
    assert spark.read.text(str(tmp_path / "board")).count() == 3


def test_socket_stream_has_a_value_column(spark):
    import socket
    import threading

    server = socket.create_server(("localhost", 0))

    def serve():
        while True:
            try:
                client, _ = server.accept()
            except OSError:
                return
            client.sendall(b'{"entities": {"hashtags": [{"text": "Ab"}]}}\n')

    threading.Thread(target=serve, daemon=True).start()
    found = []
    stream = tables.tags(streams.json_stream(streams.socket_lines(spark, server.getsockname()[1]), tables.TWEET))
    streams.run_for(stream, lambda batch, _: found.extend(r.tag for r in batch.collect()), 8, "append", "1 second")
    server.close()
    assert found == ["Ab"]


def test_spool_keeps_every_message_once(spark, tmp_path):
    spool = push.Spool(spark, str(tmp_path / "s"), 3)
    for k in range(8):
        spool.on_data(f"m{k}\nx")
    assert spool.on_error("gone") and not spool.held
    spool.flush()
    got = streams.drain(push.spooled(spark, str(tmp_path / "s")), mode="append")
    assert sorted(lines(got)) == [f"m{k} x" for k in range(8)]


def test_no_temporary_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        shared_folder(Session)


def test_stateful_reservoir_equals_batch(spark, small):
    held = streams.drain(streams.stateful_reservoir(streams.event_stream(spark, small), "event_id", 50), mode="update")
    want = {r.event_id for r in sketch.reservoir(tables.table(spark, small, "events"), "event_id", 50).collect()}
    assert {r.key for r in streams.lowest(held, 50).collect()} == want
