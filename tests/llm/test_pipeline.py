"""The pipeline against its stages by brute force."""

import collections
import re

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.common import documents
from tests.llm.test_brute_force import brute_pairs, brute_spans
from tests.llm.test_edges import ROWS, frame
from tessera.llm.toxicity import learned_insults, score_texts

import pyarrow as pa


def test_run_equals_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in documents(spark, small).collect()}
    learned = learned_insults(documents(spark, small), documents(spark, small, "labels"))
    toxic = score_texts(pa.array(list(texts.values())), learned)[2]
    texts = {i: t for (i, t), bad in zip(texts.items(), toxic) if not bad}
    seen = set()
    texts = {i: t for i, t in sorted(texts.items()) if not (t in seen or seen.add(t))}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_pairs(texts, 3, 0.6):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    texts = {i: t for i, t in texts.items() if root(i) == i}
    gone = collections.defaultdict(set)
    for i, a, n in brute_spans(texts):
        gone[i] |= set(range(a, a + n))
    want = {i: len(re.findall(r"\S+", t)) - len(gone[i]) for i, t in texts.items()}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, small).collect():
        got[r.doc_id] += r.n_words
    assert got == {i: n for i, n in want.items() if n}


def test_run_on_odd_rows_and_on_an_empty_table(spark, tmp_path):
    labels = spark.createDataFrame([(7, 1), (1, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    for name, rows in (("odd", ROWS), ("none", [])):
        frame(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect():
        got[r.doc_id] += r.n_words
    assert got == {1: 3, 6: 80_000, 8: 62, 10: 5, 12: 3}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_the_columns(spark, small):
    docs = documents(spark, small)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert queries.ORACLE_SQL.keys() <= queries.QUERIES.keys()
