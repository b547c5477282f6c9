"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, license_scan, maxscore, ngram_join, packing, piece_codec, quality, substring, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for themselves.
CLASH = ["fp", "row", "spans", "new", "h", "p", "at", "key", "digest", "k", "x", "node", "a", "b", "size", "vec", "sig", "shard", "seen", "t", "q", "score", "n_words", "tokens", "ids", "count"]
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"long{i} you" for i in range(40_000))
ROWS = [
    (1, "a b c", "en", "s", 5),
    (1, "a b c", "en", "s", 5),
    (2, None, None, None, None),
    (None, "you stupid idiot, you moron", "en", None, 27),
    (None, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "", "en", "s", 0),
    (5, "   \n ", "en", "s", 5),
    (6, LONG, "en", "s", len(LONG)),
    (7, "you stupid idiot, you moron", "en", "s", 27),
    (8, "x " + PASSAGE + " y", "en", "s", 0),
    (9, "z " + PASSAGE + " q r", "en", "s", 0),
    (10, "Released under the MIT License.", "en", "s", 31),
    (11, "a b c", "en", "s", 5),
    (12, "é 日本 \U0001f600", "fr", "s", 6),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"clash {c}") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_search(spark, docs, empty):
    queries = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "mit license"), (2, None), (3, ""), (4, "?!"), (5, "nothingofthat")], "item_id long, text string").withColumn("score", F.lit("x"))
    got = plain(maxscore.top_k(docs, queries), "item_id", "rank", "doc_id")
    assert [r for r in got if r[0] == 1] == sorted([(1, 1, 1), (1, 2, 1), (1, 3, 11)] * 2)
    assert [r for r in got if r[0] is None] == [(None, 1, 10)]
    assert {r[0] for r in got} == {1, None}
    assert maxscore.top_k(empty, queries).count() == 0
    assert maxscore.top_k(docs, queries.limit(0)).count() == 0


def test_toxicity(docs, empty):
    assert plain(toxicity.toxic_documents(docs), "doc_id") == [(7,), (None,)]
    kept = toxicity.without_toxic(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert toxicity.toxic_documents(empty).count() == toxicity.without_toxic(empty).count() == 0
    labels = docs.sparkSession.createDataFrame([(7, 1), (7, 0), (None, 1), (1, None), (8, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    assert plain(toxicity.toxic_documents(docs, labels), "doc_id") == [(7,), (None,)]
    assert toxicity.toxic_documents(empty, labels).count() == toxicity.without_toxic(empty, labels.limit(0)).count() == 0


def test_exact_dedup(docs, empty):
    assert plain(exact_dedup.copies_in(docs), "doc_id", "keep_id") == [(11, 1), (4, 3)]
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, None, None, 3, 5, 6, 7, 8, 9, 10, 12]))
    assert exact_dedup.copies_in(empty).count() == exact_dedup.without_copies(empty).count() == 0


def test_one_id_with_several_texts(spark):
    rows = frame(spark, [(1, "x", "en", "s", 1), (1, "y", "en", "s", 1), (2, "y", "en", "s", 1), (9, "z", "en", "s", 1)])
    assert plain(exact_dedup.copies_in(rows), "doc_id", "keep_id") == [(2, 1)]
    assert exact_dedup.without_copies(rows).count() == 3


def test_exact_dedup_keeps_the_other_texts_of_an_id(spark):
    rows = frame(spark, [(1, "y", "en", "s", 1), (2, "x", "en", "s", 1), (2, "y", "en", "s", 1), (2, "x", "en", "s", 1), (2, None, "en", "s", 1), (9, "x", "en", "s", 1), (9, "z", "en", "s", 1)])
    assert plain(exact_dedup.copies_in(rows), "doc_id", "keep_id") == [(2, 1), (9, 2)]
    kept = exact_dedup.without_copies(rows)
    assert kept.columns == rows.columns
    assert plain(kept, "doc_id", "text") == sorted([(1, "y"), (2, "x"), (2, None), (9, "z")], key=str)


@pytest.mark.parametrize("top", [9, (1 << 63) - 1])
def test_ngram_join_of_one_id_with_several_texts(spark, top):
    other, third = " ".join(f"o{i}" for i in range(50)), " ".join(f"t{i}" for i in range(50))
    texts = [(1, "a b c d e"), (2, other), (2, third), (2, third), (2, None), (3, PASSAGE), (3, other + " q"), (4, PASSAGE + " q"), (4, "alone"), (top, third + " r"), (top, "r " + third)]
    rows = frame(spark, [(i, t, "en", "s", 1) for i, t in texts])
    got = {(r.a, r.b): r.jaccard for r in ngram_join.similar_pairs(rows).collect()}
    assert got == {(2, 3): 48 / 49, (3, 4): 58 / 59, (2, top): 48 / 49}
    assert plain(ngram_join.similarity_classes(rows), "doc_id", "class_id", "links") == sorted([(1, 1, 0), (2, 2, 2), (3, 2, 2), (4, 2, 1), (top, 2, 1)], key=str)
    kept = ngram_join.without_near_copies(rows)
    assert kept.columns == rows.columns
    assert plain(kept, "doc_id", "text") == sorted([(1, "a b c d e"), (2, other), (2, third), (2, third), (2, None), (3, PASSAGE), (4, "alone")], key=str)


def test_packing(docs, empty):
    got = packing.packed(docs)
    words = {str(r.doc_id) + str(r.n): r.n for r in got.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert sum(words.values()) == sum(len(r[1].split()) for r in ROWS if r[1])
    assert got.where("doc_id = 6").count() == -(-80_000 // packing.TIERS[-1])
    assert packing.packed(empty).count() == 0


def test_piece_codec(docs, empty):
    got = piece_codec.encoded(docs)
    assert got.count() == len(ROWS)
    for r in got.collect():
        if r.n_tokens is None:
            assert r.ids is None and r.round_trip is None and r.doc_id in (2, None)
        else:
            assert r.round_trip and len(r.ids) == r.n_tokens
    back = {r.doc_id: r.text for r in piece_codec.decoded(got).where("doc_id is not null").collect()}
    assert back[5] == "   \n " and back[12] == "é 日本 \U0001f600" and back[3] == "" and back[2] is None
    assert piece_codec.encoded(empty).count() == piece_codec.decoded(got.limit(0)).count() == 0


def test_token_counts(docs, empty):
    got = {str(r.doc_id): r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got["3"] == 0 and got["2"] is None and got["6"] > 80_000
    assert token_counts.token_counts(docs).count() == len(ROWS)
    assert token_counts.token_counts(empty).count() == 0


def test_substring_dedup(docs, empty):
    assert plain(substring.repeated_spans(docs), "doc_id", "first_word", "n_words", "of_doc_id") == [(9, 1, 60, 8)]
    kept = substring.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert kept.where("doc_id = 9").select("text", "n_chars", "fp").first() == ("z q r", 5, "clash fp")
    assert substring.repeated_spans(empty).count() == substring.without_repeats(empty).count() == 0


def test_substring_dedup_of_wholly_repeated_texts(spark):
    got = substring.without_repeats(frame(spark, [(1, PASSAGE, "en", "s", 1), (2, PASSAGE, "en", "s", 1), (2, PASSAGE, "en", "s", 1)]))
    assert plain(got, "doc_id", "text") == [(1, PASSAGE), (2, ""), (2, "")]


def test_substring_dedup_of_one_id_with_several_texts(spark):
    rows = frame(spark, [(1, PASSAGE, "en", "s", 1), (2, "other words", "en", "s", 1), (2, None, "en", "s", 1), (3, None, "en", "s", 1), (3, PASSAGE, "en", "s", 1), (2, "q " + PASSAGE, "en", "s", 1), (2, "q " + PASSAGE, "en", "s", 1)])
    assert plain(substring.repeated_spans(rows), "doc_id", "first_word", "n_words") == [(2, 1, 60), (3, 0, 60)]
    want = [(1, PASSAGE), (2, "other words"), (2, "q "), (2, "q "), (2, None), (3, ""), (3, None)]
    assert plain(substring.without_repeats(rows), "doc_id", "text") == sorted(want, key=str)


def test_ngram_join(docs, empty):
    assert plain(ngram_join.similar_pairs(docs), "a", "b", "jaccard") == [(1, 11, 1.0), (8, 9, 58 / 63)]
    classes = {1: (1, 1), 11: (1, 1), 8: (8, 1), 9: (8, 1)}
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_join.similarity_classes(docs).collect()} == {i: classes.get(i, (i, 0)) for i in range(1, 13)}
    assert ngram_join.similarity_classes(empty).count() == 0
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ROWS if r[0] not in (11, 9))
    assert ngram_join.similar_pairs(empty).count() == ngram_join.without_near_copies(empty).count() == 0


def test_license_scan(docs, empty):
    assert plain(license_scan.license_scan(docs), "doc_id", "license", "coverage", "first_word", "n_words") == [(10, "MIT notice", 1.0, 0, 5)]
    assert license_scan.license_scan(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (3, 0), (None, 1), (8, None)], "doc_id long, quality int").withColumn("x", F.lit(1))
    got = quality.quality_scores(docs, labels)
    assert got.count() == len(ROWS) and all(0 <= r.probability <= 1 for r in got.collect())
    assert quality.quality_scores(docs, labels.limit(0)).where("keep").count() == len(ROWS)
    assert quality.quality_scores(empty, labels).count() == 0
