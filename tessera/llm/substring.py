"""Substring deduplication by difference-cover anchors.

A window of WIDTH words is hashed only where its position modulo PERIOD is in a difference cover: for
any two positions some shift below PERIOD moves both into the cover, so two equal passages of WIDTH +
PERIOD - 1 words share an aligned anchor, though only 6 of 31 positions are hashed. Anchors that
occur once are dropped. The others are extended to both sides: every window of MIN_WORDS words that holds a repeated
anchor is hashed and meets the first of its kind, by (doc_id, position), which stays; an anchor that many share
isn't extended pair by pair. Windows that follow their firsts in step make a stretch, and a stretch counts only
if its words have the same 128-bit digest as the words that it is said to repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACED, cut, flat, hash_runs, in_slices, keep_ids, places, release, runs, signed, small_batches, text_slices, windows

PERIOD, COVER, WIDTH = 31, (1, 5, 11, 24, 25, 27), 15
#: Shortest passage, in words, that counts as a repeat: what the cover is sure to find.
MIN_WORDS = WIDTH + PERIOD - 1
#: A place holds the word number in its low bits and the number of the doc_id's text above them.
PLACE_BITS = 40


def word_hashes(text: pa.Array):
    """(document, hash, position) of each white-space-separated word, byte for byte."""
    data, offsets = flat(text)
    doc, start, end = runs(data, offsets, SPACED)
    return doc, hash_runs(data, start, end), places(doc, len(offsets) - 1)


def anchors(docs: DataFrame) -> DataFrame:
    """(h, doc_id, p): hash of the WIDTH words from p on, for each p in the cover."""
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches):
        for batch in text_slices(batches):
            doc, h, p = word_hashes(batch.column("text"))
            w = windows(h, WIDTH)
            n = len(w)
            at = np.flatnonzero(cover[p[:n] % PERIOD] & (doc[:n] == doc[WIDTH - 1 :])) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([signed(w[at]), batch.column("doc_id").take(pa.array(doc[at])), pa.array(p[at].astype(np.int32))], ["h", "doc_id", "p"])

    return docs.mapInArrow(run, "h long, doc_id long, p int")


def candidate_windows(docs: DataFrame) -> DataFrame:
    """(h, doc_id, p, v) of each window of MIN_WORDS words that holds one of its row's anchors `at`."""

    def run(batches):
        for batch in text_slices(batches):
            doc, h, p = word_hashes(batch.column("text"))
            w = windows(h, MIN_WORDS)
            n = len(w)
            if not n:
                continue
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            at = batch.column("at")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(at.offsets)))
            spot = at.flatten().to_numpy(zero_copy_only=False) + first[owner]
            # A window at q holds the anchor at s if s - (MIN_WORDS - WIDTH) <= q <= s.
            mark = np.bincount(np.maximum(spot - (MIN_WORDS - WIDTH), first[owner]), minlength=len(doc) + 2) - np.bincount(spot + 1, minlength=len(doc) + 2)
            near = np.flatnonzero((np.cumsum(mark)[:n] > 0) & (doc[:n] == doc[MIN_WORDS - 1 :]))
            of = pa.array(doc[near])
            yield pa.RecordBatch.from_arrays([signed(w[near]), batch.column("doc_id").take(of), pa.array(p[near] + (batch.column("v").to_numpy()[doc[near]] << PLACE_BITS))], ["h", "doc_id", "at"])

    return docs.mapInArrow(run, "h long, doc_id long, at long")


def variants(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, v) of each text of the doc_ids that have several, numbered 0, 1, ...; mostly empty."""
    twice = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    texts = keep_ids(docs, twice).select("doc_id", F.xxhash64("text").alias("fp")).distinct()
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("fp")).cast("long") - 1
    return cut(texts.withColumn("v", number))


def numbered(docs: DataFrame, of: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with v, the number of the row's text among those of its doc_id."""
    small = of.count() <= BROADCAST_ROWS
    rows = docs.withColumn("fp", F.xxhash64("text")).join(F.broadcast(of) if small else of, ["doc_id", "fp"], "left")
    return rows.select(*docs.columns, F.coalesce("v", F.lit(0).cast("long")).alias("v"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, v, first_word, n_words, of_doc_id): maximal runs of words whose windows occur earlier.

    Words are what ASCII white space separates, counted from 0, compared byte for byte; of_doc_id
    holds the first occurrence of the run's first window, which may be in the same document. v
    numbers the texts of a doc_id that has several (else it is 0); equal rows count once. Every word of a second or later occurrence of a passage of MIN_WORDS words or more
    is in a run; no word of a first one is. Documents with a null doc_id aren't searched; null,
    empty and short texts have no rows. Texts are searched whole. Other columns aren't read.
    """
    every = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = every.where("doc_id is not null and text is not null")
    seen = anchors(named).withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    spots = cut(seen.groupBy("doc_id").agg(F.array_distinct(F.collect_list("p")).alias("at")))
    del seen
    release(docs.sparkSession)
    of = variants(every)
    some = numbered(keep_ids(named, spots.select("doc_id")), of)
    held = candidate_windows(some.join(spots, "doc_id"))
    earliest = Window.partitionBy("h").orderBy("doc_id", "at")
    first = F.first(F.struct("doc_id", "at")).over(earliest)
    later = held.withColumn("first", first).where("doc_id <> first.doc_id or at <> first.at").select("doc_id", "at", F.col("first.doc_id").alias("of_doc_id"), F.col("first.at").alias("of_at"))
    found = cut(stretches(later))
    del some, held, later, spots
    release(docs.sparkSession)
    return merged(repeated_words(found, numbered(named, of)))


def stretches(later: DataFrame) -> DataFrame:
    """(doc_id, at, n, of_doc_id, of_at): windows (doc_id, at, of_doc_id, of_at) that follow each other as their firsts do, n words each."""
    by = Window.partitionBy("doc_id").orderBy("at")
    step = (F.col("at") == F.lag("at").over(by) + 1) & (F.col("of_at") == F.lag("of_at").over(by) + 1) & (F.col("of_doc_id") == F.lag("of_doc_id").over(by))
    run = later.withColumn("opens", 1 - F.coalesce(step, F.lit(False)).cast("int")).withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = run.groupBy("doc_id", "run").agg(F.min("at").alias("at"), F.count("*").alias("k"), F.min("of_doc_id").alias("of_doc_id"), F.min("of_at").alias("of_at"))
    return rows.select("doc_id", "at", (F.col("k") + MIN_WORDS - 1).alias("n"), "of_doc_id", "of_at")


def digests_of(texts: DataFrame) -> DataFrame:
    """(doc_id, at, n, digest) of the sizes[k] words from each places[k], of texts(doc_id, text, v, places, sizes)."""

    def run(batches):
        for batch in text_slices(batches):
            spots = np.asarray(batch.column("places").offsets)
            at, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("places", "sizes"))
            at, n = at.astype(np.int64), n.astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(spots))
            mine = np.flatnonzero(at >> PLACE_BITS == batch.column("v").to_numpy()[owner])
            owner, at, n = owner[mine], at[mine], n[mine]
            found, now, words = [], -1, []
            for k, p, size in zip(owner.tolist(), (at & (1 << PLACE_BITS) - 1).tolist(), n.tolist()):
                if k != now:
                    now, words = k, batch.column("text")[k].as_buffer().to_pybytes().split()  # at ASCII white space
                found.append(hashlib.md5(b" ".join(words[p : p + size])).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(at), pa.array(n), pa.array(found, pa.binary())], ["doc_id", "at", "n", "digest"])

    return texts.mapInArrow(run, "doc_id long, at long, n long, digest binary")


def repeated_words(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The stretches whose words are those that they repeat; found is materialised, texts is (doc_id, text, v)."""
    here, there = ["doc_id", "at", "n"], [F.col("of_doc_id").alias("doc_id"), F.col("of_at").alias("at"), "n"]
    asked = found.select(*here).union(found.select(*there)).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    asked = cut(asked.select("doc_id", F.col("asked.at").alias("places"), F.col("asked.n").cast("array<int>").alias("sizes")))
    small = found.count() <= BROADCAST_ROWS  # each asks twice, in 12 bytes
    digest = cut(digests_of(small_batches(texts.join(F.broadcast(asked) if small else asked.hint("shuffle_merge"), "doc_id"))).distinct())
    same = found.join(digest, here).join(digest.select(F.col("doc_id").alias("of_doc_id"), F.col("at").alias("of_at"), "n", F.col("digest").alias("of_digest")), ["of_doc_id", "of_at", "n"])
    return same.where("digest = of_digest").select("doc_id", "at", "n", "of_doc_id")


def merged(stretch: DataFrame) -> DataFrame:
    """Stretches (doc_id, at, n, of_doc_id) that overlap or touch, as maximal runs of words."""
    by = Window.partitionBy("doc_id").orderBy("at", "of_doc_id")
    reached = F.max(F.col("at") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = stretch.withColumn("opens", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = run.groupBy("doc_id", "run").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("n")).alias("b"), F.min_by("of_doc_id", F.struct("at", "of_doc_id")).alias("of_doc_id"))
    first_word = F.col("a").bitwiseAND((1 << PLACE_BITS) - 1).alias("first_word")
    return spans.select("doc_id", F.shiftright("a", PLACE_BITS).alias("v"), first_word, (F.col("b") - F.col("a")).alias("n_words"), "of_doc_id")


def without_words(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text less the words of its spans (first_word, n_words) and the white space after them."""
    data, offsets = flat(text)
    n = len(offsets) - 1
    doc, start, _ = runs(data, offsets, SPACED)
    first = np.searchsorted(doc, np.arange(n + 1))
    owner = np.repeat(np.arange(n), np.diff(np.asarray(spans.offsets)))
    values = spans.flatten()
    a = values.field("first_word").to_numpy(zero_copy_only=False) + first[owner]
    b = a + values.field("n_words").to_numpy(zero_copy_only=False)
    begin = np.append(start, len(data))
    to = np.where(b < first[owner + 1], begin[np.minimum(b, len(start))], offsets[owner + 1])
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, begin[a], 1)
    np.add.at(mark, to, -1)
    stay = np.cumsum(mark, dtype=np.int32)[: len(data)] <= 0
    total = np.concatenate(([0], np.cumsum(stay)))[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(total.tobytes()), pa.py_buffer(data[stay].tobytes()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, with every repeated span cut out of text and n_chars counted anew.

    First occurrences stay where they are; documents of which nothing is left stay with an empty
    text. Rows that aren't searched are unchanged. See repeated_spans.
    """
    spans = cut(repeated_spans(docs).groupBy("doc_id", "v").agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = numbered(rows, variants(rows.select("doc_id", "text")))
    touched = keep_ids(rows, spans.select("doc_id", "v"))
    rest = keep_ids(rows, spans.select("doc_id", "v"), "left_anti").select("row.*")

    def less(text: pa.Array, spans: pa.Array) -> pa.Array:
        return in_slices(without_words, text, spans)

    cut_text = F.arrow_udf(less, "string")("text", "spans")
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    new = touched.join(spans, ["doc_id", "v"]).withColumn("new", cut_text)
    return rest.unionByName(new.select(row.alias("row")).select("row.*"))
