"""Exact deduplication against an immutable snapshot, screened by static binary-fuse filters.

Digests are hashed into buckets. A snapshot's bucket gets one binary-fuse filter (about 9 bits a
digest) that never changes. Incoming digests probe their bucket's filter; only positives are joined
to the snapshot's exact bucket and compared byte by byte. What the snapshot doesn't hold is grouped
among itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import K1, K2, K3, U, cut, keep_ids

#: Digests a bucket holds on average, of the snapshot or of the batch, whichever has more: neither side of a bucket outgrows a task.
BUCKET_KEYS = 1 << 17


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + U((seed * K1 + K3) & (1 << 64) - 1)
    h = (h ^ (h >> U(33))) * U(K2)
    h = (h ^ (h >> U(29))) * U(K1)
    return h ^ (h >> U(32))


def slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three neighbouring segments' slots of each hash: binary fuse, arity 3."""
    first = (((h >> U(32)) * U(segments)) >> U(32)) * U(length)
    low = U(length - 1)
    return np.stack((first + (h & low), first + U(length) + ((h >> U(11)) & low), first + U(2 * length) + ((h >> U(22)) & low))).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U(24)) ^ (h >> U(45))).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a set of 64-bit keys; peeled round by round."""
    keys = np.unique(keys)
    n = len(keys)
    length = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) + 32
    segments = max(1, int(np.ceil(room / length)) - 2)
    seed = 0
    while True:
        seed += 1
        if seed % 8 == 0:
            segments += 1 + segments // 16
        h = mixed(keys, seed)
        at = slots(h, length, segments)
        count = np.bincount(at.ravel(), minlength=length * (segments + 2))
        which = np.zeros(len(count), np.int64)
        for row in at:
            np.bitwise_xor.at(which, row, np.arange(n))
        order, turn = [], np.flatnonzero(count == 1)
        while len(turn):
            key, pick = np.unique(which[turn], return_index=True)
            order.append((key, turn[pick]))
            for row in at[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(which, row, key)
            near = at[:, key].ravel()
            turn = np.unique(near[count[near] == 1])
        if sum(len(key) for key, _ in order) == n:
            break
    table, mark = np.zeros(len(count), np.uint8), fingerprint(h)
    for key, slot in reversed(order):
        table[slot] = 0
        table[slot] = mark[key] ^ table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]]
    return seed, length, segments, table.tobytes()


def probe_fuse(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    h, cells = mixed(keys, seed), np.frombuffer(table, np.uint8)
    a, b, c = slots(h, length, segments)
    return fingerprint(h) == cells[a] ^ cells[b] ^ cells[c]


FILTER = "bucket long, seed long, length long, segments long, cells binary"


def filters(digests: DataFrame) -> DataFrame:
    """One immutable filter for each bucket of digests(bucket, k)."""

    def build(group: pa.Table) -> pa.Table:
        seed, length, segments, cells = build_fuse(group["k"].to_numpy().view(np.uint64))
        return pa.table({"bucket": group["bucket"][:1], "seed": [seed], "length": [length], "segments": [segments], "cells": pa.array([cells], pa.binary())})

    return digests.select("bucket", "k").groupBy("bucket").applyInArrow(build, FILTER)


def screen(incoming: DataFrame, snapshot_filters: DataFrame) -> DataFrame:
    """incoming(bucket, k, digest) with seen: whether its bucket's filter holds k."""

    def probe(rows: pa.Table, of: pa.Table) -> pa.Table:
        seen = np.zeros(rows.num_rows, bool)
        if of.num_rows and rows.num_rows:
            f = of.to_pylist()[0]
            seen = probe_fuse(rows["k"].to_numpy().view(np.uint64), f["seed"], f["length"], f["segments"], f["cells"])
        return rows.append_column("seen", pa.array(seen))

    return incoming.groupBy("bucket").cogroup(snapshot_filters.groupBy("bucket")).applyInArrow(probe, "bucket long, k long, digest binary, first long, seen boolean")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, k): 128-bit digest of the bytes, and a 64-bit key of it for the filters."""
    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return named.select("doc_id", F.unhex(F.md5("text")).alias("digest")).withColumn("k", F.xxhash64("digest"))


def firsts(d: DataFrame) -> DataFrame:
    """(digest, k, first): the lowest doc_id of each digest."""
    return d.groupBy("digest", "k").agg(F.min("doc_id").alias("first"))


def same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (doc_id, keep_id, digest) whose texts of that digest are equal byte for byte; only their texts are moved."""
    wanted = cut(pairs.select("doc_id").union(pairs.select("keep_id")).distinct())
    texts = keep_ids(docs.select("doc_id", "text").where(F.col("text").isNotNull()), wanted)
    texts = texts.withColumn("digest", F.unhex(F.md5("text")))
    left = pairs.join(texts, ["doc_id", "digest"])
    right = texts.select(F.col("doc_id").alias("keep_id"), "digest", F.col("text").alias("kept"))
    equal = left.join(right, ["keep_id", "digest"]).where(F.col("text") == F.col("kept"))
    return equal.select("doc_id", "keep_id", "digest").distinct()


def exact_copies(docs: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id): each incoming document that is a copy, and the document that stays for it.

    docs is the incoming batch, snapshot what was accepted before. The document that stays is the
    snapshot's with the lowest doc_id, or, if the snapshot has no copy, the batch's with the lowest
    doc_id. Rows with a null doc_id or a null text are never copies; empty texts are copies of each
    other. A repeated row (same doc_id and text) isn't a copy of itself here; one doc_id with
    several texts is compared by each of them. Texts are compared whole. Columns other than doc_id
    and text aren't read. An empty table gives an empty result.
    """
    return copied_texts(docs, snapshot).select("doc_id", "keep_id").distinct()


def copied_texts(docs: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, digest): exact_copies, with which text of doc_id is the copy."""
    spark = docs.sparkSession
    mine = digests(docs)
    if snapshot is None:
        seen_pairs = spark.createDataFrame([], "doc_id bigint, keep_id bigint, digest binary")
        fresh = firsts(mine)
    else:
        held = cut(firsts(digests(snapshot)))
        batch = cut(firsts(mine))
        buckets = max(1, -(-max(held.count(), batch.count()) // BUCKET_KEYS))
        bucket = F.pmod(F.shiftrightunsigned("k", 7), F.lit(buckets)).alias("bucket")
        probed = cut(screen(
            batch.select(bucket, "k", "digest", "first"),
            filters(held.select(bucket, "k")),
        ))
        positive = probed.where("seen").select("digest", "k", "first")
        found = positive.join(held.select("digest", F.col("first").alias("held_id")), "digest", "left")
        negative = probed.where("not seen").select("digest", "k", "first", F.lit(None).cast(dict(mine.dtypes)["doc_id"]).alias("held_id"))
        matched = cut(found.union(negative))
        seen_pairs = mine.join(matched.where("held_id is not null"), "digest").select("doc_id", F.col("held_id").alias("keep_id"), "digest")
        fresh = matched.where("held_id is null").select("digest", "k", "first")
    own_pairs = mine.join(fresh, "digest").where(F.col("doc_id") != F.col("first")).select("doc_id", F.col("first").alias("keep_id"), "digest")
    pairs = cut(seen_pairs.union(own_pairs).distinct())
    everything = docs.select("doc_id", "text") if snapshot is None else docs.select("doc_id", "text").union(snapshot.select("doc_id", "text"))
    return same_bytes(everything, pairs)


def generations(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, incoming): the lower and the upper half of the range of doc_id, as they arrived."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    return docs.where(F.col("doc_id") <= middle), docs.where(F.col("doc_id") > middle)


def copies_in(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) over a whole table: its first generation against itself, the second against that."""
    return copied_texts_in(docs).select("doc_id", "keep_id").distinct()


def copied_texts_in(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, digest): copies_in, with which text of doc_id is the copy."""
    snapshot, incoming = generations(docs)
    own = cut(copied_texts(snapshot))
    return own.union(copied_texts(incoming, snapshot))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, less the copies; of repeated rows (same doc_id and text) one stays.

    Rows with a null doc_id or a null text stay as they are, and so do a copy's doc_id's other texts. See exact_copies.
    """
    copies = cut(copied_texts_in(docs).select("doc_id", "digest").distinct())
    twice = cut(digests(docs).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = keep_ids(keep_ids(docs, cut(copies.select("doc_id").distinct()), "left_anti"), twice, "left_anti")
    rows = keep_ids(docs, twice).select(F.struct("*").alias("row"), "doc_id", F.unhex(F.md5("text")).alias("digest"))
    several = keep_ids(rows, cut(keep_ids(copies, twice)), "left_anti").select("row.*")
    return once.union(several.dropDuplicates(["doc_id", "text"]))
