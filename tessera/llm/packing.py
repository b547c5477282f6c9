"""Hierarchical multi-length packing of documents into training windows of several sizes.

A document goes to the smallest tier whose window holds it; what is longer than the longest window
is cut into whole windows and a rest. Each tier is packed best-fit, the longest tier first, and the
gaps of its windows are filled from shorter tiers before those are packed themselves. The windows
are then dealt to step groups of equal size and nearly equal cost. Documents are spread over shards
by hash; a shard holds some million words and is packed by one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, cut, flat, runs, small_batches, text_slices

TIERS = (1024, 4096, 16384)  # words a window
SHARD_WORDS = 4_000_000
STEP_WORDS = 16 * 16384
PACKED = "shard long, step long, tier long, window_no long, start long, doc_id long, piece long, doc_start long, n_words long"


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words) of documents that have words; words are what ASCII white space separates."""

    def count(batches):
        for batch in text_slices(batches):
            data, offsets = flat(batch.column("text"))
            doc, _, _ = runs(data, offsets, SPACED)
            n = np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64))], ["doc_id", "n_words"]).filter(pa.array(n > 0))

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_words long")


def best_fit(size: int, own: list, shorter: list[list]) -> tuple[list[list], list[list]]:
    """Windows of `size`, filled from `own` and then from `shorter`; every list is sorted by length.

    An item is (length, key, piece, start). Returns the windows, and what is left of `shorter`.
    """
    room: list[tuple[int, int]] = []  # (free, window), sorted
    windows: list[list] = []
    for item in reversed(own):
        at = bisect_left(room, (item[0], -1))
        if at < len(room):
            free, k = room.pop(at)
        else:
            free, k = size, len(windows)
            windows.append([])
        windows[k].append(item)
        if free > item[0]:
            insort(room, (free - item[0], k))
    for tier in shorter:  # gaps take the longest piece that fits, of the longest tier first
        for j in range(len(room) - 1, -1, -1):
            free, k = room[j]
            while tier and (at := bisect_right(tier, free, key=lambda item: item[0])):
                item = tier.pop(at - 1)
                windows[k].append(item)
                free -= item[0]
            room[j] = (free, k)
    return windows, shorter


def pack_lengths(keys: np.ndarray, n_words: np.ndarray, tiers: tuple = TIERS, step_words: int = STEP_WORDS) -> list[tuple]:
    """(step, tier, window, start, key index, piece, doc_start, words) of every piece of one shard."""
    tiers = tuple(sorted(tiers))
    routed: list[list] = [[] for _ in tiers]
    for k in np.lexsort((keys, n_words)).tolist():
        left, start, piece = int(n_words[k]), 0, 0
        while left:
            part = min(left, tiers[-1])
            routed[bisect_left(tiers, part)].append((part, k, piece, start))
            left, start, piece = left - part, start + part, piece + 1
    filled = []
    for t in range(len(tiers) - 1, -1, -1):
        routed[t].sort()
        windows, rest = best_fit(tiers[t], routed[t], [routed[s] for s in range(t - 1, -1, -1)])
        for s, left in zip(range(t - 1, -1, -1), rest):
            routed[s] = left
        filled += [(tiers[t], items) for items in windows]
    steps = max(1, -(-sum(size for size, _ in filled) // step_words))
    # Costliest first, each tier dealt back and forth from where the last one stopped.
    filled.sort(key=lambda w: (-w[0], -sum(item[0] ** 2 for item in w[1]), min(item[1:3] for item in w[1])))
    rows, number = [], dict.fromkeys(tiers, 0)
    for turn, (size, items) in enumerate(filled):
        lap, at = divmod(turn, steps)
        step, start = (at if lap % 2 == 0 else steps - 1 - at), 0
        for length, k, piece, doc_start in items:
            rows.append((step, size, number[size], start, k, piece, doc_start, length))
            start += length
        number[size] += 1
    return rows


def packed(docs: DataFrame, tiers: tuple = TIERS, shard_words: int = SHARD_WORDS, step_words: int = STEP_WORDS) -> DataFrame:
    """A row for each piece: (shard, step, tier, window_no, start, doc_id, piece, doc_start, n_words).

    The piece's n_words words from doc_start on stand at `start` in window `window_no` of its shard and
    tier. Every word of every document is in exactly one piece. Documents with a null, empty or
    blank text have no words and no row; rows with a null doc_id are packed and keep it null;
    repeated rows are packed each; ties are ordered by doc_id. Documents of any length are cut, never
    shortened. Columns other than doc_id and text aren't read. An empty table gives no rows.
    """
    sizes = cut(lengths(docs))
    total = sizes.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))

    def pack(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].combine_chunks()
        key = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        rows = pack_lengths(key, group["n_words"].to_numpy(), tiers, step_words)
        step, tier, window, start, k, piece, doc_start, n = (np.array(x, np.int64) for x in zip(*rows))
        columns = {"shard": np.full(len(k), group["shard"][0].as_py()), "step": step, "tier": tier, "window_no": window, "start": start, "doc_id": ids.take(pa.array(k)), "piece": piece, "doc_start": doc_start, "n_words": n}
        return pa.table(columns)

    return sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(shards))).groupBy("shard").applyInArrow(pack, PACKED)
