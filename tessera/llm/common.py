"""Pieces that the operators share: Arrow slices, byte-level tokenising, hashing, size-checked joins."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut as cut

SLICE_BYTES = 4 << 20
#: Rows of ids (about 16 bytes each) that may be broadcast; beyond it the join is a shuffle join.
BROADCAST_ROWS = 4_000_000

U = np.uint64
K1, K2, K3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """df joined to ids on ids' columns; ids is broadcast only if its counted rows are within limit.

    ids should be materialised already (cut), since it is counted first.
    """
    small = ids.count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), ids.columns, how).select(df.columns)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished steps that nothing refers to any more, which else wait for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session makes Arrow batches of a few megabytes at most, however long the texts are, from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    return df


def once(name: str, make: Callable):
    """make()'s result, kept for later tasks of this Python worker; functions travel by value, so their modules keep nothing."""
    held = sys.__dict__.setdefault("_tessera_once", {})
    if name not in held:
        held[name] = make()
    return held[name]


# --- Arrow -----------------------------------------------------------------------------------


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes of text (one row at least), which bounds a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.concatenate(([0], np.cumsum(size))), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def in_slices(run: Callable, text: pa.Array, *more: pa.Array) -> pa.Array:
    """run(text, *more), called on slices of bounded size; for Arrow functions, which get whole batches."""
    batch = pa.RecordBatch.from_arrays([text, *more], ["text", *(str(k) for k in range(len(more)))])
    parts = [run(*part.columns) for part in text_slices([batch])]
    return pa.concat_arrays(parts) if parts else run(text, *more)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    if not n or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each maximal run of bytes of one class in table; class 0 separates."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = table[data]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new[offsets] = True
    edge = np.flatnonzero(new)
    keep = kind[edge[:-1]] > 0
    start, end = edge[:-1][keep], edge[1:][keep]
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets))), start, end


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(K3)
    h = (h ^ (h >> U(29))) * U(K2)
    return h ^ (h >> U(32))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], eight bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * U(K1)
    h = (h ^ (eight[start] & _MASK[np.minimum(size, 8)])) * U(K2)
    h ^= h >> U(31)
    left, at = np.flatnonzero(size > 8), 8
    while len(left):
        part = eight[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)]
        g = ((h[left] * U(K1)) ^ part) * U(K2)
        h[left] = g ^ (g >> U(31))
        at += 8
        left = left[size[left] > at]
    return mix(h)


def byte_table(*classes: str | bytes, high: int = 0) -> np.ndarray:
    """Class of each byte: k+1 for those in classes[k], `high` for those outside ASCII, else 0."""
    table = np.zeros(256, np.uint8)
    table[128:] = high
    for k, chars in enumerate(classes):
        table[np.frombuffer(chars if isinstance(chars, bytes) else chars.encode(), np.uint8)] = k + 1
    return table


#: Lower-case words: ASCII letters and digits, and everything outside ASCII. SQL: [a-z0-9\x{80}-\x{10FFFF}]+
WORD = byte_table("abcdefghijklmnopqrstuvwxyz0123456789", high=1)
#: What ASCII white space separates.
SPACED = np.where(np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)), 0, 1).astype(np.uint8)


def words(column: pa.Array, table: np.ndarray = WORD, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, position in document) of each word of a string column."""
    data, offsets = flat(pc.utf8_lower(column) if lower else column)
    doc, start, end = runs(data, offsets, table)
    return doc, hash_runs(data, start, end), places(doc, len(offsets) - 1)


def places(doc: np.ndarray, n: int) -> np.ndarray:
    """0, 1, 2, ... within each run of equal, ascending document numbers."""
    first = np.searchsorted(doc, np.arange(n))
    return np.arange(len(doc)) - first[doc] if len(doc) else np.zeros(0, np.int64)


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_runs(raw, np.array([0]), np.array([len(raw)]))[0])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of h[i:i+width] for each i at which it fits; callers drop those that cross documents."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, inverse = U(K1), U(pow(K1, -1, 1 << 64))
    power = np.multiply.accumulate(np.full(len(h), base, np.uint64))
    back = np.multiply.accumulate(np.full(n, inverse, np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)))
    return mix((total[width:] - total[:n]) * back)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about `most` rows or more that never part rows of one key; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most or batch.column(key)[0] == batch.column(key)[-1]:
            continue
        last = batch.column(key)[-1]
        at = pc.index(batch.column(key), last).as_py()
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, at)])
        held, rows = [batch.slice(at)], batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
