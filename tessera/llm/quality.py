"""Quality classifier: random-indexing word vectors, pooled per document, and a small numpy network.

Every distinct word (by 64-bit hash) has a sparse random index vector; its word vector is the sum of the
index vectors of its neighbours over the whole corpus, so it takes one pass and partial sums simply add.
No task and no driver holds all words: texts are read in units, a unit sends its words' counts and sums to
buckets of the hash range, and each bucket answers with what the whole corpus has, in the order it was asked.
A document is the mean of its words' vectors, once weighted by rarity and once plain. A two-layer
network is trained on labelled documents, and its logits are divided by a temperature fitted on held-out
ones, so that its probabilities are calibrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import K1, K3, U, byte_table, cut, flat, hash_runs, keep_ids, mix, release, runs, small_batches, text_slices, whole_groups

DIMS, NEIGHBOURS, SPOTS = 32, 2, 2
#: Labelled rows that the network is trained and calibrated on, at most: the lowest hashes of doc_id.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, RATE, HELD_OUT = 32, 60, 0.01, 0.25
KEEP = 0.5
KINDS = byte_table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'", r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~""", high=1)


#: Distinct words and words from which a unit is closed; both bound a task's memory.
UNIT_WORDS, UNIT_TOKENS = 1 << 19, 1 << 23
#: Buckets for each partition of the texts, and the most there are.
SPREAD, MOST_BITS = 8, 16


def hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word or run of punctuation, in the case it is written in."""
    data, offsets = flat(text)
    doc, start, end = runs(data, offsets, KINDS)
    return doc, hash_runs(data, start, end).view(np.int64)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(spot, sign), each words x SPOTS: where a word's index vector isn't zero."""
    m = mix(h.view(np.uint64)[:, None] * U(K1) + np.arange(1, SPOTS + 1, dtype=np.uint64) * U(K3))
    return (m % U(DIMS)).astype(np.int64), np.where((m >> U(40)) & U(1), 1.0, -1.0)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string, each number's lowest bytes together, then the next ones."""
    raw = b"".join(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def restored(blob: bytes, *shapes: tuple[int, str]) -> list[np.ndarray]:
    """The arrays of squeezed(), of which the lengths and types are known."""
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for n, kind in shapes:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def packed_words(n: np.ndarray, sums: np.ndarray, h: np.ndarray | None = None) -> bytes:
    """Counts, sums and, if given, ascending hashes of some words; sums take a byte each where they fit, else eight."""
    wide = (np.abs(sums) > 127).any(1)
    parts = [n.astype("<i8"), wide.view(np.uint8), sums[~wide].astype(np.int8), sums[wide].astype("<i8")]
    if h is not None:
        parts.append(np.diff(h, prepend=np.uint64(0)))
    return len(n).to_bytes(4, "little") + int(wide.sum()).to_bytes(4, "little") + squeezed(*parts)


def unpacked_words(blob: bytes, hashes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    m, w = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    shapes = [(m, "<i8"), (m, "|u1"), ((m - w) * DIMS, "|i1"), (w * DIMS, "<i8")] + [(m, "<u8")] * hashes
    n, wide, low, high, *rest = restored(blob[8:], *shapes)
    sums = np.empty((m, DIMS), np.int64)
    sums[wide == 0], sums[wide == 1] = low.reshape(-1, DIMS), high.reshape(-1, DIMS)
    return n, sums, np.cumsum(rest[0], dtype=np.uint64) if hashes else None


def units(batches):
    """(number, distinct words, parts) of successive texts of a partition; a part is (batch, document and place in its own words of each word, own words)."""
    number, known, held, tokens = 0, np.zeros(0, np.uint64), [], 0
    for batch in text_slices(batches):
        doc, h = hashed(batch.column("text"))
        own, at = np.unique(h.view(np.uint64), return_inverse=True)
        held.append((batch, doc, at.astype(np.int32), own))
        known, tokens = np.union1d(known, own), tokens + len(h)
        if len(known) >= UNIT_WORDS or tokens >= UNIT_TOKENS:
            yield number, known, held
            number, known, held, tokens = number + 1, np.zeros(0, np.uint64), [], 0
    if held:
        yield number, known, held


def context(doc: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Words x DIMS: the summed index vectors of the neighbours of each of some texts' own words."""
    spot, sign = index_vectors(own)
    total = np.zeros(len(own) * DIMS)
    for step in range(1, NEIGHBOURS + 1):
        near = doc[step:] == doc[:-step]
        left, right = at[:-step][near].astype(np.int64), at[step:][near].astype(np.int64)
        for x, y in ((left, right), (right, left)):
            for k in range(SPOTS):
                total += np.bincount(x * DIMS + spot[y, k], sign[y, k], len(total))
    return total.reshape(-1, DIMS)


def placed(docs: DataFrame) -> DataFrame:
    """(place, doc_id, text): place is the partition of docs, which a task above a union wouldn't know."""
    return small_batches(docs).select(F.spark_partition_id().alias("place"), "doc_id", "text")


def unit_name(held: list, number: int) -> int:
    return (held[0][0].column("place")[0].as_py() << 32) + number


def requests(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, unit, blob): each unit's words of each bucket, with the unit's own counts and sums."""

    def run(batches):
        for number, known, held in units(batches):
            n, sums = np.zeros(len(known), np.int64), np.zeros((len(known), DIMS), np.int32)
            for _, doc, at, own in held:
                where = np.searchsorted(known, own)
                n[where] += np.bincount(at, minlength=len(own))
                sums[where] += context(doc, at, own).astype(np.int32)
            bucket = (known >> U(64 - bits)).astype(np.int64)
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(known) else np.zeros(0, np.int64)
            blobs = [packed_words(n[x:y], sums[x:y], known[x:y]) for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(known)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(np.full(len(begin), unit_name(held, number))), pa.array(blobs, pa.binary())], ["bucket", "unit", "blob"])

    return placed(docs).mapInArrow(run, "bucket long, unit long, blob binary")


def summed(asked: DataFrame, answer: bool) -> DataFrame:
    """Of requests: (unit, bucket, blob), the whole corpus's counts and sums of the words asked for; or (h, n, blob), a row for each word."""

    def run(batches):
        for group in whole_groups(batches, "bucket", 1):
            bucket, unit, blobs = group["bucket"].to_numpy(), group["unit"].to_numpy(), group["blob"].to_pylist()
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
                n, sums, h = (np.concatenate(x) for x in zip(*(unpacked_words(b, True) for b in blobs[lo:hi])))
                size = [int.from_bytes(b[:4], "little") for b in blobs[lo:hi]]
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                n, sums = np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first, axis=0)
                if not answer:
                    blob = [packed_words(n[k : k + 1], sums[k : k + 1]) for k in range(len(n))]
                    yield pa.RecordBatch.from_arrays([pa.array(h[order][first].view(np.int64)), pa.array(n), pa.array(blob, pa.binary())], ["h", "n", "blob"])
                    continue
                of = np.empty(len(h), np.int64)
                of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                ends = np.cumsum(size)
                out = [packed_words(n[of[y - k : y]], sums[of[y - k : y]]) for k, y in zip(size, ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(unit[lo:hi]), pa.array(bucket[lo:hi]), pa.array(out, pa.binary())], ["unit", "bucket", "blob"])

    ordered = asked.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "unit long, bucket long, blob binary" if answer else "h long, n long, blob binary")


def bucket_bits(docs: DataFrame) -> int:
    """log2 of the number of buckets: it follows the number of the texts' partitions."""
    return min(MOST_BITS, max(1, (SPREAD * docs.rdd.getNumPartitions() - 1).bit_length()))


def word_sums(docs: DataFrame) -> DataFrame:
    """(h, n, blob) of each distinct word: its occurrences and the summed index vectors of its neighbours."""
    return summed(requests(docs, bucket_bits(docs)), False)


def context_sums(docs: DataFrame) -> np.ndarray:
    """Words x (DIMS + 1), by hash: word_sums in one array, for tables of few words."""
    found = word_sums(docs).orderBy("h").toArrow()
    sums = [unpacked_words(b, False)[1] for b in found["blob"].to_pylist()]
    return np.column_stack((np.concatenate(sums) if sums else np.zeros((0, DIMS)), found["n"].to_numpy())).astype(np.float64)


def word_vectors(sums: np.ndarray, total: float | None = None) -> np.ndarray:
    """Words x 2 DIMS: unit vectors, weighted by rarity (among total words, else those of sums) and plain."""
    vector, count = sums[:, :DIMS], sums[:, DIMS]
    unit = vector / np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
    rare = 1e-3 / (1e-3 + count / max(1.0, count.sum() if total is None else total))
    return np.hstack((unit * rare[:, None], unit)).astype(np.float32)


def pool(doc: np.ndarray, word: np.ndarray, times: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Mean of the vectors of each of n documents' words, that occur so many times; zeros for one without words."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    step = 1 << 16  # words whose vectors are laid out at once
    for s in range(0, len(doc), step):
        d, t = doc[s : s + step], times[s : s + step]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        out[d[first]] += np.add.reduceat(vectors[word[s : s + step]] * t[:, None].astype(np.float32), first, axis=0)
    return out / np.maximum(np.bincount(doc, times, n), 1)[:, None].astype(np.float32)


def bags(docs: DataFrame) -> DataFrame:
    """(unit, bucket, blob): the words of each unit's texts, as numbers in the unit's list of words; bucket is below 0."""

    def run(batches):
        for number, known, held in units(batches):
            blobs = []
            for batch, doc, at, own in held:
                pair, times = np.unique(doc * max(1, len(known)) + np.searchsorted(known, own)[at], return_counts=True)
                doc, word = np.divmod(pair, max(1, len(known)))
                ids = batch.column("doc_id")
                size = np.bincount(doc, minlength=batch.num_rows)
                step = np.diff(word, prepend=0)
                begin = (np.cumsum(size) - size)[size > 0]
                step[begin] = word[begin]
                parts = squeezed(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).view(np.uint8), size.astype("<i4"), step.astype("<i4"), times.astype("<i4"))
                blobs.append(batch.num_rows.to_bytes(8, "little") + len(word).to_bytes(8, "little") + parts)
            check = int(np.bitwise_xor.reduce(known)) if len(known) else 0
            rows = [len(known).to_bytes(8, "little") + check.to_bytes(8, "little"), *blobs]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), unit_name(held, number))), pa.array(np.arange(len(rows)) - len(rows) - 1), pa.array(rows, pa.binary())], ["unit", "bucket", "blob"])

    return placed(docs).mapInArrow(run, "unit long, bucket long, blob binary")


def pooled(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the pooled vector of each row, as bytes of 32-bit floats.

    docs is read three times, and each time its partitions must hold the same rows in the same order, as a
    table's do; if a unit's words have changed in between, the job fails.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(hashed(b.column("text"))[0]) for b in text_slices(batches))], pa.int64())], ["n"])

    total = float(small_batches(docs).select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0)

    def run(batches):
        for group in whole_groups(batches, "unit", 1):
            unit, bucket, blobs = group["unit"].to_numpy(), group["bucket"].to_numpy(), group["blob"].to_pylist()
            begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(unit)]):
                texts, known = lo + int(np.searchsorted(bucket[lo:hi], -1)), []
                vectors = [word_vectors(np.column_stack((sums, n)), total) for n, sums, _ in (unpacked_words(b, False) for b in blobs[texts:hi])]
                vectors = np.concatenate(vectors) if vectors else np.zeros((0, 2 * DIMS), np.float32)
                if len(vectors) != int.from_bytes(blobs[lo][:8], "little"):
                    raise ValueError("the texts' partitions have changed between two reads")
                for blob in blobs[lo + 1 : texts]:
                    rows, pairs = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
                    ids, null, size, step, times = restored(blob[16:], (rows, "<i8"), (rows, "|u1"), (rows, "<i4"), (pairs, "<i4"), (pairs, "<i4"))
                    doc = np.repeat(np.arange(rows), size)
                    walk = np.cumsum(step.astype(np.int64))
                    start = (np.cumsum(size) - size)[size > 0]
                    word = walk - np.repeat(walk[start] - step[start], size[size > 0])
                    x = pool(doc, word, times, vectors, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null == 1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    answers = summed(requests(docs, bucket_bits(docs)), True)
    both = small_batches(answers.union(bags(docs)))
    return both.repartition("unit").sortWithinPartitions("unit", "bucket").mapInArrow(run, "doc_id long, x binary")


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(((x - net["mean"]) / net["std"]) @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def probability(net: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(net, x) / net["temperature"], -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """A two-layer network, trained by Adam on three quarters of the rows and calibrated on the rest.

    Without rows of both kinds the network gives the share of good ones (or 1 without any row).
    """
    rng, dims = np.random.default_rng(seed), x.shape[1] if len(x) else 2 * DIMS
    net = {"mean": np.zeros(dims), "std": np.ones(dims), "w1": np.zeros((dims, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": 0.0, "temperature": 1.0}
    if len(set(y.tolist())) < 2:
        net["b2"] = -50.0 if len(y) and y[0] == 0 else 50.0
        return net
    order = rng.permutation(len(x))
    held, used = order[: int(len(x) * HELD_OUT)], order[int(len(x) * HELD_OUT) :]
    net["mean"], net["std"] = x[used].mean(0), x[used].std(0) + 1e-6
    net["w1"], net["w2"] = rng.normal(0, dims**-0.5, (dims, HIDDEN)), rng.normal(0, HIDDEN**-0.5, HIDDEN)
    names = ("w1", "b1", "w2", "b2")
    m, v, turn = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    z, t = (x - net["mean"]) / net["std"], y.astype(np.float64)
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for s in range(0, len(used), 256):
            rows = used[s : s + 256]
            hidden = np.tanh(z[rows] @ net["w1"] + net["b1"])
            error = (1 / (1 + np.exp(-(hidden @ net["w2"] + net["b2"]))) - t[rows]) / len(rows)
            back = np.outer(error, net["w2"]) * (1 - hidden**2)
            grad = {"w1": z[rows].T @ back + 1e-3 * net["w1"], "b1": back.sum(0), "w2": hidden.T @ error + 1e-3 * net["w2"], "b2": error.sum()}
            turn += 1
            for k in names:
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
                net[k] = net[k] - RATE * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    if len(held):
        raw, grid = logits(net, x[held]), np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, raw / c) - y[held] * raw / c) for c in grid]
        net["temperature"] = float(grid[int(np.argmin(loss))])
    return net


def labelled(features: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of at most `rows` labelled documents, those with the lowest hash of doc_id."""
    pick = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pick = cut(pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    mine = keep_ids(features, pick.select("doc_id"))
    found = pick.join(mine.groupBy("doc_id").agg(F.min("x").alias("x")), "doc_id").orderBy("doc_id").select("x", "quality").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 2 * DIMS))
    return x.astype(np.float64), found["quality"].to_numpy().astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, probability, keep): the calibrated probability that each row of docs is of good quality.

    The word vectors cover all documents; the network is trained on at most sample_rows labelled ones.
    keep is probability >= 0.5. Null, empty and wordless texts get the probability of a zero vector;
    a null doc_id stays null and isn't trained on; repeated rows are scored each. Of a doc_id with several
    labels the highest counts. Texts are read whole; other columns aren't read.
    """
    features = cut(pooled(docs))
    release(docs.sparkSession)
    net = train(*labelled(features, labels, sample_rows))

    def score(x: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(x), -1).astype(np.float64)
        return pa.array(np.round(probability(net, rows), 6))

    p = F.arrow_udf(score, "double")("x")
    return features.select("doc_id", p.alias("probability")).withColumn("keep", F.col("probability") >= KEEP)
