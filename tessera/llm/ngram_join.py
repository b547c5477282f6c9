"""Jaccard self-join of word n-gram sets, pruned by an R-tree over count vectors.

A document's n-grams are hashed into groups; the group counts are a point. Two sets share at most the
sum of the coordinates' minima, and a tree node's upper corner bounds that for all points below it, so a
node or a point is dropped when the bound can't reach the threshold. What survives is verified on the
n-gram sets themselves. A point has about half as many groups as its set has n-grams, a power of two, so
the bound is as sharp for long documents as for short ones; a longer point is folded to meet a shorter one.

One tree over all documents can't be spread over a cluster, so documents are first routed: each goes
to the groups of its ROUTES smallest n-gram hashes, and a tree is built in each group of more than four
(the pairs of smaller ones are bounded by their points alone). A large group is joined in blocks, two a task.
A pair is made only where it meets first, at its smallest common hash. Different sets above one half share two
n-grams at least, so the last of the hashes opens no group, and in a group of more than SPLIT rows, which a common phrase
makes, only rows that share a further hash are tried, by their points alone: a tree prunes little where most rows are unlike. Two sets of Jaccard similarity j
share fewer than two of their ROUTES smallest with a probability of about (1 - j) ** ROUTES * (1 + ROUTES * j / (1 - j))
(3e-7 at 0.6, ROUTES = 20); sets of at most ROUTES n-grams are never missed. Documents with equal sets are joined once, as one.

Candidates and links grow with the square of a group of near copies, so neither is ever written: a group's first task
only names the rows that have candidates, a second one those that still have any by the flags of their n-grams, and the one
that holds their n-gram sets finds the candidates again and sums their links up to a count and a component for each row.
The more rows share a hash, the more of them have a candidate that only looks like one; flags take an eighth of the bytes or less
of sets that aren't short and leave few such rows, so sets are sent for little more than the rows that have links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, cut, keep_ids, mix, release, small_batches, text_slices, whole_groups, words
from .substring import numbered, variants

NGRAM, THRESHOLD, ROUTES = 3, 0.6, 20
#: Smallest and largest number of groups, as powers of two; counts are stored in four bits, and what is above is summed up.
LEAST_BITS, MOST_BITS, MOST_COUNT = 3, 20, 15
#: The same for flags, of which a set has between four and eight for each n-gram.
LEAST_FLAG_BITS, MOST_FLAG_BITS = 8, 23
FANOUT = 16
#: Rows of a group that are joined in one task; a larger group is parted into blocks, and each two blocks are a task.
CROWD = 1 << 14
#: Rows of a group above which they are tried only if they share a second hash.
SPLIT = 512
#: What fills up a row's list of hashes.
NONE = np.iinfo(np.uint64).max
#: Queries that go down the tree together, and pairs they may have there: both bound a task's memory.
TILE, TILE_PAIRS = 512, 1 << 19
#: Meetings of rows by their further hashes that are looked at together in a group that is split.
MET = 1 << 21


def gram_sets(text: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-grams, sorted by both; a text of fewer words is one n-gram."""
    doc, h, place = words(text)
    count = np.bincount(doc, minlength=len(text)) if len(doc) else np.zeros(len(text), np.int64)
    if not len(doc):
        return doc, h
    padded = np.concatenate((h, np.zeros(n - 1, np.uint64)))
    size = count[doc]
    gram = np.zeros(len(h), np.uint64)
    for k in range(n):
        inside = place + k < size
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[k : k + len(h)], np.uint64(k)))
    whole = (place + n <= size) | (place == 0)
    doc, gram = doc[whole], gram[whole]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]))
    return doc[new], gram[new]


def group_bits(size: np.ndarray) -> np.ndarray:
    """log2 of the number of groups of a set of so many n-grams."""
    return np.clip(np.log2(np.maximum(size, 1)).astype(np.int64) - 1, LEAST_BITS, MOST_BITS)


def packed_counts(gram: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bytes of each set, excess): the sets' group counts, two to a byte, and what went above 15."""
    bits = group_bits(size)
    width = (1 << bits) // 2
    begin = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(size)), size)
    group = (gram >> U(20)).astype(np.int64) & ((1 << bits[owner]) - 1)
    count = np.bincount(2 * begin[owner] + group, minlength=2 * int(width.sum()))
    over = np.flatnonzero(count > MOST_COUNT)
    excess = np.bincount(np.searchsorted(2 * begin, over, side="right") - 1, count[over] - MOST_COUNT, len(size)).astype(np.int64)
    low = np.minimum(count, MOST_COUNT).astype(np.uint8)
    return low[0::2] | (low[1::2] << 4), width, excess


def flag_bits(size: np.ndarray) -> np.ndarray:
    """log2 of the number of flags of a set of so many n-grams."""
    return np.clip(np.log2(np.maximum(size, 1)).astype(np.int64) + 3, LEAST_FLAG_BITS, MOST_FLAG_BITS)


def packed_flags(gram: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each set): the sets' flags, eight to a byte; an n-gram sets one, by other bits of its hash than its group."""
    bits = flag_bits(size)
    width = (1 << bits) // 8
    begin = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(size)), size)
    flag = np.zeros(8 * int(width.sum()), bool)
    flag[8 * begin[owner] + ((gram >> U(40)).astype(np.int64) & ((1 << bits[owner]) - 1))] = True
    return np.packbits(flag, bitorder="little"), width


def binaries(raw: np.ndarray, width: np.ndarray) -> pa.Array:
    """raw as binary values of so many bytes each."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(width))).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def points(docs: DataFrame, n: int = NGRAM, flagged: bool = False) -> DataFrame:
    """(doc_id, sig, sig2, size, excess, routes, vec) of each document with words, if flagged with flags; sig and sig2 identify its n-gram set."""

    def run(batches):
        for batch in text_slices(batches):
            doc, gram = gram_sets(batch.column("text"), n)
            if not len(doc):
                continue
            rows, first, size = np.unique(doc, return_index=True, return_counts=True)
            here = np.repeat(np.arange(len(rows)), size)
            vec, width, excess = packed_counts(gram, size)
            sig = np.add.reduceat(mix(gram ^ U(0x5851F42D4C957F2D)), first)
            sig2 = np.bitwise_xor.reduceat(gram, first)
            low = np.arange(len(gram)) - first[here] < ROUTES
            routes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.minimum(size, ROUTES)))).astype(np.int32)), pa.array(gram[low].view(np.int64)))
            columns = [batch.column("doc_id").take(pa.array(rows)), pa.array(sig.view(np.int64)), pa.array(sig2.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(excess.astype(np.int32)), routes, binaries(vec, width)]
            names = ["doc_id", "sig", "sig2", "size", "excess", "routes", "vec"]
            if flagged:
                columns, names = [*columns, binaries(*packed_flags(gram, size))], [*names, "flags"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).mapInArrow(run, "doc_id long, sig long, sig2 long, size int, excess int, routes array<long>, vec binary" + ", flags binary" * flagged)


class Points:
    """Count vectors of one Arrow batch, by number of groups."""

    def __init__(self, size: np.ndarray, excess: np.ndarray, vec: list[bytes]):
        self.size, self.excess, self.bits = size, excess, group_bits(size)
        self.at, self.of = np.zeros(len(size), np.int64), {}
        for k in np.unique(self.bits).tolist():
            rows = np.flatnonzero(self.bits == k)
            self.at[rows] = np.arange(len(rows))
            self.of[k] = np.frombuffer(b"".join([vec[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), -1)

    def counts(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The rows' counts in 2 ** k groups; none of them has fewer."""
        out = np.empty((len(rows), 1 << k), np.uint8 if self.bits[rows].max(initial=k) - k < 4 else np.uint32)
        for c in np.unique(self.bits[rows]).tolist():
            mine = self.bits[rows] == c
            raw = self.of[c][self.at[rows[mine]]]
            full = np.empty((len(raw), 1 << c), np.uint8)
            full[:, 0::2], full[:, 1::2] = raw & 15, raw >> 4
            out[mine] = full if c == k else full.reshape(len(raw), 1 << (c - k), 1 << k).sum(1)
        return out

    def reach(self, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Whether each pair of rows could reach t, by sizes and then by the sum of minima."""
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        ok = small >= t * large - 1e-9
        low = np.minimum(self.bits[a], self.bits[b])
        for k in np.unique(low[ok]).tolist():
            for rows in chunks(np.flatnonzero(ok & (low == k)), k):
                x, y = a[rows], b[rows]
                most = np.minimum(self.counts(x, k), self.counts(y, k)).sum(1, dtype=np.int64) + self.excess[x] + self.excess[y]
                ok[rows] = most * (1 + t) >= t * (self.size[x] + self.size[y]) - 1e-9
        return ok


class Flags:
    """Flags of one Arrow batch, by their number."""

    def __init__(self, size: np.ndarray, flags: list[bytes]):
        self.size, self.bits = size, flag_bits(size)
        self.at, self.of = np.zeros(len(size), np.int64), {}
        for k in np.unique(self.bits).tolist():
            rows = np.flatnonzero(self.bits == k)
            self.at[rows] = np.arange(len(rows))
            self.of[k] = np.frombuffer(b"".join([flags[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), -1)

    def folded(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The rows' flags as 2 ** k each; none of them has fewer."""
        out = np.empty((len(rows), (1 << k) // 8), np.uint8)
        for c in np.unique(self.bits[rows]).tolist():
            mine = self.bits[rows] == c
            raw = self.of[c][self.at[rows[mine]]]
            out[mine] = np.bitwise_or.reduce(raw.reshape(len(raw), 1 << (c - k), -1), axis=1)
        return out

    def reach(self, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Whether each pair of rows could reach t: a flag that only one of them has is an n-gram at least that the other lacks."""
        ok = np.zeros(len(a), bool)
        low = np.minimum(self.bits[a], self.bits[b])
        for k in np.unique(low).tolist():
            for rows in chunks(np.flatnonzero(low == k), k - 3):
                x, y = a[rows], b[rows]
                p, q = self.folded(x, k), self.folded(y, k)
                both = p & q
                lone = [np.bitwise_count(f ^ both).sum(1, dtype=np.int64) for f in (p, q)]
                most = np.minimum(self.size[x] - lone[0], self.size[y] - lone[1])
                ok[rows] = most * (1 + t) >= t * (self.size[x] + self.size[y]) - 1e-9
        return ok


def chunks(rows: np.ndarray, k: int) -> list[np.ndarray]:
    """rows in parts whose vectors of 2 ** k counts take some megabytes."""
    step = max(16, (1 << 22) >> k)
    return [rows[s : s + step] for s in range(0, len(rows), step)]


class RTree:
    """Packed R-tree of count vectors, FANOUT to a node; rows are sorted by kin, then by size.

    Rows of one kin other than 0 have met in another group already, and make no pair here.
    """

    def __init__(self, vec: np.ndarray, size: np.ndarray, excess: np.ndarray, kin: np.ndarray):
        self.order = np.lexsort((*vec.T[:2], size, kin))
        self.leaf, self.size, self.excess, self.kin = vec[self.order], size[self.order], excess[self.order], kin[self.order]
        self.levels = []
        high, small, large, spare, least, most = self.leaf, self.size, self.size, self.excess, self.kin, self.kin
        while len(high) > FANOUT:
            at = np.arange(0, len(high), FANOUT)
            high, large, spare, most = (np.maximum.reduceat(x, at) for x in (high, large, spare, most))
            small, least = np.minimum.reduceat(small, at), np.minimum.reduceat(least, at)
            self.levels.append((high, small, large, spare, least, most))

    def pairs(self, t: float):
        """Arrays of (row, row) whose bound reaches t; every unordered pair is tried once."""
        n, k = self.leaf.shape[0], int(self.leaf.shape[1]).bit_length() - 1
        tile = max(1, min(TILE, TILE_PAIRS // n))
        for base in range(0, n, tile):
            q = np.arange(base, min(n, base + tile))
            # Pairs (query, node), from the top level down.
            nodes = len(self.levels[-1][0]) if self.levels else n
            a, b = np.repeat(q, nodes), np.tile(np.arange(nodes), len(q))
            for depth in range(len(self.levels) - 1, -1, -1):
                high, small, large, spare, least, most = self.levels[depth]
                fits = (b + 1) * FANOUT ** (depth + 1) > a + 1  # what lies wholly before the query has tried it
                fits &= (small[b] * t <= self.size[a]) & (large[b] >= self.size[a] * t)
                fits &= ~((self.kin[a] > 0) & (least[b] == self.kin[a]) & (most[b] == self.kin[a]))
                a, b = a[fits], b[fits]
                ok = np.empty(len(a), bool)
                for rows in chunks(np.arange(len(a)), k):
                    x, y = a[rows], b[rows]
                    shared = np.minimum(self.leaf[x], high[y]).sum(1, dtype=np.int64) + self.excess[x] + spare[y]
                    ok[rows] = shared * (1 + t) >= t * (self.size[x] + small[y]) - 1e-9
                a, b = a[ok], b[ok]
                below = len(self.levels[depth - 1][0]) if depth else n
                a = np.repeat(a, FANOUT)
                b = (b[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                a, b = a[b < below], b[b < below]
            fits = (b > a) & (np.minimum(self.size[a], self.size[b]) >= t * np.maximum(self.size[a], self.size[b]) - 1e-9)
            fits &= (self.kin[a] != self.kin[b]) | (self.kin[a] == 0)
            a, b = a[fits], b[fits]
            for rows in chunks(np.arange(len(a)), k):
                x, y = a[rows], b[rows]
                shared = np.minimum(self.leaf[x], self.leaf[y]).sum(1, dtype=np.int64) + self.excess[x] + self.excess[y]
                ok = shared * (1 + t) >= t * (self.size[x] + self.size[y]) - 1e-9
                if ok.any():
                    yield self.order[x[ok]], self.order[y[ok]]


def crowd_pairs(points: Points, rows: np.ndarray, first: np.ndarray, key: np.uint64, t: float):
    """Candidate pairs of rows, a tree for each number of groups; rows with the same `first`, if below key, have met before."""
    bits, size = points.bits[rows], points.size[rows]
    value, at, count = np.unique(first, return_inverse=True, return_counts=True)
    kin = np.where((count[at] >= FANOUT) & (value[at] < key), at + 1, 0)
    for k in np.unique(bits).tolist():
        most = size[bits == k].max() / t
        here = np.flatnonzero((bits == k) | ((bits > k) & (size <= most)))
        mine = rows[here]
        tree = RTree(points.counts(mine, k), points.size[mine], points.excess[mine], kin[here])
        for a, b in tree.pairs(t):
            own = (points.bits[mine[a]] == k) | (points.bits[mine[b]] == k)
            yield mine[a[own]], mine[b[own]]


def split_pairs(points: Points, rows: np.ndarray, routes: np.ndarray, key: np.uint64, t: float):
    """Candidate pairs of rows, which all have the hash key, that have a hash above key in common too and none below it."""
    value, kin, count = np.unique(routes[rows, 0], return_inverse=True, return_counts=True)
    kin = np.where((count[kin] > 1) & (value[kin] < key), kin + 1, 0)  # rows with the same hash below key: they have met
    order = np.argsort(kin, kind="stable")
    rows, kin, n = rows[order], kin[order], len(rows)
    after = np.where(kin > 0, np.searchsorted(kin, kin, side="right"), np.arange(n) + 1)  # a row is tried with those from there on
    mine = routes[rows]
    row, column = np.nonzero((mine != NONE) & (mine != key))
    value, of = np.unique(mine[row, column], return_inverse=True)
    held = np.sort(of * n + row)  # the rows of each hash
    start = np.searchsorted(held, of * n + after[row])
    many = np.searchsorted(held, (of + 1) * n) - start
    live = many > 0
    row, start, many, above = row[live], start[live], many[live], value[of[live]] > key
    total = np.concatenate(([0], np.cumsum(many)))
    bits, size, bounds = points.bits[rows], points.size[rows], {}
    at, base = 0, 0
    while at < len(row):
        # Some rows with all the others: a table of flags of bounded size.
        base = int(row[at])
        to = int(np.searchsorted(total, total[at] + MET, side="right")) - 1
        last = min(int(row[to - 1]) if to > at else base, base + max(1, 2 * MET // n) - 1)
        last = max(base, last - 1) if to < len(row) and row[to] == last else last
        to = int(np.searchsorted(row, last, side="right"))
        reps = many[at:to]
        other = held[np.repeat(start[at:to] - (total[at:to] - total[at]), reps) + np.arange(total[to] - total[at])] % n
        cell = np.repeat((row[at:to] - base) * n, reps) + other
        met, high = np.zeros((last - base + 1) * n, bool), np.repeat(above[at:to], reps)
        met[cell[high]] = True
        met[cell[~high]] = False
        found = np.flatnonzero(met)
        a, b = found // n + base, found % n
        ok = np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[ok], b[ok]
        low = np.minimum(bits[a], bits[b])
        for k in np.unique(low).tolist():
            if k not in bounds:
                here = np.flatnonzero((bits == k) | ((bits > k) & (size <= size[bits == k].max() / t + 1e-6)))
                where = np.zeros(n, np.int64)
                where[here] = np.arange(len(here))
                bounds[k] = where, points.counts(rows[here], k)
            where, counts = bounds[k]
            for pair in chunks(np.flatnonzero(low == k), k):
                x, y = a[pair], b[pair]
                shared = np.minimum(counts[where[x]], counts[where[y]]).sum(1, dtype=np.int64) + points.excess[rows[x]] + points.excess[rows[y]]
                ok = shared * (1 + t) >= t * (size[x] + size[y]) - 1e-9
                yield rows[x[ok]], rows[y[ok]]
        at = to


def first_common(routes: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Whether each pair's key is the smallest hash that rows a and b of routes (padded with the largest) share."""
    out = np.empty(len(a), bool)
    for s in range(0, len(a), step):
        x, y = routes[a[s : s + step]], routes[b[s : s + step]]
        low = x < key[s : s + step, None]
        earlier = np.zeros(len(x), bool)
        for k in np.flatnonzero(low.any(0)).tolist():
            earlier |= low[:, k] & (x[:, k : k + 1] == y).any(1)
        out[s : s + step] = ~earlier
    return out


class Groups:
    """Rows (key, route, block, cross, split) in order of key, with their points and hashes; see routed_rows."""

    def __init__(self, table: pa.Table, points: Points, routes: np.ndarray):
        self.key, self.block, self.cross, self.split = (table[c].to_numpy() for c in ("key", "block", "cross", "split"))
        self.route = table["route"].to_numpy().view(np.uint64)
        self.points, self.routes = points, routes

    def met(self, t: float):
        """(a, b, first): pairs of rows whose bound reaches t, and whether they are known to meet first in their group."""
        key, points = self.key, self.points
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(begin[1:], len(key))
        few = end - begin <= 4  # most groups are a few rows: all of them at once
        a, b = small_pairs(begin[few], end[few])
        ok = points.reach(a, b, t)
        yield a[ok], b[ok], False
        for lo, hi in zip(begin[~few].tolist(), end[~few].tolist()):
            rows, route = np.arange(lo, hi), self.route[lo]
            split = bool(self.split[lo] and hi - lo > FANOUT and (self.route[lo:hi] == route).all())
            found = split_pairs(points, rows, self.routes, route, t) if split else crowd_pairs(points, rows, self.routes[rows, 0], route, t)
            for a, b in found:
                yield a, b, split

    def pairs(self, t: float, done: np.ndarray | None = None):
        """(a, b): candidate pairs of rows, each only in the group where it meets first; none of two rows that are done."""
        for a, b, first in self.met(t):
            own = (self.route[a] == self.route[b]) & (~self.cross[a] | (self.block[a] != self.block[b]))
            if done is not None:
                own &= ~(done[a] & done[b])
            a, b = a[own], b[own]
            if not first:
                ok = first_common(self.routes, a, b, self.route[a])
                a, b = a[ok], b[ok]
            yield a, b


def matrix(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ROUTES smallest of each row's ascending hashes, filled up with NONE."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    low = place < ROUTES
    routes = np.full((len(size), ROUTES), NONE)
    routes[np.repeat(np.arange(len(size)), size)[low], place[low]] = flat[low]
    return routes


def routed_rows(routed: DataFrame, t: float) -> DataFrame:
    """The rows of routed(key, route, block, cross, split, node, members, size, excess, routes, vec) that have a candidate in their group, by an R-tree.

    route is the n-gram hash that the group shares; where two blocks of it meet (cross), pairs within a block aren't made.
    If routed has flags too, candidates must also reach t by these. Rows of a group that is split need all their hashes in
    routes, others those up to route.
    """
    columns = ["key", "route", "block", "cross", "split", "node", "members"]
    flagged = "flags" in routed.columns

    def run(batches):
        for group in whole_groups(batches, "key", 1 << 14):
            group = group.combine_chunks()
            points = Points(group["size"].to_numpy().astype(np.int64), group["excess"].to_numpy().astype(np.int64), group["vec"].to_pylist())
            lists = group["routes"].combine_chunks()
            groups = Groups(group, points, matrix(lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())))
            flags = Flags(points.size, group["flags"].to_pylist()) if flagged else None
            hit = np.zeros(group.num_rows, bool)
            for a, b in groups.pairs(t, hit):
                if flags is not None:
                    ok = flags.reach(a, b, t)
                    a, b = a[ok], b[ok]
                hit[a] = hit[b] = True
            yield from group.select(columns).filter(pa.array(hit)).to_batches()

    # Where a group isn't split, first_common asks for what lies below the group's own hash only.
    upto = F.slice("routes", 1, F.array_position("routes", F.col("route")).cast("int"))
    ordered = routed.withColumn("routes", F.when(F.col("split"), F.col("routes")).otherwise(upto)).repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key long, route long, block long, cross boolean, split boolean, node long, members long")


def blocked(shared: DataFrame) -> DataFrame:
    """(key, route, block, cross, split, node) of (route, node, rows): a row for each task that joins the node's block with another or with itself."""
    blocks = F.ceil(F.col("rows") / CROWD)
    mine = shared.select("route", "node", (F.col("rows") > SPLIT).alias("split"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("long").alias("block"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("route")).otherwise(F.xxhash64("route", F.least("block", "other"), F.greatest("block", "other")))
    return met.select(key.alias("key"), "route", "block", (F.col("block") != F.col("other")).alias("cross"), "split", "node")


def small_pairs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each of some short ranges."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    most = int((end - begin).max(initial=0))
    for i in range(most):
        for j in range(i + 1, most):
            there = begin[begin + j < end]
            a.append(there + i)
            b.append(there + j)
    return np.concatenate(a), np.concatenate(b)


def sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, grams): the n-gram hashes of each document, ascending, eight bytes each."""

    def run(batches):
        for batch in text_slices(batches):
            doc, gram = gram_sets(batch.column("text"), n)
            place = np.searchsorted(doc, np.arange(batch.num_rows + 1)) * 8
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(place.astype(np.int64).tobytes()), pa.py_buffer(gram)])
            yield pa.RecordBatch.from_arrays([batch.column("node"), raw.cast(pa.binary())], ["node", "grams"])

    return docs.mapInArrow(run, "node long, grams binary")


class Sets:
    """N-gram sets of some rows: their hashes one after another, and how many each has."""

    def __init__(self, gram: np.ndarray, size: np.ndarray):
        self.size, self.start = size, np.cumsum(size) - size
        distinct, self.local = np.unique(gram, return_inverse=True)
        self.flag = np.zeros(len(distinct), bool)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of sets a[k] and b[k]; a is sorted, no set is empty."""
        size, start, local, flag, out = self.size, self.start, self.local, self.flag, np.zeros(len(a), np.int64)
        begin = np.flatnonzero(np.append(np.ones(min(1, len(a)), bool), a[1:] != a[:-1]))
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(a)).tolist()):
            mine = local[start[a[lo]] : start[a[lo]] + size[a[lo]]]
            flag[mine] = True
            step = max(1, (1 << 20) // max(1, int(size[b[lo:hi]].max())))
            for s in range(lo, hi, step):
                y = b[s : min(hi, s + step)]
                n = size[y]
                at = np.repeat(start[y] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out[s : s + len(y)] = np.add.reduceat(flag[local[at]], np.cumsum(n) - n, dtype=np.int64)
            flag[mine] = False
        return out


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes label, the lowest row of each row's component so far, that of the components with a[k] and b[k] linked."""
    while True:
        x, y = label[a], label[b]
        live = x != y
        if not live.any():
            return
        a, b, x, y = a[live], b[live], x[live], y[live]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def verified(rows: DataFrame, grams: DataFrame, t: float, summed: bool) -> DataFrame:
    """(a, b, jaccard) of the pairs of nodes in a group of rows (see routed_rows) that reach t; a group's sets meet in one task.

    If summed, these are (a, b, links) instead: a row for each node a of a group that has such pairs there, with the number of
    members that they link it to, and a node b that is the same for all of a component of the group's.
    """
    held = rows.join(grams, "node")

    def run(batches):
        for group in whole_groups(batches, "key", 1 << 12):
            group = group.combine_chunks()
            grams = group["grams"].combine_chunks()
            offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1]
            gram = np.frombuffer(grams.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
            size = np.diff(offsets).astype(np.int64) // 8
            vec, width, excess = packed_counts(gram, size)
            ends = np.cumsum(width)
            points = Points(size, excess, [vec[e - w : e].tobytes() for e, w in zip(ends.tolist(), width.tolist())])
            held, node, members = Sets(gram, size), group["node"].to_numpy(), group["members"].to_numpy()
            label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
            for a, b in Groups(group, points, matrix(gram, size)).pairs(t):
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                same = held.shared(a, b)
                j = same / (size[a] + size[b] - same)
                ok = j >= t
                a, b = a[ok], b[ok]
                if not summed:
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(j[ok])], ["a", "b", "jaccard"])
                    continue
                np.add.at(links, a, members[b])
                np.add.at(links, b, members[a])
                joined(label, a, b)
            if summed:
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(links[some])], ["a", "b", "links"])

    ordered = small_batches(held).repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a long, b long, " + ("links long" if summed else "jaccard double"))


def nodes_and_edges(docs: DataFrame, t: float, n: int, summed: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, members) of every document with words, and verified's rows about nodes, which are doc_ids; members shared a node's set.

    docs has one row for each doc_id; see each_text.
    """
    least = 2 if t > 0.5 else 1  # n-grams that different sets share at least
    every = cut(points(docs, n))
    node = every.groupBy("sig", "sig2", "size").agg(F.min("doc_id").alias("node"), F.count("*").alias("members"), F.first("excess").alias("excess"), F.first("routes").alias("routes"), F.first("vec").alias("vec"))
    member = every.select("doc_id", "sig", "sig2", "size").join(node.select("sig", "sig2", "size", "node", "members"), ["sig", "sig2", "size"]).select("doc_id", "node", "members")
    keys = node.select(F.explode(F.slice("routes", F.lit(1), F.size("routes") - (least - 1))).alias("route"), "node")
    crowds = keys.groupBy("route").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    shared = blocked(keys.join(crowds, "route"))
    if least == 1:
        shared = shared.withColumn("split", F.lit(False))
    routed = shared.join(node.select("node", "members", "size", "excess", "routes", "vec"), "node")
    rows = cut(routed_rows(routed, t))
    del keys, crowds, shared, routed
    release(docs.sparkSession)
    flagged = points(keep_ids(docs, of_rows(rows)), n, True).select(F.col("doc_id").alias("node"), "size", "excess", "routes", "vec", "flags")
    rows = cut(routed_rows(rows.join(flagged, "node"), t))
    del flagged
    release(docs.sparkSession)
    texts = keep_ids(docs, of_rows(rows)).withColumnRenamed("doc_id", "node")
    return member, verified(rows, sets(texts, n), t, summed)


def of_rows(rows: DataFrame) -> DataFrame:
    """(doc_id) of the nodes of rows."""
    return cut(rows.select(F.col("node").alias("doc_id")).distinct())


def similar_pairs(docs: DataFrame, t: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of documents whose word n-gram sets have Jaccard >= t.

    Words are runs of letters and digits in lower case; a text with fewer than n words is one n-gram.
    Null, empty and wordless texts and null doc_ids have no pairs. A repeated row makes no pair with
    itself; of a doc_id with several texts each is joined, and the highest Jaccard of two documents' texts
    is theirs. Texts are read whole; other columns aren't read.
    """
    named, extra = each_text(docs)
    member, edges = nodes_and_edges(named, t, n, False)
    member = cut(member)
    edges = cut(edges)
    release(docs.sparkSession)
    x, y = member.select(F.col("node").alias("a"), F.col("doc_id").alias("da")), member.select(F.col("node").alias("b"), F.col("doc_id").alias("db"))
    across = edges.join(x, "a").join(y, "b").select("da", "db", "jaccard")
    twin = member.where("members > 1").select(F.col("node").alias("a"), F.col("doc_id").alias("da"))
    same = twin.join(twin.select("a", F.col("da").alias("db")), "a").where("da < db").select("da", "db", F.lit(1.0).alias("jaccard"))
    found = across.union(same)
    if extra is not None:
        of = extra.select("id", F.col("doc_id").alias("of"))
        for side in ("da", "db"):
            found = found.join(of.withColumnRenamed("id", side), side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
        found = found.where("da <> db")
    found = found.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), "jaccard")
    return found if extra is None else found.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def similarity_classes(docs: DataFrame, t: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """(doc_id, class_id, links), a row for each doc_id: its connected component of similar_pairs, and how many of these pairs it is in.

    class_id is the lowest doc_id of the component. Documents without pairs, those with a null, empty or wordless text
    among them, are classes of their own with no links; rows with a null doc_id have none. Pairs are counted, not made,
    unless some doc_id has several texts, which two doc_ids may share more than one pair of.
    """
    named, extra = each_text(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    if extra is None:
        member, edges = nodes_and_edges(named, t, n, True)
        member, edges = cut(member), cut(edges)
        release(docs.sparkSession)
        across = edges.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        links = member.join(across, "node", "left").select("doc_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
        linked = edges.select("a", "b").union(member.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    else:
        linked = cut(similar_pairs(docs, t, n).select("a", "b"))
        links = linked.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
    groups = components(linked).select(F.col("id").alias("doc_id"), "root")
    of = ids.join(links, "doc_id", "left").join(groups, "doc_id", "left")
    return of.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def each_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row for each text of each doc_id, and (doc_id, v, id) of the second and later ones.

    Those have an id that no document has in place of doc_id; v is their number, see substring.variants.
    Without any the second result is None. Only doc_ids that are repeated are moved.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    of = variants(rows)
    twice = of.where("v = 0").select("doc_id")
    once = keep_ids(rows, twice, "left_anti")
    several = numbered(keep_ids(rows, twice), of).groupBy("doc_id", "v").agg(F.min("text").alias("text"))
    extra = cut(of.where("v > 0").select("doc_id", "v", F.monotonically_increasing_id().alias("id")))
    if extra.isEmpty():
        return once.union(several.select("doc_id", "text")), None
    extra = cut(extra.withColumn("id", F.col("id") + free_ids(rows, extra.agg(F.max("id")).first()[0] + 1)))
    several = several.join(extra, ["doc_id", "v"], "left").select(F.coalesce("id", "doc_id").alias("doc_id"), "text")
    return once.union(several), extra


def free_ids(rows: DataFrame, n: int) -> int:
    """The first of n successive numbers that are no doc_id."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if high + n < 1 << 63:
        return high + 1
    at = low - n
    while at < -(1 << 63) or rows.where(F.col("doc_id").between(at, at + n - 1)).limit(1).count():
        at = int(np.random.default_rng().integers(-(1 << 63), (1 << 63) - n))
    return at


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the lowest id of each connected component of edges(a, b); alternating large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    known = None
    while (now := e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != known:
        known = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def without_near_copies(docs: DataFrame, t: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """docs, with all its columns, with one document of each group of similar ones: its lowest doc_id.

    A group is a connected component of similar_pairs; of a doc_id with several texts each is a document
    of its own. Rows that have no pair stay, those with a null doc_id, null, empty or wordless text among
    them; so do repeated rows of a document that stays.
    """
    named, extra = each_text(docs)
    member, edges = nodes_and_edges(named, t, n, True)
    member = cut(member)
    groups = components(edges.select("a", "b").union(member.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    if extra is None:
        return keep_ids(docs, cut(groups.select(F.col("id").alias("doc_id"))), "left_anti")
    groups = cut(groups)
    every = groups.union(groups.select("root", "root").distinct()).join(extra, "id", "left")
    text = F.struct(F.coalesce("doc_id", "id").alias("doc_id"), F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("text")
    every = cut(every.select("root", text))
    gone = every.join(every.groupBy("root").agg(F.min("text").alias("stays")), "root").where("text <> stays")
    # v counts non-null texts only, as in each_text; a null text is never in a group.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.where("doc_id is not null and text is not null")
    kept = keep_ids(numbered(named, variants(named.select("doc_id", "text"))), cut(gone.select("text.doc_id", "text.v")), "left_anti")
    return rows.where("doc_id is null or text is null").select("row.*").union(kept.select("row.*"))
