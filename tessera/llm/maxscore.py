"""Exact top-k search by MaxScore over document shards.

A task turns its documents into postings of the queries' terms, shard by shard. For each query the terms
are ordered by their highest score in the shard; those whose scores together stay below the k-th
best score so far are non-essential. Only essential postings are traversed; the others are probed for
documents that can still compete. A task's best k go on to its next shard as threshold, and all
tasks' best k are merged. Scores are BM25 impacts in whole thousandths, so their sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, text_slices, words

K, K1, B = 10, 1.2, 0.75
#: Words after which a task searches what it has read; queries that are searched in one pass.
SHARD_WORDS, BLOCK = 4_000_000, 4096


def postings(column: pa.Array, vocabulary: np.ndarray):
    """(document, term, frequency) of the vocabulary's words, and the length of each document."""
    doc, h, _ = words(column)
    length = np.bincount(doc, minlength=len(column)) if len(doc) else np.zeros(len(column), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = vocabulary[at] == h
    pair, tf = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), tf, length


def impacts(tf: np.ndarray, idf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return np.floor(1000.0 * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / average))).astype(np.int64)


class Shard:
    """Postings by term, with each term's highest impact."""

    def __init__(self, ids, doc, term, impact, terms: int):
        order = np.lexsort((doc, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(terms + 1))
        self.most = np.zeros(terms, np.int64)
        there = np.flatnonzero(np.diff(self.at))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.impact, self.at[there])

    def search(self, query: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """best (scores, ids), together with this shard's documents: the k best again."""
        scores, ids = best
        floor = int(scores[-1]) if len(scores) == k else 1
        query = query[self.most[query] > 0]
        query = query[np.argsort(self.most[query], kind="stable")]
        reach = np.cumsum(self.most[query])
        minor = int(np.searchsorted(reach, floor))  # the non-essential terms: together below the floor
        if minor == len(query):
            return best
        total, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for t in query[minor:]:
            a, b = self.at[t], self.at[t + 1]
            total[self.doc[a:b]] += self.impact[a:b]
            seen[self.doc[a:b]] = True
        here = np.flatnonzero(seen)
        value = total[here]
        for j in range(minor - 1, -1, -1):
            if len(value) >= k:
                floor = max(floor, int(np.partition(value, len(value) - k)[len(value) - k]))
            near = value + reach[j] >= floor
            here, value = here[near], value[near]
            a, b = self.at[query[j]], self.at[query[j] + 1]
            place = np.minimum(np.searchsorted(self.doc[a:b], here), b - a - 1)
            value = value + np.where(self.doc[a:b][place] == here, self.impact[a:b][place], 0)
        near = value >= floor
        scores, ids = np.concatenate((scores, value[near])), np.concatenate((ids, self.ids[here[near]]))
        top = np.lexsort((ids, -scores))[:k]
        return scores[top], ids[top]


def statistics(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(documents, words, document frequency of each term) over all documents."""

    def count(batches):
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in text_slices(batches):
            _, term, _, length = postings(batch.column("text"), vocabulary)
            df += np.bincount(term, minlength=len(vocabulary))
            n, total = n + batch.num_rows, total + int(length.sum())
        there = np.flatnonzero(df)
        term = np.concatenate((there, [-1, -2]))
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate((df[there], [n, total])))], ["term", "n"])

    found = {r.term: r.n for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(t, 0) for t in range(len(vocabulary))])


def search_block(docs: DataFrame, texts: list[str | None], first: int, k: int) -> DataFrame:
    """(q, doc_id, score): each task's k best documents of each query; q counts queries from `first`."""
    doc, h, _ = words(pa.array(texts, pa.string()))
    vocabulary, term = np.unique(h, return_inverse=True)
    queries = [np.unique(term[a:b]) for a, b in zip(np.searchsorted(doc, np.arange(len(texts))), np.searchsorted(doc, np.arange(1, len(texts) + 1)))]
    if not len(vocabulary):
        return docs.sparkSession.createDataFrame([], "q long, doc_id long, score long")
    n, total, df = statistics(docs, vocabulary)
    idf, average = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(n, 1)

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        held, read = [], 0

        def flush():
            sizes = np.cumsum([0] + [len(x[0]) for x in held])
            ids = np.concatenate([x[0] for x in held])
            d, t, tf, length = (np.concatenate(x) for x in zip(*((doc + at, term, tf, length) for (_, doc, term, tf, length), at in zip(held, sizes))))
            shard = Shard(ids, d, t, impacts(tf, idf[t], length[d], average), len(vocabulary))
            for q, terms in enumerate(queries):
                best[q] = shard.search(terms, best[q], k)

        for batch in text_slices(batches):
            found = postings(batch.column("text"), vocabulary)
            held.append((batch.column("doc_id").to_numpy(), *found))
            read += int(found[3].sum())
            if read >= SHARD_WORDS:
                flush()
                held, read = [], 0
        if held:
            flush()
        q = np.repeat(np.arange(len(queries)), [len(s) for s, _ in best]) + first
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], ["q", "doc_id", "score"])

    return docs.mapInArrow(run, "q long, doc_id long, score long")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of queries(item_id, text).

    score is the sum, over a query's distinct words, of the floor of 1000 x BM25 impact; ties go to the lower
    doc_id, and only documents that share a word are ranked. Words are runs of letters and digits in
    lower case. Documents with a null doc_id or text aren't searched or counted; an empty one counts
    and is never found. A query with a null, empty or wordless text has no rows. Repeated documents are
    ranked each; repeated queries and those with a null item_id are answered each. Texts are read
    whole; other columns aren't read. Queries come to the driver in blocks of 4096, a pass each.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    numbered = cut(queries.select("item_id", "text").withColumn("q", F.monotonically_increasing_id()))
    parts, after = [], -1
    while True:
        block = numbered.where(F.col("q") > after).orderBy("q").limit(BLOCK).collect()
        if block or not parts:
            found = search_block(docs, [r.text for r in block], 0, k)
            names = numbered.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"q long, item_id {queries.schema['item_id'].dataType.simpleString()}")
            rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
            top = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
            parts.append(top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
        if len(block) < BLOCK:
            break
        after = block[-1].q
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
