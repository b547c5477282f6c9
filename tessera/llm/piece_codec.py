"""SentencePiece BPE encoding by vectorised merge rounds, and decoding by one gather.

All texts of a slice become one flat symbol array, cut into words across which no piece reaches;
each distinct word is encoded once. A round finds the best pair of every word (a segmented minimum),
merges its occurrences from the left, and compacts the array; words without a pair leave. In a long word
every pair that is the best within a piece's reach is merged, as nothing farther off can touch it before its turn.
It gives what the public library gives, byte fallback included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import K1, U, flat, hash_runs, once, small_batches, text_slices

#: Public model; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
NO_PAIR = np.iinfo(np.int64).max
POINTS = 0x110000
SLICE = 2 << 20
SLOT_BITS = 21


class Pieces:
    """The model's tables. Symbols: the mergeable pieces and the single characters they hold; past them, a character outside the model is count + code point."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.byte_id = np.zeros(256, np.int64)
        raw: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                raw.append(bytes([int(name[3:5], 16)]))
            else:
                raw.append(b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else name.replace("▁", " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

        pieces = {name: i for i, name in enumerate(names) if not special[i]}
        score = {name: model.get_score(i) for name, i in pieces.items()}
        assert not any(a != "▁" and b == "▁" for name in pieces for a, b in zip(name, name[1:])), "a piece reaches over a space"
        symbols = [*pieces, *sorted({c for name in pieces for c in name} - pieces.keys())]
        number = {s: k for k, s in enumerate(symbols)}
        self.count = len(symbols)
        self.id_of = np.array([pieces.get(s, -1) for s in symbols])
        self.char = np.arange(POINTS, dtype=np.int64) + self.count
        for s, k in number.items():
            if len(s) == 1:
                self.char[ord(s)] = k

        rank = {v: k for k, v in enumerate(sorted(set(score.values()), reverse=True))}
        tally: dict[float, int] = {}
        for v in score.values():
            tally[v] = tally.get(v, 0) + 1
        shared = {v for v, n in tally.items() if n > 1}
        pairs, unsafe = [], set()
        for name in pieces:
            for cut in range(1, len(name)):
                a, b = name[:cut], name[cut:]
                if a in number and b in number:
                    pairs.append((number[a], number[b], rank[score[name]], number[name]))
                    unsafe |= {x for x in (a, b) if x in score and score[name] >= score[x]}
        #: Pieces after whose making a better pair may come up: their pair is merged once a round.
        self.unsafe = np.array([s in unsafe or score.get(s) in shared for s in symbols])
        keys = np.array([a * (self.count + POINTS) + b for a, b, _, _ in pairs])
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.array([p[2] for p in pairs])[order], np.array([p[3] for p in pairs])[order]
        self.bucket = np.searchsorted(slot[order], np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)

        #: Symbols on either side of a pair that may come to touch it before it is merged.
        self.reach = max(map(len, pieces)) + 1
        chars = sorted({c for name in pieces for c in name})
        self.letter = np.zeros(POINTS, np.int64)  # 0: in no piece
        for k, c in enumerate(chars):
            self.letter[ord(c)] = k + 1
        self.letters = len(chars) + 1
        self.joined = np.zeros(self.letters * self.letters, bool)  # neighbours inside some piece
        for name in pieces:
            for a, b in zip(name, name[1:]):
                self.joined[self.letter[ord(a)] * self.letters + self.letter[ord(b)]] = True

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * U(K1)) >> U(64 - SLOT_BITS)).view(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece made) of each pair; NO_PAIR where none is made."""
        key = a * (self.count + POINTS) + b
        slot = self.slot(key)
        at, end = self.bucket[slot], self.bucket[slot + 1]
        rank, made = np.full(len(key), NO_PAIR), np.zeros(len(key), np.int64)
        left = np.flatnonzero(at < end)
        at, end, key = at[left], end[left], key[left]
        while len(left):
            same = self.keys[at] == key
            rank[left[same]], made[left[same]] = self.rank[at[same]], self.made[at[same]]
            more = ~same & (at + 1 < end)
            left, at, end, key = left[more], at[more] + 1, end[more], key[more]
        return rank, made


def model(path: str) -> Pieces:
    return once(f"pieces {path}", lambda: Pieces(path))


def before(rank: np.ndarray, reach: int) -> np.ndarray:
    """Least of rank[i - reach : i] for each i."""
    have, out = 1, np.concatenate((np.full(reach, NO_PAIR), rank[:-1]))
    while 2 * have <= reach:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(rank)], out[reach - have :][: len(rank)])


def merge_rounds(m: Pieces, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each word) after all merges. start: where each word begins; none is empty.

    A pair's best rank within m.reach symbols on either side is the best of its whole word as far as it is
    concerned: to meet it, what is merged farther off would have to grow to more characters than any piece has.
    """
    n, symbols = len(start), symbols.copy()
    word = np.repeat(np.arange(n), np.diff(np.append(start, len(symbols))))
    done_word, done_symbol = [], []
    rank, made = np.full(len(symbols), NO_PAIR), np.zeros(len(symbols), np.int64)
    fresh = np.arange(len(symbols) - 1)  # where pairs have changed
    while len(symbols):
        fresh = fresh[word[fresh] == word[fresh + 1]]
        rank[fresh], made[fresh] = m.pair(symbols[fresh], symbols[fresh + 1])
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(first, len(symbols)))
        best = np.repeat(np.minimum.reduceat(rank, first), sizes)
        over = best == NO_PAIR
        wide = np.flatnonzero(np.repeat(sizes > 2 * m.reach, sizes))
        if len(wide):
            left, right = before(rank[wide], m.reach), before(rank[wide][::-1], m.reach)[::-1]
            best[wide] = np.minimum(np.minimum(left, right), rank[wide])
        done_word.append(word[over])
        done_symbol.append(symbols[over])
        at = np.flatnonzero((rank == best) & (rank != NO_PAIR))
        if not len(at):
            break
        # Of hits that overlap (aaa) every other one, from the left; none if what is left of them is as good and waits.
        head = np.append(True, np.diff(at) > 1)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        opening = at[lead]
        take = ((np.arange(len(at)) - lead) % 2 == 0) & ((opening == 0) | (rank[opening - 1] != rank[opening]))
        # Of an unsafe piece's, the first in the word or within reach.
        leads = np.append(True, word[at][1:] != word[at][:-1])
        if len(wide):
            place = np.searchsorted(wide, at)
            place[place == len(wide)] = 0
            leads = np.where(wide[place] == at, left[place] > rank[at], leads)
        take &= leads | ~m.unsafe[made[at]]
        at = at[take]
        symbols[at] = made[at]
        rank[at] = NO_PAIR
        stay = ~over
        stay[at + 1] = False
        place = (np.cumsum(stay) - 1)[at]
        keep = np.flatnonzero(stay)
        symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
        left_of = place[place > 0] - 1
        rank[left_of] = NO_PAIR
        fresh = np.concatenate((left_of, place[place < len(symbols) - 1]))
    word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.searchsorted(word[order], np.arange(n))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., start[1], ...: size[k] numbers from each start[k]."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def encode(text: pa.Array, path: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of all texts, and where each text's begin."""
    m = model(path)
    data, offsets = flat(text)
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
    begin = lead[offsets]
    filled = np.flatnonzero(np.diff(begin) > 0)
    points = np.where(points == 32, SPACE, points)
    points = np.insert(points, begin[filled], SPACE)  # the dummy prefix
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    text_start = begin[filled] + np.arange(len(filled))
    cut = np.ones(len(points), bool)
    letter = m.letter[points]
    cut[1:] = ~m.joined[letter[:-1] * m.letters + letter[1:]] | ((points[1:] == SPACE) & (points[:-1] != SPACE))
    cut[text_start] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(points)))
    narrow = points.astype(np.uint32)
    h = hash_runs(narrow.view(np.uint8), start * 4, (start + size) * 4)
    _, pick, which = np.unique(h, return_index=True, return_inverse=True)
    symbols = m.char[points[spread(start[pick], size[pick])]]
    own = np.cumsum(size[pick]) - size[pick]
    symbols, own = merge_rounds(m, symbols, own)
    # Symbols to ids; a character outside the model becomes its bytes.
    ids, many = np.where(symbols < m.count, m.id_of[np.minimum(symbols, m.count - 1)], -1), np.ones(len(symbols), np.int64)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        name = np.unique(symbols[odd])
        singles = {int(m.char[p]): p for p in np.unique(points).tolist()}
        coded = {int(s): m.byte_id[list(chr(singles[int(s)]).encode())] for s in name}
        many[odd] = [len(coded[s]) for s in symbols[odd].tolist()]
        at = np.cumsum(many) - many
        wide = np.zeros(many.sum(), np.int64)
        wide[at[ids >= 0]] = ids[ids >= 0]
        for k in odd.tolist():
            wide[at[k] : at[k] + many[k]] = coded[int(symbols[k])]
        own, ids = np.append(at, len(wide))[np.minimum(own, len(at))], wide
    length = np.diff(np.append(own, len(ids)))
    out = ids[spread(own[which], length[which])]
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(length[which])))
    per_text = np.zeros(n, np.int64)
    per_text[filled] = np.diff(total[np.append(np.searchsorted(start, text_start), len(start))])
    return out, np.concatenate((np.zeros(1, np.int64), np.cumsum(per_text)))


def decode(ids: np.ndarray, offsets: np.ndarray, path: str = MODEL) -> pa.Array:
    """The texts of ids; bytes that aren't UTF-8 become the replacement character."""
    m = model(path)
    size = m.raw_size[ids]
    raw = m.raw[spread(m.raw_start[ids], size)]
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[offsets]
    first = np.flatnonzero(np.diff(total) > 0)
    first = first[raw[total[first]] == 32]  # the dummy prefix
    stay = np.ones(len(raw), bool)
    stay[total[first]] = False
    raw = raw[stay]
    shorter = np.zeros(len(offsets), np.int64)
    shorter[first + 1] = 1
    total = total - np.cumsum(shorter)
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
    try:
        out.validate(full=True)
        return out
    except pa.ArrowInvalid:
        return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(total[:-1], total[1:])], pa.large_string())


ENCODED = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each row of docs; decoding the ids gives the text again.

    round_trip tells whether it does; U+2581 stands for a space in the model and comes back as one.
    A null text has null in all three; an empty one has no ids. Null doc_ids and repeated rows
    stay as they are. Texts are encoded whole. Columns other than doc_id and text aren't read.
    """

    def run(batches):
        for batch in text_slices(batches, most=SLICE):
            text = batch.column("text")
            ids, offsets = encode(text, path)
            back = decode(ids, offsets, path)
            plain = pc.replace_substring(pc.fill_null(text, ""), "▁", " ").cast(pa.large_string())
            null = text.is_null()
            hide = null.to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(offsets), mask=hide), pc.if_else(null, None, pc.equal(plain, back))], ["doc_id", "ids", "n_tokens", "round_trip"])

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ENCODED)


def decoded(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat_ids = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            length = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            text = decode(flat_ids, np.concatenate(([0], np.cumsum(length))), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.if_else(ids.is_null(), None, text.cast(pa.string()))], ["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")
