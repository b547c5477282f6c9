"""Token counts by a public byte-level BPE, in Arrow functions that return lengths only."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, small_batches

#: Public vocabulary (tiktoken ranks); a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are encoded in one call, and bytes from which a text is split.
CALL_BYTES, PIECE_BYTES = 1 << 20, 1 << 16
#: No token spans these: a space between two visible characters begins a new word, and letters and digits end where others follow.
SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")


def encoding(path: str):
    return once(f"ranks {path}", lambda: load(path))


def load(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_BYTES) -> list[str]:
    """The text in pieces of at most `size` bytes, cut only where no token can span the cut; longer ones only where there is no such place."""
    pieces, waiting = [], [text]
    while waiting:
        part = waiting.pop()
        if len(part) * 4 <= size or len(part.encode()) <= size:
            pieces.append(part)
            continue
        middle = len(part) // 2
        cut = SAFE.search(part, middle)
        at = cut.start() if cut and cut.start() < len(part) else 0
        if not at:  # the last place before the middle
            for found in SAFE.finditer(part, 1, middle):
                at = found.start()
        if at:
            waiting += [part[at:], part[:at]]
        else:
            pieces.append(part)
    return pieces


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> np.ndarray:
    """Number of tokens of each text; null counts 0. Pieces are sorted by their bytes into balanced calls."""
    own = encoding(path)
    pieces = [(piece, k, len(piece.encode())) for k, text in enumerate(texts) if text for piece in safe_pieces(text)]
    pieces.sort(key=lambda x: x[2])
    total, call, held = np.zeros(len(texts), np.int64), [], 0

    def run():
        for (_, k, _), ids in zip(call, own.encode_ordinary_batch([piece for piece, *_ in call], num_threads=1)):
            total[k] += len(ids)

    for piece in pieces:
        call.append(piece)
        held += piece[2]
        if held >= CALL_BYTES:
            run()
            call, held = [], 0
    run()
    return total


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs.

    A null text has a null count, an empty one 0; a null doc_id and repeated rows stay as they are.
    Special tokens' strings count as ordinary text. Long texts are counted whole, piece by piece.
    Columns other than doc_id and text aren't read.
    """

    def lengths(text: pa.Array) -> pa.Array:
        n = count_tokens(text.to_pylist(), path)
        return pa.array(n, mask=text.is_null().to_numpy(zero_copy_only=False))

    return small_batches(docs).select("doc_id", F.arrow_udf(lengths, "bigint")("text").alias("n_tokens"))
