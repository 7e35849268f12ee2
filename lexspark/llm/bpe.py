"""Encoding of a corpus with the vocabulary of a public byte-level BPE tokenizer (problem 8).

A text is split by the vocabulary's own pattern; each piece is merged with a priority queue of
merge ranks over a doubly linked list of symbols, entries whose symbols have changed meanwhile
being skipped. Pieces repeat, so each Python worker remembers those it has merged.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the pattern that comes with the vocabulary; it splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

REMEMBER_PIECES = 1 << 19
REMEMBER_LENGTH = 48


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary's strings: printable bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ByteBPE(dict):
    """Maps a piece of text to its ids as packed int32, merging it when it is first asked for."""

    def __init__(self, path: str = TOKENIZER):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.byte_ids = [vocab[c] for c in alphabet]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        of_char = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(of_char[c] for c in s) for s, i in vocab.items()}
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.merge(piece.encode("utf-8")), dtype=np.int32).tobytes()
        if len(piece) <= REMEMBER_LENGTH:
            if len(self) >= REMEMBER_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Equal ranks merge from the left."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            found = self.merges.get((ids[i], ids[j])) if j >= 0 else None
            if found:
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: a neighbour was merged since
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return out

    def pack(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.pack(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """The tokenizer of this process; it is read once."""
    return ByteBPE(path)


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id_col, ids) for every row. A null and an empty text give an empty list, text that spells
    a special token is ordinary text, repeated ids give a row each, other columns are ignored."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            packed = [bpe.pack(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id_col, n_tokens) for every row; 0 for a null or empty text."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            n = pa.array([len(bpe.pack(t)) // 4 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], [id_col, "n_tokens"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def decoded(ids: Column, path: str = TOKENIZER) -> Column:
    """The text of a list of ids, for round trips; null for null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        return pa.array([None if x is None else bpe.decode(x) for x in column.to_pylist()], pa.string())

    return run(ids)
