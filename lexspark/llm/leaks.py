"""Passages of held-out items in training text (problem 4).

The held-out items are a stated query set. Their distinct passages are written in blocks of a bounded
number of words to the shared folder. A task reads its texts once; it builds one Aho-Corasick
automaton over the normalised passages of a block at a time, usually the only one, and holds its
texts against it. A word of the passages is a number of a few digits, each place with an alphabet of
its own, so that nodes have few children and matches begin and end with words; any other word is
blank. The automaton holds the aligned pieces of half the least length: every run of the least
length holds one. Where a piece matches, the runs of the least length around it are looked up, and
those that a passage has are extended both ways, exactly. Matches are mapped back to character
offsets.
"""

from __future__ import annotations

import functools
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import words as W
from lexspark.session import part_of, stored, written

LEAST_WORDS = 8
BLOCK_WORDS = 1_000_000
BUFFER_CHARS = 1 << 26  # texts a task holds while it goes through several blocks
BASE = 32
SALTS = 16


class Codes(dict):
    """Symbols of words, so many digits each; all words that have none share a blank that no passage has."""

    def __init__(self, words: set[str]):
        self.digits = 1
        while BASE**self.digits < len(words):
            self.digits += 1
        super().__init__((w, "".join(chr(0x100 + BASE * k + n // BASE**k % BASE) for k in reversed(range(self.digits)))) for n, w in enumerate(words))
        self.blank = " " * self.digits

    def __missing__(self, word: str) -> str:
        return self.blank


class Passages:
    """The automaton over the aligned pieces of some passages, and where their runs of the least
    length are."""

    def __init__(self, passages: list[tuple[int, str]], least: int):
        codes = Codes({w for _, text in passages for w in text.split(" ")})
        self.code, d = codes.__getitem__, codes.digits
        self.digits, self.least, self.piece = d, d * least, d * max(1, least // 2)
        self.keys = [key for key, _ in passages]
        self.symbols = ["".join(map(self.code, text.split(" "))) for _, text in passages]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        runs = []
        for p, own in enumerate(self.symbols):
            for i in range(0, len(own) - self.piece + 1, self.piece):
                self.automaton.add_word(own[i : i + self.piece])
            runs += [(hash(own[i : i + self.least]), p, i) for i in range(0, len(own) - self.least + 1, d)]
        runs.sort()
        self.hashes, self.passage, self.place = array("q", (r[0] for r in runs)), array("q", (r[1] for r in runs)), array("q", (r[2] for r in runs))
        if self.symbols:
            self.automaton.make_automaton()

    def runs(self, text: str | None) -> list[tuple[int, int, int]]:
        """(passage, start, end) of each longest run in the text, in characters of the text."""
        if not text or not len(self.automaton):
            return []
        folded, d = W.fold(text), self.digits
        line = "".join(map(self.code, W.WORD.findall(folded)))
        tried, upto = -d, {}  # the last run begin looked up; how far a passage at its shift is known
        done: list[tuple[int, int, int]] = []
        for last, _ in self.automaton.iter(line):
            first = last + 1 - self.piece
            for a in range(max(first + self.piece - self.least, tried + d, 0), min(first, len(line) - self.least) + 1, d):
                tried, run = a, line[a : a + self.least]
                h = hash(run)
                for k in range(bisect_left(self.hashes, h), bisect_right(self.hashes, h)):
                    p, i = self.passage[k], self.place[k]
                    own, begin, j, b = self.symbols[p], a, i + self.least, a + self.least
                    if upto.get((p, a - i), -1) >= b or own[i:j] != run:
                        continue
                    while i and begin and own[i - d : i] == line[begin - d : begin]:
                        i, begin = i - d, begin - d
                    while j < len(own) and b < len(line) and own[j : j + d] == line[b : b + d]:
                        j, b = j + d, b + d
                    upto[p, begin - i] = b
                    done.append((self.keys[p], begin, b))
        if not done:
            return []
        spans = [m.span() for m in W.WORD.finditer(folded)]
        return [(key, spans[a // d][0], spans[b // d - 1][1]) for key, a, b in sorted(done)]


@functools.lru_cache(maxsize=1)
def _passages(path: str, block: int, least: int) -> Passages:
    part = part_of(path, "block", block)
    return Passages(list(zip(part["passage"].to_pylist(), part["normalised"].to_pylist())) if part else [], least)


def passage_table(items: DataFrame, item_col: str, text_cols: list[str], least: int) -> DataFrame:
    """(item_id, passage, normalised): the word runs of each item's texts, texts with the same
    words sharing a passage number. Texts of fewer words have none."""
    texts = items.select(F.col(item_col).alias("item_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(text_cols)])).alias("x"))
    runs = texts.select("item_id", "x.i", W.words(F.col("x.t")).alias("w")).where(F.size("w") >= least).withColumn("normalised", F.array_join("w", " "))
    numbered = runs.groupBy("normalised").agg(F.min(F.col("item_id") * len(text_cols) + F.col("i")).alias("passage"))
    return runs.select("item_id", "normalised").distinct().join(numbered, "normalised")


def held_together(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.Table]:
    """The batches in tables of about so many characters of their third column."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(2).nbytes
        if n >= chars:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def leaks(texts: DataFrame, items: DataFrame, item_col: str, text_cols: list[str], least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(src, text_id, item_id, start, end): every run of at least so many consecutive words of an
    item's text that stands consecutively in texts(src, text_id, text), as character offsets of the
    stored text. Runs of one passage may lie over one another where it repeats words. Null, empty and
    shorter texts have none; an item whose texts share a run, or equal items, give a row each; item_col
    must be an integer that is unique."""
    table = stored(passage_table(items, item_col, text_cols, least))
    passages = table.select("passage", "normalised").distinct()
    words = passages.agg(F.sum(F.size(F.split("normalised", " ")))).collect()[0][0] or 0
    blocks = -(-words // block_words) or 1
    path = written(passages.withColumn("block", F.pmod(F.xxhash64("passage"), F.lit(blocks)).cast("int")).repartition(blocks, "block"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with one block nothing has to be held
        for part in batches if blocks == 1 else held_together(batches, BUFFER_CHARS):
            for block in range(blocks):
                own = _passages(path, block, least)
                rows = [(i, *r) for i, t in enumerate(part.column(2).to_pylist()) for r in own.runs(t)]
                at, keys, start, end = zip(*rows) if rows else ((), (), (), ())
                found = part.select(["src", "text_id"]).take(pa.array(at, pa.int64()))
                columns = [pa.array(found.column(k).to_pylist(), part.schema.types[k]) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["src", "text_id", "passage", "start", "end"])

    hits = texts.select("src", "text_id", "text").mapInArrow(run, "src string, text_id bigint, passage bigint, start int, `end` int")
    # many texts may hold one passage, which many items may have: the items, the smaller side, are repeated
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("src", "text_id", "start"), F.lit(SALTS)).cast("int"))
    owners = table.select("item_id", "passage", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(owners, ["passage", "salt"]).select("src", "text_id", "item_id", "start", "end")
