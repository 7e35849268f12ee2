"""Evaluation questions that the training split asks as well (problem 2).

Questions are sets of words. Minwise hashes of a set are banded into buckets; only buckets that
hold a question of an evaluation split and one of the training split give candidates, which are
verified by their exact Jaccard similarity. A question with gold documents is compared with
training questions from those documents, so the document is part of the bucket; one without is
compared with all. Training questions of which no bucket holds an evaluation question are dropped
where they are read, by a filter of the evaluation buckets. What is compared are distinct sets;
rows come back in only as members of their sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm import words as W
from lexspark.operators.ranking import join_groups
from lexspark.session import stored

SIMILARITY = 0.7
BANDS, ROWS, SEED = 64, 5, 5  # a pair at 0.7 is missed once in 130,000 times
PROBES, BITS_PER_KEY = 4, 32  # of other buckets one in five thousand passes the filter
FILTER_BITS = 1 << 27  # 16 MB; evaluation splits of more buckets are compared in blocks
ANYWHERE = 0x5851F42D4C957F2D  # in place of a document's hash


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    top = np.iinfo(np.int64).max
    return rng.integers(1, top, BANDS * ROWS).astype(np.uint64) | np.uint64(1), rng.integers(0, top, BANDS * ROWS).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def bands(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """For each band the hash of its minima over each list of word hashes, none of them empty."""
    a, b = coefficients()
    values = lists.flatten().to_numpy().astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())[:-1]])
    for band in range(BANDS):
        key = np.full(len(lists), band, dtype=np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = mixed(key ^ np.minimum.reduceat(values * a[k] + b[k], starts))
        yield key


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def bucket_keys(sets: DataFrame) -> DataFrame:
    """(id, key) with a row per band of sets(id, scope, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scope = batch.column(1).to_numpy().astype(np.uint64)
                for key in bands(batch.column(2)):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mixed(key ^ scope).astype(np.int64))], ["id", "key"])

    return sets.select("id", "scope", "hashes").mapInArrow(run, "id bigint, key bigint")


def probe(key: Column, i: int, bits: int) -> Column:
    step = F.shiftrightunsigned(key, 32).bitwiseOR(1).bitwiseAND(bits - 1)
    return (key.bitwiseAND(bits - 1) + i * step).bitwiseAND(bits - 1)


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the keys."""
    at = keys.select(F.explode(F.array(*[probe(F.col("key"), i, bits) for i in range(PROBES)])).alias("at"))
    place = F.col("at") + 1
    parts = at.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[(row["part"] - 1) * 4096 :][:4096] = np.frombuffer(row["bitmap"], np.uint8)[: bits // 8]
    return out


def passing(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the filter holds all probes of the keys."""
    mask = np.int64(8 * len(bitmap) - 1)
    at, step = keys & mask, ((keys.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1) & mask
    found = np.arange(len(keys))
    for i in range(PROBES):
        spot = (at[found] + i * step[found]) & mask
        found = found[(bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
    return found


def survivors(trained: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(train_id, text, keys) of trained(train_id, text, scope, hashes) with the keys that pass the
    filter, within the row's document and anywhere; rows without any are gone."""
    shared = trained.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scope = batch.column(2).fill_null(ANYWHERE).to_numpy().astype(np.uint64)
            rows, keys = [], []
            for key in bands(batch.column(3)):
                for own in (mixed(key ^ scope).astype(np.int64), mixed(key ^ np.uint64(ANYWHERE)).astype(np.int64)):
                    at = passing(shared.value, own)
                    rows.append(at)
                    keys.append(own[at])
            row, key = np.concatenate(rows), np.concatenate(keys)
            order = np.argsort(row, kind="stable")
            kept, counts = np.unique(row, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(key[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), lists], ["train_id", "text", "keys"])

    kind = trained.schema["train_id"].dataType.simpleString()
    return trained.select("train_id", "text", "scope", "hashes").mapInArrow(run, f"train_id {kind}, text string, keys array<bigint>")


def set_text(doc: Column, words: Column) -> Column:
    """A document and a set of words as one text, which no other pair of them has."""
    return F.concat(F.coalesce(F.concat(F.lit("="), doc), F.lit("")), F.lit("\x1f"), F.array_join(words, " "))


def text_words(text: Column) -> Column:
    return F.split(F.substring_index(text, "\x1f", -1), " ")


def text_doc(name: str) -> Column:
    """The document of a set with its mark, empty for none."""
    return F.expr(f"left({name}, length({name}) - length(substring_index({name}, '\x1f', -1)) - 1)")


def word_sets(rows: DataFrame) -> DataFrame:
    """The rows with words, the sorted distinct words of their question; null and wordless
    questions have no row."""
    return rows.withColumn("words", F.array_sort(F.array_distinct(W.words(F.col("question"))))).where(F.size("words") > 0).drop("question")


@dataclass
class Overlaps:
    """links(e_text, t_text): the distinct sets of evaluation and training that are alike, with
    e_size and t_size, how many rows each has; evaluated(split, eval_id, e_text) and
    trained(train_id, t_text): the rows of the sets that have any."""

    links: DataFrame
    evaluated: DataFrame
    trained: DataFrame

    def pairs(self) -> DataFrame:
        """(split, eval_id, train_id): every row of a set with every row of one like it."""
        sides = join_groups(self.evaluated, self.links, ["e_text"], "e_size")
        rows = join_groups(self.trained, sides.select("split", "eval_id", "t_text", "t_size"), ["t_text"], "t_size")
        return rows.select("split", "eval_id", "train_id")

    def report(self, trained: DataFrame, by: list[str]) -> DataFrame:
        """(split, by, pairs, questions, training_rows) for trained(train_id, by): counted over sets, no
        pair of rows is made."""
        split_sizes = self.evaluated.groupBy("split", "e_text").agg(F.count("*").alias("e"))
        rows = self.trained.join(trained.select("train_id", *by), "train_id")
        by_sizes = rows.groupBy(*by, "t_text").agg(F.count("*").alias("t"))
        linked = self.links.select("e_text", "t_text").join(split_sizes, "e_text").join(by_sizes, "t_text")
        pairs = linked.groupBy("split", *by).agg(F.sum(F.col("e") * F.col("t")).alias("pairs"))
        asked = linked.select("split", "e_text", *by).distinct().join(self.evaluated.select("split", "e_text", "eval_id"), ["split", "e_text"])
        questions = asked.groupBy("split", *by).agg(F.count_distinct("eval_id").alias("questions"))
        met = linked.select("split", "t_text", *by).distinct().join(by_sizes, [*by, "t_text"])
        training = met.groupBy("split", *by).agg(F.sum("t").alias("training_rows"))
        return pairs.join(questions, ["split", *by]).join(training, ["split", *by])


def overlapping(evaluated: DataFrame, trained: DataFrame, similarity: float = SIMILARITY, filter_bits: int = FILTER_BITS) -> Overlaps:
    """The Overlaps of evaluated(split, eval_id, question, gold_doc_ids) and trained(train_id,
    question, source_doc_id): questions that share at least so many of their distinct words and
    whose document is a gold document, where there are any; null gold counts as none. Null and
    wordless questions overlap with none."""
    docs = F.filter(F.array_distinct(F.coalesce("gold_doc_ids", F.array())), lambda d: d.isNotNull())
    unbound = F.size(F.coalesce("gold_doc_ids", F.array())) == 0
    e = word_sets(evaluated.select("split", "eval_id", "question", "gold_doc_ids"))
    own = e.select("split", "eval_id", "words", F.explode(F.when(unbound, F.array(F.lit(None).cast("string"))).otherwise(docs)).alias("doc"))
    own = stored(own.select("split", "eval_id", set_text(F.col("doc"), F.col("words")).alias("e_text")))
    words = text_words(F.col("e_text"))
    scope = F.when(text_doc("e_text") != "", F.xxhash64(text_doc("e_text"))).otherwise(F.lit(ANYWHERE))
    sets = stored(own.groupBy("e_text").agg(F.count("*").alias("e_size")).withColumns({"id": F.xxhash64("e_text"), "scope": scope, "hashes": hashes(words)}))
    keys = stored(bucket_keys(sets).withColumnRenamed("id", "e_id"))
    wanted = max(1 << 15, BITS_PER_KEY * keys.count())
    bits = min(filter_bits, 1 << (wanted - 1).bit_length())
    blocks = -(-wanted // bits)

    t = word_sets(trained.select("train_id", "question", "source_doc_id"))
    t_doc = F.when(F.col("source_doc_id").isNotNull(), F.xxhash64(F.concat(F.lit("="), F.col("source_doc_id"))))
    t = t.select("train_id", set_text(F.col("source_doc_id"), F.col("words")).alias("text"), t_doc.alias("scope"), hashes(F.col("words")).alias("hashes"))
    block = F.pmod(F.shiftrightunsigned("key", 20), F.lit(blocks))
    found = [stored(survivors(t, key_filter(keys.where(block == b), bits))).withColumn("block", F.lit(b)) for b in range(blocks)]
    met = functools.reduce(DataFrame.unionByName, found).withColumnRenamed("text", "t_text")
    # rows of a set pass in the same blocks; they are taken from the first
    kept = met if blocks == 1 else met.join(met.groupBy("t_text").agg(F.min("block").alias("block")), ["t_text", "block"])
    t_sets = met.groupBy("t_text", "keys").agg(F.count("*").alias("t_size")).withColumn("t_id", F.xxhash64("t_text"))
    buckets = t_sets.select("t_id", F.explode("keys").alias("key"))
    candidates = keys.join(buckets, "key").select("e_id", "t_id").distinct()
    named = candidates.join(sets.select(F.col("id").alias("e_id"), "e_text", "e_size"), "e_id").join(t_sets.groupBy("t_id", "t_text").agg(F.max("t_size").alias("t_size")), "t_id")
    a, b = text_words(F.col("e_text")), text_words(F.col("t_text"))
    common = F.size(F.array_intersect(a, b))
    alike = (common >= similarity * (F.size(a) + F.size(b) - common) - 1e-9) & ((text_doc("e_text") == "") | (text_doc("e_text") == text_doc("t_text")))
    links = stored(named.where(alike).select("e_text", "t_text", "e_size", "t_size"))
    return Overlaps(links, own.join(links.select("e_text").distinct(), "e_text", "left_semi"), kept.select("train_id", "t_text").join(links.select("t_text").distinct(), "t_text", "left_semi"))


def overlaps(evaluated: DataFrame, trained: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(split, eval_id, train_id) of all rows that overlapping finds alike. Repeated rows give a row
    each."""
    return overlapping(evaluated, trained, similarity).pairs()
