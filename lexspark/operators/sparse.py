"""BM25 over an inverted index held as tables.

score(q, d) = sum over query tokens, with repetition, of idf * tf (k1+1) / (tf + k1 (1 - b + b len / avg))
idf(t) = ln(N - df + 0.5) - ln(df + 0.5); below zero it is epsilon times the mean idf of all terms.
Ranks are by the score rounded to six places, then by key, so that ties do not depend on the
order of summation.

Terms are counted within each document's row, and the rows stay where they are: a task holds its
documents against the queries, block by block from the shared folder, and sends its best per query
only. So neither the matches nor the documents of a frequent term are shuffled or written anywhere.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.session import part_of, spread, stored, written

K1, B, EPSILON = 1.5, 0.75, 0.25
PLACES = 6
BLOCK_QUERIES = 1024
AT_ONCE = 1 << 20  # pairs of a document and a query that a task scores at a time


def best_rows(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k best of each column of scores, ties by the rows' order; rows at -inf never."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        row, query = np.nonzero((scores >= edge) & (scores > -np.inf))
    else:
        row, query = np.nonzero(scores > -np.inf)
    by = np.lexsort((order[row], -scores[row, query], query))
    row, query = row[by], query[by]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return row[place < k], query[place < k]


def key_order(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The place of each key in their order."""
    order = np.empty(len(keys), dtype=np.int64)
    order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    return order


class QueryTerms:
    """The weights of a block of queries by term."""

    def __init__(self, rows: pa.Table):
        terms, queries = (rows[c].combine_chunks().dictionary_encode() for c in ("term", "query_id"))
        self.terms, self.queries = terms.dictionary, queries.dictionary
        code = terms.indices.to_numpy()
        by = np.argsort(code, kind="stable")
        self.begin = np.searchsorted(code[by], np.arange(len(self.terms) + 1))
        self.query, self.weight = queries.indices.to_numpy()[by].astype(np.int64), rows["weight"].to_numpy()[by]

    def scores(self, found: pa.ListArray, lengths: np.ndarray, k1: float) -> np.ndarray:
        """A row per document of found(term, tf), whose lengths come as the part of the formula they make;
        -inf where no term is shared."""
        doc = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
        postings = found.flatten()
        code = pc.fill_null(pc.index_in(postings.field("term"), value_set=self.terms), -1).to_numpy()
        at = np.flatnonzero(code >= 0)
        code, doc, tf = code[at], doc[at], postings.field("tf").to_numpy()[at]
        worth = tf * (k1 + 1) / (tf + lengths[doc])
        n = self.begin[code + 1] - self.begin[code]
        entry = np.arange(n.sum()) + np.repeat(self.begin[code] + n - np.cumsum(n), n)
        cell, size = np.repeat(doc, n) * len(self.queries) + self.query[entry], len(found) * len(self.queries)
        total = np.bincount(cell, weights=np.repeat(worth, n) * self.weight[entry], minlength=size)
        return np.where(np.bincount(cell, minlength=size) > 0, np.round(total, PLACES), -np.inf).reshape(len(found), -1)


@functools.lru_cache(maxsize=1)
def query_terms(path: str, block: int) -> QueryTerms | None:
    rows = part_of(path, "block", block)
    return QueryTerms(rows) if rows is not None and len(rows) else None


@dataclass
class SparseIndex:
    """docs(doc_id, len, found array<struct<term,tf>>), terms(term, df, idf), n and average length; and
    postings(term, doc_id, tf, len), the same by term."""

    docs: DataFrame
    terms: DataFrame
    n: int
    average: float

    @classmethod
    def build(cls, documents: DataFrame, text: str = "text", epsilon: float = EPSILON) -> SparseIndex:
        """Of documents(doc_id, text); doc_id unique. Empty texts count in n and the average."""
        words = spread(documents.select("doc_id", text), "doc_id").select("doc_id", T.tokenize(F.col(text)).alias("words"))
        docs = stored(words.select("doc_id", F.size("words").cast("bigint").alias("len"), T.term_frequencies(F.col("words")).alias("found")))
        totals = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).collect()[0]
        df = stored(docs.select(F.explode("found.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
        raw = df.withColumn("raw", F.ln(F.lit(totals["n"]) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw")).collect()[0][0] or 0.0
        terms = raw.select("term", "df", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))
        return cls(docs, terms, totals["n"], totals["tokens"] / max(1, totals["n"]))

    @property
    def postings(self) -> DataFrame:
        return self.docs.select("doc_id", "len", F.explode("found").alias("x")).select("x.term", "doc_id", "x.tf", "len")

    def save(self, folder: str) -> None:
        """Write the index."""
        self.docs.write.parquet(f"{folder}/docs", mode="overwrite")
        self.terms.write.parquet(f"{folder}/terms", mode="overwrite")
        self.docs.sparkSession.createDataFrame([(self.n, self.average)], "n bigint, average double").coalesce(1).write.parquet(f"{folder}/totals", mode="overwrite")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SparseIndex:
        """A missing table raises when it is opened."""
        totals = spark.read.parquet(f"{folder}/totals").collect()[0]
        return cls(spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/terms"), totals["n"], totals["average"])

    def best_of_tasks(self, queries: DataFrame, k: int, text: str, k1: float, b: float, block: int) -> DataFrame:
        """(query_id, doc_id, score): the best that each task finds among the documents that share a term."""
        wanted = queries.select("query_id", F.explode(T.tokenize(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        weighted = stored(wanted.join(self.terms, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight")))
        blocks = max(1, -(-weighted.select("query_id").distinct().count() // block))
        path = written(weighted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block"), "block")
        id_kind, kind = weighted.schema["query_id"].dataType.simpleString(), self.docs.schema["doc_id"].dataType.simpleString()
        average = self.average or 1.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in range(blocks):
                    own = query_terms(path, number)
                    step = max(k, AT_ONCE // len(own.queries)) if own else 0
                    for at in range(0, batch.num_rows, step) if own else ():
                        part = batch.slice(at, step)
                        lengths = k1 * (1 - b + b * part.column(1).to_numpy() / average)
                        scores = own.scores(part.column(2), lengths, k1)
                        row, query = best_rows(scores, key_order(part.column(0)), k)
                        yield pa.RecordBatch.from_arrays([own.queries.take(pa.array(query)), part.column(0).take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "doc_id", "score"])

        return self.docs.select("doc_id", "len", "found").mapInArrow(run, f"query_id {id_kind}, doc_id {kind}, score double")

    def search(self, queries: DataFrame, top_k: int = 10, text: str = "question", pad: bool = False, k1: float = K1, b: float = B, block: int = BLOCK_QUERIES) -> DataFrame:
        """(query_id, doc_id, score, rank) of the best documents of each query, ranks from 1. Only
        documents that share a term are found; with pad, queries with fewer get the first other
        documents by key at score 0, as a dense array of scores would give."""
        found = top(self.best_of_tasks(queries, top_k, text, k1, b, block), top_k)
        if not pad:
            return found
        have = found.groupBy("query_id").agg(F.count("*").alias("have"))
        short = queries.select("query_id").distinct().join(have, "query_id", "left").select("query_id", F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < top_k)
        # at most top_k others can be needed beyond those found, which are fewer than top_k: the first 2 top_k keys hold them
        first = [r[0] for r in self.docs.select("doc_id").orderBy("doc_id").limit(2 * top_k).collect()]
        others = short.select("query_id", "have", F.explode(F.array(*map(F.lit, first))).alias("doc_id"))
        zero = others.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
        zero = zero.withColumn("rank", order + F.col("have")).where(F.col("rank") <= top_k).select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank")
        return found.unionByName(zero)


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query_id by score, then doc_id, ranks from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", F.col(score).alias("score"), "rank")
