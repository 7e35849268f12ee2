"""The retriever: one call answers a whole table of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import dense, fuse
from lexspark.operators.sparse import SparseIndex

MODES = ("bm25", "dense", "hybrid")
HIT_COLUMNS = ["doc_id", "kanun_short", "kanun_full", "madde_no", "baslik", "metin", "url"]


Encoder = Callable[[Column], Column]


def hashing(text: Column) -> Column:
    """The stand-in encoder."""
    return dense.hashed_embedding(T.tokenize(text))


def encode(rows: DataFrame, key: str, text: str, role: str, model: str = "hashing", encoder: Encoder = hashing) -> DataFrame:
    """(key, embedding) by the encoder, a function from a text column to an array column, such as a
    pandas UDF that holds a model; texts get the prefix the model expects."""
    return rows.select(key, encoder(T.prefixed(F.col(text), role, model)).alias("embedding"))


@dataclass
class Retriever:
    """Sparse and dense indexes over articles, and the articles themselves; an index that a mode
    does not need is never read."""

    meta: DataFrame
    sparse: SparseIndex | None = None
    vectors: DataFrame | None = None
    model: str = "hashing"
    encoder: Encoder = hashing

    @classmethod
    def build(cls, articles: DataFrame, model: str = "hashing", with_sparse: bool = True, with_dense: bool = True, encoder: Encoder = hashing) -> Retriever:
        """Of articles with unique doc_id."""
        texts = articles.select("doc_id", T.indexing_text(F.col("kanun_full"), F.col("madde_no"), F.col("baslik"), F.col("metin")).alias("text"))
        sparse = SparseIndex.build(texts) if with_sparse else None
        vectors = encode(texts, "doc_id", "text", "passage", model, encoder) if with_dense else None
        return cls(articles.select(*HIT_COLUMNS), sparse, vectors, model, encoder)

    def save(self, folder: str) -> None:
        """Write the indexes that were built as Parquet tables."""
        self.meta.write.parquet(f"{folder}/meta", mode="overwrite")
        if self.sparse is not None:
            self.sparse.save(f"{folder}/bm25")
        if self.vectors is not None:
            self.vectors.write.parquet(f"{folder}/{self.model.replace('/', '_')}", mode="overwrite")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, model: str = "hashing", load_bm25: bool = True, load_dense: bool = True, encoder: Encoder = hashing) -> Retriever:
        """Open a written index; a missing table raises."""
        meta = spark.read.parquet(f"{folder}/meta")
        sparse = SparseIndex.load(spark, f"{folder}/bm25") if load_bm25 else None
        vectors = spark.read.parquet(f"{folder}/{model.replace('/', '_')}") if load_dense else None
        return cls(meta, sparse, vectors, model, encoder)

    def rank(self, queries: DataFrame, top_k: int = 10, mode: str = "hybrid", candidate_k: int = 50, pad: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank) for queries(query_id, question)."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}, not {mode!r}")
        depth = candidate_k if mode == "hybrid" else top_k
        lists = []
        if mode != "dense":
            lists.append(self.sparse.search(queries, depth, pad=pad))
        if mode != "bm25":
            lists.append(dense.search(self.vectors, encode(queries, "query_id", "question", "query", self.model, self.encoder), depth))
        return lists[0] if len(lists) == 1 else fuse.reciprocal_ranks(lists, top_k)

    def search(self, queries: DataFrame, top_k: int = 10, mode: str = "hybrid", candidate_k: int = 50, pad: bool = False) -> DataFrame:
        """The ranked hits with their articles, joined after the cut; ranks from 0."""
        ranked = self.rank(queries, top_k, mode, candidate_k, pad)
        return ranked.join(self.meta, "doc_id").select("query_id", *HIT_COLUMNS, "score", (F.col("rank") - 1).alias("rank"))


def candidate_depth(top_k: int, candidate_k: int, reranking: bool, evaluating: bool) -> int:
    """How many hits the first stage has to find."""
    return candidate_k if reranking else max(top_k, 10) if evaluating else top_k
