"""Fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.sparse import PLACES
from lexspark.session import stored

RRF_K = 60


def reciprocal_ranks(lists: list[DataFrame], top_k: int, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, rank) by the sum of 1 / (k + rank) over lists with ranks from 1;
    ties go to the better rank in the earlier list, then to the key."""
    united = None
    for i, one in enumerate(lists):
        part = one.select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("rank")).alias("place"))
        united = part if united is None else united.unionByName(part)
    # lists of the same partitioning are stored, since a union of adapted plans may lose what it claims of it
    fused = stored(united).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "place.list", "place.rank", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "doc_id", "score", "rank")


def minmax(scored: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; all 1 where they hardly differ."""
    whole = Window.partitionBy("query_id")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    return scored.withColumn("score", F.when(high - low < 1e-9, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))))


def weighted(a: DataFrame, b: DataFrame, boost: DataFrame | None = None, factor: float = 1.2) -> DataFrame:
    """(query_id, doc_id, score): the mean of the scaled scores of two lists, 0 where a list lacks
    the document; pairs in boost(query_id, doc_id) count by the factor."""
    both = stored(minmax(a).select("query_id", "doc_id", "score").unionByName(minmax(b).select("query_id", "doc_id", "score")))
    summed = both.groupBy("query_id", "doc_id").agg((0.5 * F.sum("score")).alias("score"))
    if boost is not None:
        marked = boost.select("query_id", "doc_id").distinct().withColumn("_boost", F.lit(factor))
        summed = summed.join(marked, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") * F.coalesce("_boost", F.lit(1.0))).alias("score"))
    return summed.withColumn("score", F.round("score", PLACES))
