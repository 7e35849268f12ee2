"""Answering questions as they arrive: the batch retriever over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexspark.operators.search import Retriever


def answer_stream(spark: SparkSession, questions: str, out: str, checkpoint: str, retriever: Retriever, top_k: int = 10, mode: str = "hybrid") -> StreamingQuery:
    """Write the hits of each new question file of a folder (query_id, question as JSON lines) as
    Parquet, a folder per micro-batch so that a repeated batch overwrites itself. Runs until all
    files that are there have been read; started again, it takes up new ones."""

    def one(batch: DataFrame, number: int) -> None:
        retriever.search(batch, top_k, mode).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arriving = spark.readStream.schema("query_id string, question string").json(questions)
    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
