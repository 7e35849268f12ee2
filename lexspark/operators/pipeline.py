"""From questions to answers with their sources, in one call over a table of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators import answers
from lexspark.operators.search import HIT_COLUMNS, Retriever, candidate_depth
from lexspark.session import stored


@dataclass
class Pipeline:
    """A retriever, a scorer to rerank its hits if one is given, and a model from (system, user) prompts
    to texts; without a model the answer is the dummy one."""

    retriever: Retriever
    model: Callable[[list[tuple[str, str]]], list[str]] | None = None
    scorer: Callable[[Column, Column], Column] | None = None
    mode: str = "hybrid"
    top_k: int = 5
    candidate_k: int = 50
    system: str = answers.SYSTEM_PROMPT

    def hits(self, questions: DataFrame, evaluating: bool = False) -> DataFrame:
        """The hits of questions(query_id, question), reranked if there is a scorer; ranks from 0."""
        depth = candidate_depth(self.top_k, self.candidate_k, self.scorer is not None, evaluating)
        found = self.retriever.search(questions, depth, self.mode, self.candidate_k).withColumnRenamed("metin", "text")
        if self.scorer is None:
            return found
        asked = found.join(questions.select("query_id", "question"), "query_id")
        return answers.rerank(asked, self.scorer, max(self.top_k, 10) if evaluating else self.top_k).drop("question")

    def replies(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, question, context, answer) of every question, without hits from an empty context."""
        contexts = answers.context(hits.where(F.col("rank") < self.top_k))
        asked = questions.select("query_id", "question").join(contexts.select("query_id", "context"), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        prompted = asked.withColumn("prompt", answers.prompt(F.coalesce("question", F.lit("")), F.col("context")))
        if self.model is None:
            return prompted.withColumn("answer", answers.dummy_answer(F.col("prompt"))).drop("prompt")
        prompted = stored(prompted)  # the model's answers are joined to the prompts it was given
        return prompted.drop("prompt").join(answers.generate(prompted, self.model, self.system), "query_id")

    def answer(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, answer, sources, context_chars) of questions(query_id, question), query_id
        unique; sources are the hits in order, none where nothing is found."""
        hits = stored(self.hits(questions))
        source = F.struct("rank", "doc_id", "score", *[c for c in HIT_COLUMNS if c not in ("doc_id", "metin")], "text")
        sources = hits.where(F.col("rank") < self.top_k).groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
        out = self.replies(questions, hits).join(sources, "query_id", "left")
        kind = sources.schema["sources"].dataType.simpleString()
        return out.select("query_id", "question", "answer", F.coalesce("sources", F.array().cast(kind)).alias("sources"), F.length("context").alias("context_chars"))
