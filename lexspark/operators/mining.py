"""Hard negatives for training retrievers and rerankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import fuse
from lexspark.operators.ranking import draws
from lexspark.session import stored

BOOST = 1.2
DISTRACTORS = 42


def positives(questions: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions(query_id, doc_id) whose article is in the corpus, with its law, and those whose
    article is missing."""
    law = articles.select("doc_id", "kanun_short")
    return questions.join(law, "doc_id"), questions.join(law, "doc_id", "left_anti")


def from_ranking(ranked: DataFrame, positive: DataFrame, n: int) -> DataFrame:
    """(query_id, doc_id, place): the first n other documents of each query's ranking, places
    from 1."""
    own = positive.select("query_id", F.col("doc_id").alias("_positive"))
    others = ranked.join(own, "query_id").where(F.col("doc_id") != F.col("_positive"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    return others.withColumn("place", place).where(F.col("place") <= n).select("query_id", "doc_id", "place")


def hybrid_ranking(sparse: DataFrame, dense: DataFrame, positive: DataFrame, articles: DataFrame, boost: float = BOOST) -> DataFrame:
    """(query_id, doc_id, score, rank) of two scored lists together: the mean of their scaled scores,
    articles of the positive's law counting more."""
    law = articles.select("doc_id", "kanun_short")
    found = sparse.select("query_id", "doc_id").unionByName(dense.select("query_id", "doc_id")).distinct()
    same = found.join(law, "doc_id").join(positive.where("kanun_short <> ''").select("query_id", "kanun_short"), ["query_id", "kanun_short"]).select("query_id", "doc_id")
    scored = fuse.weighted(sparse, dense, same, boost)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank)


def padded(negatives: DataFrame, positive: DataFrame, articles: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """negatives(query_id, doc_id, place) filled up to n with other articles of the positive's law, of
    the whole corpus if it has no law, in the order of ranking.draws, marked is_padding; a query of a
    law with no other article stays short. positive(query_id, doc_id, kanun_short)."""
    negatives = stored(negatives)  # they are read several times, and few
    have = negatives.groupBy("query_id").agg(F.count("*").alias("have"))
    law = F.coalesce(F.nullif("kanun_short", F.lit("")), F.lit("")).alias("law")
    short = positive.join(have, "query_id", "left").select("query_id", F.col("doc_id").alias("_positive"), law, F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < n)
    pool = articles.where("kanun_short <> ''").select(F.col("kanun_short").alias("law"), "doc_id")
    if short.where("law = ''").limit(1).count():
        pool = pool.unionByName(articles.select(F.lit("").alias("law"), "doc_id"))
    # of n + 1 draws at most the positive and the negatives there are cannot be used
    drawn = draws(short.withColumn("wanted", F.lit(n + 1)), pool, "query_id", "law", "doc_id", seed).withColumnRenamed("place", "draw")
    fresh = drawn.join(short.select("query_id", "_positive", "have"), "query_id").where(F.col("doc_id") != F.col("_positive")).join(negatives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("draw")) + F.col("have")
    extra = fresh.withColumn("place", place.cast("int")).where(F.col("place") <= n)
    return negatives.withColumn("is_padding", F.lit(False)).unionByName(extra.select("query_id", "doc_id", "place", F.lit(True).alias("is_padding")))


def gate_pools(positive: DataFrame, negatives: DataFrame, distractors: int = DISTRACTORS, seed: int = 42) -> DataFrame:
    """(query_id, doc_id, relevant): each query's positive, its negatives, and distractors drawn from the
    positives and negatives of all queries, each document once."""
    everything = positive.select("doc_id").unionByName(negatives.select("doc_id")).distinct().select(F.lit("all").alias("pool"), "doc_id")
    drawn = draws(positive.select("query_id", F.lit("all").alias("pool"), F.lit(distractors + 1).alias("wanted")), everything, "query_id", "pool", "doc_id", seed)
    own = positive.select("query_id", F.col("doc_id").alias("_positive"))
    others = drawn.join(own, "query_id").where(F.col("doc_id") != F.col("_positive"))
    others = others.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("n") <= distractors).select("query_id", "doc_id")
    rest = others.unionByName(negatives.select("query_id", "doc_id")).distinct().join(positive.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return positive.select("query_id", "doc_id", F.lit(True).alias("relevant")).unionByName(rest.withColumn("relevant", F.lit(False)))


def candidate_count(listwise_: DataFrame) -> DataFrame:
    """One row (queries, candidates): how many candidates every query has; an error if they differ, since
    a listwise trainer needs them equal."""
    sizes = listwise_.groupBy("query_id").agg(F.count("*").alias("n"))
    uneven = F.raise_error(F.concat(F.lit("candidates per query from "), F.min("n").cast("string"), F.lit(" to "), F.max("n").cast("string")))
    return sizes.agg(F.count("*").alias("queries"), F.when(F.min("n") < F.max("n"), uneven.cast("bigint")).otherwise(F.min("n")).alias("candidates"))


def positive_ranks(lists: dict[str, DataFrame], positive: DataFrame) -> DataFrame:
    """(query_id, rank_<list>..., rank): where each list has the positive, and the best of them;
    null where it has not."""
    out = positive.select("query_id", "doc_id")
    for name, ranked in lists.items():
        out = out.join(ranked.select("query_id", "doc_id", F.col("rank").alias(f"rank_{name}")), ["query_id", "doc_id"], "left")
    ranks = [F.col(f"rank_{name}") for name in lists]
    return out.withColumn("rank", F.least(*ranks) if len(ranks) > 1 else ranks[0])


def statistics(ranks: DataFrame, negatives: DataFrame, articles: DataFrame, positive: DataFrame) -> DataFrame:
    """One row: questions, share and ranks of found positives, padded questions, and the mean number
    of negatives from the positive's law."""
    law = articles.select("doc_id", F.col("kanun_short").alias("negative_law"))
    per = negatives.join(law, "doc_id").join(positive.select("query_id", "kanun_short"), "query_id").groupBy("query_id").agg(F.max("is_padding").alias("padded"), F.count_if(F.col("negative_law") == F.col("kanun_short")).alias("same_law"))
    joined = ranks.join(per, "query_id", "left")
    return joined.agg(
        F.count("*").alias("questions"), F.count("rank").alias("found"), F.round(F.avg("rank"), 4).alias("mean_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"),
        F.count_if("padded").alias("padded"), F.round(F.avg(F.coalesce("same_law", F.lit(0))), 4).alias("mean_same_law"),
    )


def triplets(questions: DataFrame, negatives: DataFrame, articles: DataFrame) -> DataFrame:
    """questions(query_id, question, doc_id) with the positive text, and negative texts, ids and
    laws in order of their place."""
    text = articles.select("doc_id", "metin", "kanun_short")
    own = negatives.join(text, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "metin", "kanun_short"))).alias("n"))
    joined = questions.join(text.select("doc_id", F.col("metin").alias("positive")), "doc_id").join(own, "query_id")
    return joined.select("query_id", F.col("question").alias("anchor"), "positive", F.col("doc_id").alias("positive_doc_id"), F.col("n.metin").alias("negatives"), F.col("n.doc_id").alias("negative_doc_ids"), F.col("n.kanun_short").alias("negative_laws"))


def listwise(triplets_: DataFrame) -> DataFrame:
    """(query_id, position, doc_id, label): the positive first, then the negatives."""
    ids = F.concat(F.array("positive_doc_id"), F.col("negative_doc_ids"))
    return triplets_.select("query_id", F.posexplode(ids).alias("position", "doc_id")).withColumn("label", (F.col("position") == 0).cast("int"))
