"""Quality of rankings, answers and citations per question, and their aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import scores as S
from lexspark.functions import text as T
from lexspark.operators.ranking import running_sums

DEPTHS = (1, 3, 5, 10)


def retrieved(ranked: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, retrieved): the ids of the first documents of each query, in order."""
    first = ranked.where(F.col("rank") <= depth)
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved"))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """gold(query_id, gold_doc_ids) with recall@k, mrr@10 and ndcg@10 of ranked(query_id, doc_id,
    rank), ranks from 1; questions without hits or gold ids score 0."""
    joined = gold.select("query_id", F.coalesce("gold_doc_ids", F.array()).alias("gold")).join(retrieved(ranked, max(*depths, 10)), "query_id", "left")
    ids, own = F.coalesce("retrieved", F.array()), F.col("gold")
    columns = [F.round(S.recall_at(ids, own, k), 6).alias(f"recall_{k}") for k in depths]
    return joined.select("query_id", *columns, F.round(S.mrr_at(ids, own, 10), 6).alias("mrr_10"), F.round(S.ndcg_at(ids, own, 10), 6).alias("ndcg_10"))


def answer_metrics(pairs: DataFrame, keys: list[str], pred: str = "pred", gold: str = "gold", rouge: bool = True) -> DataFrame:
    """keys with em, f1, bleu and rouge_l of two texts; null texts count as empty."""
    texts = pairs.select(*keys, T.normalize_tr(F.col(pred)).alias("_pn"), T.normalize_tr(F.col(gold)).alias("_gn"))
    split = texts.select(*keys, (F.col("_pn") == F.col("_gn")).cast("double").alias("em"), *[F.regexp_extract_all(c, F.lit(T.METRIC_TOKEN), 1).alias(n) for c, n in (("_pn", "_p"), ("_gn", "_g"))])
    p, g = F.col("_p"), F.col("_g")
    counted = split.select(*keys, "em", F.size(p).alias("_np"), F.size(g).alias("_ng"), S.shared_grams(p, g).alias("_shared"), *([F.round(S.rouge_l(p, g), 6).alias("rouge_l")] if rouge else []))
    sizes = F.col("_np"), F.col("_ng")
    out = [F.round(S.token_f1(F.col("_shared"), *sizes), 6).alias("f1"), F.round(S.bleu(F.col("_shared"), *sizes), 6).alias("bleu")]
    return counted.select(*keys, "em", *out, *(["rouge_l"] if rouge else []))


def average_precision(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, ap): mean precision at each relevant row of scored(by, rank, relevant), ranks from 1."""
    hits = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    placed = scored.withColumn("_hits", hits)
    return placed.groupBy(by).agg(F.round(F.coalesce(F.sum(F.when(F.col("relevant"), F.col("_hits") / F.col("rank"))) / F.nullif(F.count_if("relevant"), F.lit(0)), F.lit(0.0)), 6).alias("ap"))


def gate(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """One row: share of positives at ranks up to 1, 5 and 10, mean reciprocal and mean rank. A positive
    without a rank counts as not found; the mean rank is over those that have one, all of them where
    ranks are taken within mining.gate_pools."""
    r = F.col(rank)
    return ranks.agg(*[F.round(F.avg((F.coalesce(r, F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"r_{k}") for k in (1, 5, 10)], F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(r), 6).alias("mean_rank"))


def threshold_metrics(scored: DataFrame, score: str = "score", relevant: str = "relevant") -> DataFrame:
    """One row over scored(score, relevant): the best accuracy and the best F1 that a threshold reaches,
    the highest such thresholds, precision and recall at the F1's, and the average precision. Scores
    are rounded to six places, and count once each with how often they occur. Null scores do not
    count."""
    by = scored.where(F.col(score).isNotNull()).groupBy(F.round(score, 6).alias("t")).agg(F.count_if(relevant).alias("p"), F.count_if(~F.col(relevant)).alias("q"))
    summed = running_sums(by, "t", ["p", "q"], descending=True)
    at = summed.select("t", "p", F.col("upto_p").alias("tp"), F.col("upto_q").alias("fp"), F.col("total_p").alias("np"), F.col("total_q").alias("nq"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.coalesce(F.col("tp") / F.nullif("np", F.lit(0)), F.lit(0.0))
    at = at.select("t", ((F.col("tp") + F.col("nq") - F.col("fp")) / (F.col("np") + F.col("nq"))).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), (2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("np"))).alias("f1"), F.coalesce(precision * F.col("p") / F.nullif("np", F.lit(0)), F.lit(0.0)).alias("gain"))
    best = at.agg(F.max(F.struct(F.round("accuracy", 9).alias("accuracy"), "t")).alias("a"), F.max(F.struct(F.round("f1", 9).alias("f1"), "t", "precision", "recall")).alias("b"), F.sum("gain").alias("ap"))
    columns = {"accuracy": "a.accuracy", "accuracy_threshold": "a.t", "f1": "b.f1", "f1_threshold": "b.t", "precision": "b.precision", "recall": "b.recall", "average_precision": "ap"}
    return best.select(*[F.round(c, 6).alias(n) for n, c in columns.items()])


def long_form(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) of a wide table of metrics."""
    return wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def macro(facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, mean, n) over facts(by, metric, value); null and NaN values do not count, a group
    of none has a null mean."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return facts.groupBy(*by, "metric").agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))


def by_category(facts: DataFrame) -> DataFrame:
    """Means per configuration and category, and per configuration with category null (the rollup);
    a null or empty category is 'unknown'."""
    named = facts.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")))
    value = F.when(~F.isnan("value"), F.col("value"))
    rolled = named.groupingSets([["config", "metric", "category"], ["config", "metric"]], "config", "metric", "category")
    return rolled.agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))


def deltas(means: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(label, metric, delta) of configurations a minus b; null where one is missing."""
    value = lambda c: F.max(F.when(F.col("config") == c, F.col("mean")))
    cells = F.array(*[F.struct(F.lit(label).alias("label"), F.round(value(a) - value(b), 6).alias("delta")) for a, b, label in pairs])
    return means.groupBy("metric").agg(cells.alias("cells")).select("metric", F.explode("cells").alias("x")).select("x.label", "metric", "x.delta")


def pivoted(means: DataFrame, configs: list[str], metric: str) -> DataFrame:
    """(category, <config>...) of one metric's means per category."""
    rows = means.where((F.col("metric") == metric) & F.col("category").isNotNull())
    return rows.groupBy("category").pivot("config", configs).agg(F.first("mean"))


def configurations(means: DataFrame, names: list[str]) -> DataFrame:
    """A row per configuration and metric, with n = 0 for those that have no results."""
    wanted = means.sparkSession.createDataFrame([(n,) for n in names], "config string")
    return wanted.join(means, "config", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("status", F.when(F.col("metric").isNull(), "missing").otherwise("ok"))


def summary_facts(summaries: DataFrame, groups: tuple[str, ...] = ("retrieval", "answer", "citation")) -> DataFrame:
    """(config, metric, value) of nested summaries(config, <group> map<string,double>...), rounded to four
    places; groups that are missing or null give none."""
    maps = [F.coalesce(F.col(g), F.create_map().cast("map<string,double>")) for g in groups if g in summaries.columns]
    return summaries.select("config", F.explode(F.map_concat(*maps)).alias("metric", "value")).withColumn("value", F.round("value", 4))


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a few rows that a report has collected."""

    def cell(v: object) -> str:
        return "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]])
