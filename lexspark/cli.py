"""Command line: python -m lexspark.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import scores, text
from lexspark.operators import answers, corpus, evaluation, goldset, judging, mining
from lexspark.operators.pipeline import Pipeline
from lexspark.operators.search import MODES, Retriever
from lexspark.session import local_session
from lexspark.sources import files


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table in Parquet, or JSON lines by ending."""
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    articles = corpus.corpus(read(spark, a.corpus))
    Retriever.build(articles, a.embed_model, with_sparse=not a.skip_bm25, with_dense=not a.skip_dense).save(a.output_dir)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    retriever = Retriever.load(spark, a.index_dir, a.embed_model, a.mode != "dense", a.mode != "bm25")
    questions = read(spark, a.questions).select("query_id", "question")
    retriever.search(questions, a.top_k, a.mode, a.candidate_k).write.mode("overwrite").parquet(a.out)


def answer(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answer a table of questions (query_id, question) with the dummy model."""
    pipeline = Pipeline(Retriever.load(spark, a.index_dir, a.embed_model, a.mode != "dense", a.mode != "bm25"), None, answers.overlap_score if a.rerank else None, a.mode, a.top_k, a.candidate_k)
    pipeline.answer(read(spark, a.questions)).write.mode("overwrite").parquet(a.out)


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows; a gold id may stand for an array of one, and list fields may be missing."""
    rows = read(spark, path)
    kinds = dict(rows.dtypes)
    none = F.array().cast("array<string>")
    if "gold_doc_ids" not in kinds:
        ids = none
    elif kinds["gold_doc_ids"].startswith("array"):
        ids = F.coalesce(F.col("gold_doc_ids").cast("array<string>"), none)
    else:
        ids = text.id_array(F.col("gold_doc_ids"))
    # a JSON file without any pair is read as another type
    pairs = F.col("gold_citations") if kinds.get("gold_citations", "").startswith("array<array") else F.lit(None).cast("array<array<string>>")
    return rows.select(F.col("id").alias("query_id"), "question", ids.alias("gold_doc_ids"), F.col("answer").alias("gold"), pairs.alias("gold_citations"), "category")


def evaluate(spark: SparkSession, index_dir: str, test_set: str, out: str, config: str, mode: str, top_k: int, candidate_k: int, limit: int, rerank: bool, embed_model: str, judged: bool = False) -> None:
    """Results per question under out/per_example and their means under out/summary."""
    retriever = Retriever.load(spark, index_dir, embed_model, mode != "dense", mode != "bm25")
    gold = gold_questions(spark, test_set)
    gold = gold.orderBy("query_id").limit(limit) if limit else gold
    pipeline = Pipeline(retriever, None, answers.overlap_score if rerank else None, mode, top_k, candidate_k)
    hits = pipeline.hits(gold, evaluating=True)
    metrics = evaluation.retrieval_metrics(hits.select("query_id", "doc_id", (F.col("rank") + 1).alias("rank")), gold)
    replies = pipeline.replies(gold, hits).join(gold.select("query_id", "gold"), "query_id").withColumnRenamed("answer", "pred")
    expected = goldset.citations(gold, retriever.meta, "query_id")
    cited = replies.join(expected, "query_id").select("query_id", scores.citation_scores(text.citations(F.col("pred")), F.col("citations")).alias("x"))
    cited = cited.select("query_id", *[F.round(f"x.{n}", 6).alias(f"cit_{n}") for n in ("p", "r", "f1")])
    rows = metrics.join(evaluation.answer_metrics(replies, ["query_id"]), "query_id", "left").join(cited, "query_id", "left").join(gold.select("query_id", "category"), "query_id")
    if judged:
        verdicts = judging.overlap_verdicts(F.col("pred"), F.col("context"))
        faithful = replies.select("query_id", F.round(scores.claim_score(verdicts), 6).alias("faithfulness"))
        rows = rows.join(faithful, "query_id", "left")
    files.write_json_lines(rows.withColumn("config", F.lit(config)), f"{out}/per_example")
    names = [c for c in rows.columns if c not in ("query_id", "category")]
    facts = evaluation.long_form(spark.read.schema(rows.schema.add("config", "string")).json(f"{out}/per_example").select("config", "query_id", "category", *names), ["config", "query_id", "category"], names)
    files.write_csv(evaluation.by_category(facts).orderBy("metric", "category").coalesce(1), f"{out}/summary")


def run_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    """Retrieve, optionally rerank, answer with the dummy model, and write results and means."""
    evaluate(spark, a.index_dir, a.test_set, a.out, a.config, a.mode, a.top_k, a.candidate_k, a.limit, a.rerank, a.embed_model, a.judge)


def run_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    """Evaluate every configuration of a JSON list of objects (config, and options of run-eval) under
    out/<config>; one that fails is reported in out/status and does not stop the others."""
    with open(a.configs, encoding="utf-8") as f:
        configs = json.load(f)
    status = []
    for c in configs:
        try:
            evaluate(spark, c.get("index_dir", a.index_dir), a.test_set, f"{a.out}/{c['config']}", c["config"], c.get("mode", "hybrid"), c.get("top_k", 5), c.get("candidate_k", 50), 0, c.get("rerank", False), c.get("embed_model", "hashing"), c.get("judge", False))
            status.append((c["config"], "ok", None))
        except Exception as e:  # noqa: BLE001 whatever a configuration fails of
            status.append((c["config"], "failed", str(e)[:1000]))
    files.write_json_lines(spark.createDataFrame(status, "config string, status string, error string").coalesce(1), f"{a.out}/status")


def aggregate_results(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tables over the results of several configurations (comma-separated names of folders in results):
    ablation_table, isolations (pairs a-b, comma-separated), per_category, and a Markdown report."""
    names = a.configs.split(",")
    paths = [(n, p) for n in names for p in [f"{a.results}/{n}/per_example"] if files.preferred(spark, [p], lambda x: spark.range(0)) is not None]
    facts = None
    for name, path in paths:
        rows = spark.read.json(path)
        metrics = [c for c, k in rows.dtypes if k in ("double", "bigint") and c != "idx"]
        own = evaluation.long_form(rows.select(F.lit(name).alias("config"), "category", *metrics), ["config", "category"], metrics)
        facts = own if facts is None else facts.unionByName(own)
    if facts is None:
        raise ValueError(f"no results under {a.results}")
    means = evaluation.macro(facts, ["config"]).cache()
    main = evaluation.configurations(means, names)
    pairs = [(x, y, f"{x} - {y}") for x, y in (p.split("-") for p in a.isolations.split(",") if p)]
    isolations = evaluation.deltas(means, pairs) if pairs else None
    categories = evaluation.by_category(facts).where("category is not null")
    files.write_csv(main.orderBy("config", "metric").coalesce(1), f"{a.out}/ablation_table")
    files.write_csv(categories.orderBy("config", "category", "metric").coalesce(1), f"{a.out}/per_category")
    wide = lambda df, key: [r.asDict() for r in df.groupBy(key).pivot("metric").agg(F.first("delta" if key == "label" else "mean")).orderBy(key).collect()]  # noqa: E731 a row per configuration
    parts = [("Configurations", wide(main.where("metric is not null"), "config"), "config")]
    if isolations is not None:
        files.write_csv(isolations.orderBy("label", "metric").coalesce(1), f"{a.out}/isolations")
        parts.append(("Isolations", wide(isolations, "label"), "label"))
    report = "\n\n".join(f"## {title}\n\n" + evaluation.markdown(rows, [key, *sorted(k for k in rows[0] if k != key)]) for title, rows, key in parts if rows)
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    means.unpersist()


def mine(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hard negatives of questions (query_id, question, doc_id), from BM25 or both lists."""
    articles = corpus.corpus(read(spark, a.corpus))
    asked = read(spark, a.questions).select("query_id", "question", "doc_id")
    positive, _ = mining.positives(asked, articles)
    retriever = Retriever.load(spark, a.index_dir, a.embed_model, True, a.mode == "hybrid")
    ranked = retriever.rank(asked, a.top_k, "bm25")
    if a.mode == "hybrid":
        ranked = mining.hybrid_ranking(ranked, retriever.rank(asked, a.top_k, "dense"), positive, articles, a.same_law_boost)
    negatives = mining.padded(mining.from_ranking(ranked, positive, a.num_negatives), positive, articles, a.num_negatives, a.seed)
    mining.triplets(asked, negatives, articles).write.mode("overwrite").parquet(a.out)


def synthesise(spark: SparkSession, a: argparse.Namespace) -> None:
    """Question-answer pairs from replies (doc_id, reply) of a model, with their articles."""
    articles = corpus.corpus(read(spark, a.corpus)).select(F.col("doc_id").alias("source_doc_id"), "kanun_short", "kanun_full", "madde_no", F.col("metin").alias("madde_text"))
    pairs = answers.synthesised(read(spark, a.replies), "doc_id").withColumnRenamed("doc_id", "source_doc_id")
    pairs.join(articles, "source_doc_id").write.mode("overwrite").parquet(a.out)


def synthesis_prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prompts (doc_id, prompt) that ask a model for questions on each article."""
    articles = corpus.corpus(read(spark, a.corpus))
    prompt = answers.synthesis_prompt(F.col("kanun_short"), F.col("madde_no"), F.col("baslik"), F.col("metin"), a.num_questions)
    articles.select("doc_id", prompt.alias("prompt")).write.mode("overwrite").parquet(a.out)


def normalise_codes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Law codes and ids of articles by law number."""
    corpus.with_law_codes(read(spark, a.corpus), read(spark, a.laws)).write.mode("overwrite").parquet(a.out)


def law_list(spark: SparkSession, a: argparse.Namespace) -> None:
    """A JSON array of laws as a table with the addresses of their files; --only keeps these names."""
    laws = files.addresses(files.law_list(spark, a.list), a.base or None)
    files.named(laws, [x for x in a.only.split(",") if x]).write.mode("overwrite").parquet(a.out)


def merge_gold(spark: SparkSession, a: argparse.Namespace) -> None:
    checked = goldset.parsed(files.lines_with_numbers(spark, a.files))
    corpus_ids = read(spark, a.corpus).select("doc_id")
    rows = goldset.split(goldset.splittable(goldset.merged(goldset.valid(checked)), corpus_ids), a.test_ratio, a.seed)
    for part in ("dev", "test"):
        files.write_json_lines(rows.where(F.col("split") == part).drop("split", "file_name", "line_no"), f"{a.out}/{part}")
    files.write_document(goldset.report(checked, corpus_ids), f"{a.out}/report")


def judge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Score rows (id, reply) by the verdicts in the reply; rows done before are left out."""
    rows = read(spark, a.replies)
    done = files.preferred(spark, [a.out], spark.read.parquet)
    todo = rows if done is None else judging.resumed(rows, done, "id")
    todo.withColumn("j", judging.judged(F.col("reply"))).select("id", "j.*").write.mode("append").parquet(a.out)


def parse_laws(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus.segment(read(spark, a.laws), a.key, a.text).write.mode("overwrite").parquet(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexspark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, **options) -> None:
        c = sub.add_parser(f.__name__.replace("_", "-"), description=f.__doc__, help=(f.__doc__ or "").split("\n")[0])
        c.set_defaults(run=f)
        for name, default in options.items():
            flag = "--" + name.replace("_", "-")
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, required=default is None, default=default, type=type(default) if default is not None else str, choices=MODES if name == "mode" else None)

    model = {"embed_model": "hashing"}
    command(build_index, corpus=None, output_dir=None, skip_dense=False, skip_bm25=False, **model)
    command(search, index_dir=None, questions=None, out=None, mode="hybrid", top_k=10, candidate_k=50, **model)
    command(answer, index_dir=None, questions=None, out=None, mode="hybrid", top_k=5, candidate_k=50, rerank=False, **model)
    command(run_eval, index_dir=None, test_set=None, out=None, config="A", mode="hybrid", top_k=5, candidate_k=50, limit=0, rerank=False, judge=False, **model)
    command(run_matrix, index_dir=None, test_set=None, configs=None, out=None)
    command(aggregate_results, results=None, configs=None, isolations="", out=None)
    command(mine, index_dir=None, corpus=None, questions=None, out=None, mode="bm25", top_k=20, num_negatives=8, same_law_boost=mining.BOOST, seed=42, **model)
    command(synthesise, replies=None, corpus=None, out=None)
    command(synthesis_prompts, corpus=None, out=None, num_questions=2)
    command(normalise_codes, corpus=None, laws=None, out=None)
    command(law_list, list=None, out=None, base="", only="")
    command(merge_gold, files=None, corpus=None, out=None, test_ratio=0.2, seed=42)
    command(judge, replies=None, out=None)
    command(parse_laws, laws=None, out=None, key="law", text="text")
    return p


def main(argv: list[str] | None = None) -> None:
    arguments = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    arguments.run(spark, arguments)


if __name__ == "__main__":
    main()
