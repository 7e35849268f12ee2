"""From hits to answers: reranking, context, prompts, generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators.sparse import PLACES

CONTEXT_CHARS = 6000
SEPARATOR = "\n\n"

#: What an assistant is told; a model may be given another wording.
SYSTEM_PROMPT = (
    "Mevzuat sorularını, yanında verilen maddelerden başka bir kaynağa başvurmadan yanıtla. Her cümlenin dayanağını köşeli "
    "ayraç içinde kanun kısaltması ve madde numarasıyla, [ABC m.1] gibi göster. Maddeler soruyu yanıtlamıyorsa bunu belirt."
)
#: What a model is told that makes questions from an article: how many, and what of the article.
SYNTHESIS_PROMPT = ("Aşağıdaki maddeden ", " soru ve cevap üret; yalnızca question, answer ve difficulty alanlı nesnelerden oluşan bir JSON dizisi döndür.\n\nMadde: ", "\nBaşlık: ", "\n\n")
SYNTHESIS_CHARS, NO_HEADING = 3500, "(başlıksız)"
# The wording of the prompt and of the answer without sources.
USER_PROMPT = ("Soru: ", "\n\nKaynak Maddeler:\n", "\n\nCevap:")
NO_ANSWER = "Verilen kaynaklarda bu sorunun cevabı bulunmamaktadır."
DUMMY = "(DUMMY) Verilen kaynaklara göre: "


def overlap_score(question: Column, passage: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's tokens in the passage."""
    share = T.let(F.array_distinct(T.tokenize(question)), lambda q: F.size(F.array_intersect(q, T.tokenize(passage))) / F.nullif(F.size(q), F.lit(0)))
    return F.round(F.coalesce(share, F.lit(0.0)), PLACES)


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, top_k: int = 5, question: str = "question", passage: str = "text", order: tuple[str, ...] = ("rank",)) -> DataFrame:
    """hits(query_id, question, passage) with the scorer's score, ranked by it, ties by the order
    columns; rank counts from 0. A scorer may be a pandas UDF that holds a model; only the hits
    given are scored."""
    scored = hits.withColumn("score", scorer(F.col(question), F.col(passage)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order)) - 1
    return scored.withColumn("_rank", rank).where(F.col("_rank") < top_k).drop("rank").withColumnRenamed("_rank", "rank")


def block(law: Column, number: Column, heading: Column, body: Column, missing: str = "") -> Column:
    """A source as the context shows it; null parts as missing."""
    head = F.concat(F.lit("["), F.coalesce(law, F.lit(missing)), F.lit(" m."), F.coalesce(number, F.lit(missing)), F.lit("]"))
    return F.concat(head, F.when(heading != "", F.concat(F.lit(" ("), heading, F.lit(")"))).otherwise(F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def context(hits: DataFrame, limit: int = CONTEXT_CHARS, missing: str = "") -> DataFrame:
    """(query_id, context, used): the blocks of each query in rank order up to the first that does
    not fit, joined by an empty line. A first block over the limit leaves the context empty. hits are
    the ranked hits of a query, few by nature; equal ranks are taken by doc_id."""
    blocks = hits.select("query_id", "rank", "doc_id", block(F.col("kanun_short"), F.col("madde_no"), F.col("baslik"), F.col("text"), missing).alias("_block"))
    running = F.sum(F.length("_block") + len(SEPARATOR)).over(Window.partitionBy("query_id").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - len(SEPARATOR)
    fitting = blocks.withColumn("_fits", running <= limit)
    kept = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("rank", "doc_id", "_block"))))
    text = F.array_join(F.transform(kept, lambda x: x["_block"]), SEPARATOR)
    return fitting.groupBy("query_id").agg(text.alias("context"), F.count_if("_fits").alias("used"))


def context_of_ids(rows: DataFrame, articles: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context, used) of the articles that rows(query_id, doc_ids) name, in their order; ids
    that articles(doc_id, ...) lacks are passed over, rows without any have no context."""
    named = rows.select("query_id", F.posexplode("doc_ids").alias("rank", "doc_id")).join(articles.select("doc_id", "kanun_short", "madde_no", "baslik", F.col("metin").alias("text")), "doc_id")
    return context(named, limit)


def prompt(question: Column, context_: Column, limit: int = CONTEXT_CHARS) -> Column:
    return F.concat(F.lit(USER_PROMPT[0]), question, F.lit(USER_PROMPT[1]), F.left(context_, F.lit(limit)), F.lit(USER_PROMPT[2]))


def dummy_answer(prompt_: Column) -> Column:
    """The first source of the prompt, for runs without a model."""
    from_sources = F.substr(prompt_, F.greatest(F.instr(prompt_, "Kaynak Maddeler:"), F.lit(1)))
    parts = F.split(from_sources, "\n\n")
    first = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.left(from_sources, F.lit(300)))
    return F.concat(F.lit(DUMMY), F.left(first, F.lit(300)), F.lit("..."))


def generate(prompts: DataFrame, model: Callable[[list[tuple[str, str]]], list[str]], system: str = SYSTEM_PROMPT) -> DataFrame:
    """(query_id, answer) of prompts(query_id, prompt) by any function from (system, user) pairs to
    texts; it is sent to the tasks and called by batch."""
    kind = prompts.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = model([(system, p or "") for p in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], ["query_id", "answer"])

    return prompts.select("query_id", "prompt").mapInArrow(run, f"query_id {kind}, answer string")


def synthesis_prompt(law: Column, number: Column, heading: Column, body: Column, questions: int = 2) -> Column:
    """What a model is asked to make questions of an article; the article is cut."""
    head = F.concat(F.coalesce(law, F.lit("")), F.lit(" m."), F.coalesce(number, F.lit("")))
    title = F.coalesce(F.nullif(heading, F.lit("")), F.lit(NO_HEADING))
    a, b, c, d = map(F.lit, SYNTHESIS_PROMPT)
    return F.concat(a, F.lit(str(questions)), b, head, c, title, d, F.left(F.coalesce(body, F.lit("")), F.lit(SYNTHESIS_CHARS)))


def synthesised(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """(key, pos, question, answer, difficulty) of the items in replies that are a JSON array, fences and
    talk aside: items with both question and answer, lookup being the default difficulty. Replies
    without an array, and items that are no objects, give none."""
    items = F.from_json(T.json_part(F.col(reply), array=True), "array<struct<question:string,answer:string,difficulty:string>>")
    rows = replies.select(key, F.posexplode(items).alias("pos", "x")).where("x.question is not null and x.answer is not null")
    return rows.select(key, "pos", "x.question", "x.answer", F.coalesce("x.difficulty", F.lit("lookup")).alias("difficulty"))


def source_line(position: Column, law: Column, number: Column, score: Column, body: Column) -> Column:
    """A source as a list shows it: head, score, a dash for none, and a preview on one line."""
    preview = F.translate(F.left(F.coalesce(body, F.lit("")), F.lit(300)), "\n", " ")
    return F.concat(F.lit("**"), position.cast("string"), F.lit(". ["), law, F.lit(" m."), number, F.lit("]** (score: "), F.coalesce(F.round(score.cast("decimal(18,6)"), 3).cast("string"), F.lit("—")), F.lit(")\n\n> "), preview, F.lit("..."))


def chat_example(question: Column, answer: Column, source: Column, limit: int = 1500) -> Column:
    """A training example of system, user and assistant turns; the source text is cut."""
    turns = [("system", F.lit(SYSTEM_PROMPT)), ("user", prompt(question, F.left(source, F.lit(limit)))), ("assistant", answer)]
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])
