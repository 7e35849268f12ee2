"""The queries of the numbered problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, characters, languages, leaks, overlaps, packing, pairs, repeats, scans, split, words
from lexspark.llm.oracle import ORACLE  # noqa: F401
from lexspark.session import spread, stored, table


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that problem 1 splits, as (src, row_id, pos, text)."""
    madde, hit = table(spark, folder, "madde"), table(spark, folder, "hit")
    zero = F.lit(0).alias("pos")
    return (
        madde.select(F.lit("metin").alias("src"), "row_id", zero, F.col("metin").alias("text"))
        .unionByName(madde.select(F.lit("fikralar").alias("src"), "row_id", F.posexplode("fikralar").alias("pos", "text")))
        .unionByName(hit.select(F.lit("hit").alias("src"), F.col("hit_id").alias("row_id"), zero, "text"))
    )


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_items(_items(spark, folder), ["src", "row_id", "pos"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split.split_items(_items(spark, folder), ["src", "row_id", "pos"], with_text=False)
    return pieces.where("piece = 1").select("src", "row_id", "pos")


def _overlaps(spark: SparkSession, folder: str) -> overlaps.Overlaps:
    gold = [table(spark, folder, t).select(F.lit(n).alias("split"), F.col("row_id").alias("eval_id"), "question", "gold_doc_ids") for n, t in (("dev", "dev_omer"), ("test", "test_full"))]
    train = table(spark, folder, "synthetic_qa").select(F.col("qa_id").alias("train_id"), "question", "source_doc_id")
    return overlaps.overlapping(gold[0].unionByName(gold[1]), spread(train, "train_id"))


def p1_check(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of every item put together again from the new text of its pieces, and whether all
    its pieces keep to the limit and to the overlap."""
    pieces = split.split_items(_items(spark, folder), ["src", "row_id", "pos"])
    new = F.expr("substring(text, new - start + 1)")
    own = pieces.groupBy("src", "row_id", "pos").agg(
        F.array_sort(F.collect_list(F.struct("piece", new.alias("new")))).alias("new"), F.bool_and((F.length("text") <= split.LIMIT) & (F.col("end") - F.col("start") == F.length("text"))).alias("within"), F.bool_and(F.col("new") - F.col("start") <= split.OVERLAP).alias("overlapping")
    )
    return own.select("src", "row_id", "pos", F.md5(F.array_join(F.col("new.new"), "")).alias("digest"), "within", "overlapping")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).pairs()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pairs and questions per split and law of the training row."""
    return _overlaps(spark, folder).report(table(spark, folder, "synthetic_qa").select(F.col("qa_id").alias("train_id"), "kanun_short"), ["kanun_short"])


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    madde = spread(table(spark, folder, "madde").select("row_id", "kanun_full", "metin", "baslik"), "row_id")
    return madde.select("row_id", F.col("kanun_full").alias("title"), F.explode(F.create_map(F.lit("metin"), "metin", F.lit("baslik"), "baslik")).alias("field", "text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.Repair.of(_articles(spark, folder)).noise()


def p3_texts(spark: SparkSession, folder: str) -> DataFrame:
    return scans.Repair.of(_articles(spark, folder)).texts()


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    qa = spread(table(spark, folder, "synthetic_qa").select("qa_id", "question", "answer"), "qa_id")
    texts = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("text_id"), "text").unionByName(
        qa.select(F.lit("synthetic_qa").alias("src"), F.col("qa_id").alias("text_id"), F.explode(F.array("question", "answer")).alias("text"))
    )
    items = table(spark, folder, "test_full").select("row_id", "question", words.without_citations(F.col("answer")).alias("answer"))
    return leaks.leaks(texts, items, "row_id", ["question", "answer"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("item_id", "src", "text_id").distinct()


def p4_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaked passage with its place in the text."""
    return _leaks(spark, folder)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    dictionaries = languages.fit(table(spark, folder, "documents"), "doc_id", "text", "lang")
    return pairs.defects(spread(table(spark, folder, "synthetic_qa").select("qa_id", "question", "answer"), "qa_id"), dictionaries)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of problem 6 as (src, row, id, question)."""
    lines = table(spark, folder, "gold_lines").select("line_id", repeats.record_fields(F.col("line")).alias("r")).where("r is not null")
    return (
        table(spark, folder, "dev_omer").select(F.lit("dev_omer").alias("src"), F.col("row_id").alias("row"), "id", "question")
        .unionByName(lines.select(F.lit("gold_lines").alias("src"), F.col("line_id").alias("row"), "r.id", "r.question"))
    )


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.collapse(_records(spark, folder), "row", ["id", "question"], ["src"])[0]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.collapse(_records(spark, folder), "row", ["id", "question"], ["src"])[1]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return (
        characters.changed(table(spark, folder, "hit"), "hit_id", "kanun_short", "hit", code=True)
        .unionByName(characters.changed(table(spark, folder, "madde"), "row_id", "metin", "madde"))
        .unionByName(characters.changed(table(spark, folder, "dev_omer"), "row_id", "question", "dev_omer"))
    )


def p7_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Hits per consistent law code, the code's law, and how many codes had to change."""
    hits = table(spark, folder, "hit").select("kanun_short", characters.consistent_form(F.col("kanun_short"), code=True).alias("code"))
    counted = hits.groupBy("code").agg(F.count("*").alias("hits"), F.count_if(F.col("kanun_short") != F.col("code")).alias("changed"))
    laws = table(spark, folder, "law_metadata").select(F.col("short_name").alias("code"), "kanun_no")
    return counted.join(laws, "code", "left")


def _vocabulary(spark: SparkSession) -> str:
    """The session's lexspark.tokenizer, a path that every executor has."""
    return spark.conf.get("lexspark.tokenizer", bpe.TOKENIZER)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(spread(table(spark, folder, "documents"), "doc_id"), path=_vocabulary(spark))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return packing.containers(bpe.token_counts(spread(documents, "doc_id"), path=_vocabulary(spark)))


def p9_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document's tokens lie in its pieces once and in order, split only if they exceed a
    container, and no container it is in holds too many."""
    documents = spread(table(spark, folder, "documents").where(F.col("text").isNotNull()), "doc_id")
    counts = stored(bpe.token_counts(documents, path=_vocabulary(spark)))
    packed = stored(packing.containers(counts))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    pieces = packed.join(full, "container").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.bool_and(F.col("start") == F.col("piece") * 2048).alias("ordered"), F.max("held").alias("held")
    )
    needed = F.greatest(F.ceil(F.col("n_tokens") / 2048), F.lit(1))
    checked = counts.join(pieces, "doc_id", "left")
    whole = F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("pieces") == needed) & (F.col("last") + 1 == needed) & F.col("ordered"), F.lit(False))
    return checked.select("doc_id", whole.alias("whole"), F.coalesce(F.col("held") <= 2048, F.lit(False)).alias("fits"))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id")
    return languages.languages(languages.segments(documents, languages.fit(documents, "doc_id", "text", "lang")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _languages(spark, folder).where("state <> 'right'").select("doc_id", "state", "lang")


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its languages and their confidence."""
    return _languages(spark, folder)


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every document."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id")
    found = languages.segments(documents, languages.fit(documents, "doc_id", "text", "lang"))
    return found.select("doc_id", F.posexplode("segments").alias("pos", "s")).select("doc_id", "pos", "s.*")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_check, p2_found, p2_report, p3_found, p3_texts, p4_found, p4_passages, p5_found, p6_found, p6_records, p7_found, p7_codes, p8_ids, p9_containers, p9_check, p10_found, p10_languages, p10_segments)}
