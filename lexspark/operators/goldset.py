"""Gold questions: tolerant parsing, validation, merging, splitting, reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators.corpus import first_per_key
from lexspark.operators.ranking import stratified_split

# The fields a gold row must have, and the difficulties there are.
REQUIRED = ["id", "question", "answer", "gold_doc_ids", "gold_citations", "difficulty", "category", "author"]
DIFFICULTIES = ["lookup", "reasoning", "edge", "multi_hop", "no_answer"]
LEAST_CHARS = 5

RECORD = "struct<id:string,question:string,answer:string,gold_doc_ids:array<string>,gold_citations:array<array<string>>,difficulty:string,category:string,author:string,notes:string>"


def record_of(line: Column) -> Column:
    """The line as a variant if it is exactly one JSON object, else null. In brackets, trailing text
    makes it no array of one element, which a parser alone would pass over."""
    boxed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    lone = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(lone & F.schema_of_variant(boxed).startswith("ARRAY<OBJECT"), F.try_variant_get(boxed, "$[0]", "variant"))


def parsed(lines: DataFrame) -> DataFrame:
    """lines(file_name, line_no, line) that are neither blank nor null, with record, keys, kinds of
    the two list fields, and errors: 'parse' for what is no JSON object, else what validation finds."""
    kept = lines.where(F.trim(F.regexp_replace("line", r"\s", " ")) != "").withColumn("_v", record_of(F.col("line")))
    field = lambda f: F.try_variant_get("_v", f"$.{f}", "string")
    kind = lambda f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
    rows = kept.withColumn("record", F.from_json(F.when(F.col("_v").isNotNull(), F.col("line")), RECORD)).withColumn("_keys", F.when(F.col("_v").isNotNull(), F.json_object_keys("line")))
    missing = [F.when(~F.array_contains("_keys", f), f"missing:{f}") for f in REQUIRED]
    is_list = {f: F.coalesce(kind(f).startswith("ARRAY"), F.lit(False)) for f in ("gold_doc_ids", "gold_citations")}
    is_text = lambda f: F.coalesce(kind(f) == "STRING", F.lit(False))
    wrong = [
        F.when(~is_list["gold_doc_ids"], "list:gold_doc_ids").when((F.size("record.gold_doc_ids") == 0) & ~F.equal_null(field("difficulty"), F.lit("no_answer")), "empty:gold_doc_ids"),
        F.when(~is_list["gold_citations"], "list:gold_citations"),
        F.when(~F.coalesce(field("difficulty").isin(*DIFFICULTIES), F.lit(False)), "invalid:difficulty"),
        F.when(~is_text("id") | (F.trim(field("id")) == ""), "empty:id"),
        *[F.when(~is_text(f) | (F.length(field(f)) < LEAST_CHARS), f"short:{f}") for f in ("question", "answer")],
    ]
    absent = F.array_compact(F.array(*missing))
    errors = F.when(F.col("_v").isNull(), F.array(F.lit("parse"))).when(F.size(absent) > 0, absent).otherwise(F.array_compact(F.array(*wrong)))
    return rows.withColumn("errors", errors).drop("_v", "_keys")


def file_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("file_name").agg(F.count_if(F.size("errors") == 0).alias("valid_rows"), F.count_if(F.size("errors") > 0).alias("error_rows"))


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).select("file_name", "line_no", "record.*")


def merged(rows: DataFrame) -> DataFrame:
    """The first row of each id, by file and line."""
    return first_per_key(rows, ["id"], ["file_name", "line_no"])


def missing_documents(rows: DataFrame, corpus_ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, missing): gold ids that are not among corpus_ids(doc_id), per row that has any."""
    gold = rows.select(key, F.explode("gold_doc_ids").alias("doc_id"))
    return gold.join(corpus_ids.select("doc_id").distinct(), "doc_id", "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("doc_id")).alias("missing"))


def citations(rows: DataFrame, articles: DataFrame, key: str = "id") -> DataFrame:
    """(key, citations): the citation keys of each row's gold_citations or, where it lists none, of its
    gold documents that are in articles(doc_id, kanun_short, madde_no); sorted, empty if there are
    neither. key unique."""
    law = F.concat(T.tr_lower(F.trim("kanun_short")), F.lit("|"), F.lower(F.trim("madde_no")))
    gold = rows.where(F.size(T.citation_keys(F.col("gold_citations"))) == 0).select(key, F.explode("gold_doc_ids").alias("doc_id"))
    derived = gold.join(articles.select("doc_id", law.alias("_c")), "doc_id").groupBy(key).agg(F.collect_set("_c").alias("_derived"))
    listed = T.citation_keys(F.col("gold_citations"))
    return rows.join(derived, key, "left").select(key, F.array_sort(F.when(F.size(listed) > 0, listed).otherwise(F.coalesce("_derived", F.array().cast("array<string>")))).alias("citations"))


def splittable(rows: DataFrame, corpus_ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a gold id in the corpus, or of difficulty no_answer; key unique."""
    found = rows.select(key, F.explode("gold_doc_ids").alias("doc_id")).join(corpus_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(key).distinct().withColumn("_found", F.lit(True))
    return rows.join(found, key, "left").where(F.col("_found") | (F.col("difficulty") == "no_answer")).drop("_found")


def split(rows: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    return stratified_split(rows, "difficulty", F.col("id"), ratio, 5, seed)


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of each of the columns, the commonest first."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count("*").alias("n")).orderBy("field", F.desc("n"), "value")


def report(checked: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """One row of counts over the merge."""
    rows = valid(checked)
    unique = merged(rows)
    question = T.tr_lower(F.trim(F.col("question")))
    one = checked.agg(F.count_if(F.size("errors") == 0).alias("total_raw"), F.count_if(F.size("errors") > 0).alias("total_errors"))
    parts = [
        unique.agg(F.count("*").alias("unique_by_id")),
        rows.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_ids")),
        rows.groupBy(question.alias("q")).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_questions")),
        missing_documents(unique, corpus_ids).agg(F.count("*").alias("rows_with_missing_doc_ids")),
        splittable(unique, corpus_ids).agg(F.count("*").alias("splittable")),
    ]
    out = one.withColumn("_one", F.lit(1))
    for p in parts:
        out = out.join(F.broadcast(p.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")
