"""Articles: keys, law codes, duplicates, counts, and segmentation of law texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order columns, which should make it unique. A task sends no
    more than one row per key, so a key of many copies is no single task's; the result is
    partitioned by the keys."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(window)).where("_first = 1").drop("_first")


def corpus(madde: DataFrame) -> DataFrame:
    """The articles to search: the first loaded row of each doc_id."""
    return first_per_key(madde, ["doc_id"], ["loaded_at", "row_id"])


def repeated(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """(name, copies) of the values that occur more than once."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("copies")).where("copies > 1")


def with_law_codes(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """Law code by law number, from laws(kanun_no, short_name), and the doc_id's prefix with it; a
    null or unknown number keeps the code. Adds normalised: whether the number was known."""
    known = laws.select(F.col("kanun_no").alias("_no"), F.col("short_name").alias("_code")).where("_no is not null")
    joined = articles.join(known, articles["kanun_no"] == F.col("_no"), "left")
    old = F.col("kanun_short")
    moved = (old != "") & F.col("_code").isNotNull() & F.startswith("doc_id", F.concat(old, F.lit("_")))
    doc_id = F.when(moved, F.concat("_code", F.substr("doc_id", F.length(old) + 1))).otherwise(F.col("doc_id"))
    return joined.withColumn("doc_id", doc_id).withColumn("normalised", F.col("_code").isNotNull()).withColumn("kanun_short", F.coalesce("_code", old)).drop("_no", "_code")


def segment(laws: DataFrame, key: str, text: str, kind=T.article_kind) -> DataFrame:
    """(key, pos, madde_no, madde_type, baslik, metin, fikralar) of the articles in each text, in
    order. The text is cleaned, cut where a line begins with an article marker, each article ends
    before the next; tables after its end are cut off. Text before the first marker, texts without
    one, and articles without a body give no row; null texts neither."""
    cleaned = laws.select(key, T.clean_text(F.col(text)).alias("_text")).where("_text is not null")
    parts = F.split(F.regexp_replace("_text", T.ARTICLE_START, "\x1e$1"), "\x1e")
    cut = cleaned.select(key, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).alias("pos", "_part"))

    def article(part: Column) -> Column:
        marker, number = (F.regexp_extract(part, T.ARTICLE_MARKER, i) for i in (1, 2))
        body = T.trim_tail(F.trim(F.regexp_replace(part, T.ARTICLE_MARKER, ""), F.lit(" \n")))
        return F.struct(kind(marker).alias("kind"), number.alias("number"), T.heading_and_body(body).alias("hb"))

    # read in one expression, lest the steps are computed again for each column that uses them
    rows = cut.select(key, "pos", F.explode(F.array(article(F.col("_part")))).alias("_a")).where("_a.hb.body <> ''")
    return rows.select(
        key, "pos", T.number_label(F.col("_a.kind"), F.col("_a.number")).alias("madde_no"), F.col("_a.kind").alias("madde_type"),
        F.col("_a.hb.heading").alias("baslik"), F.col("_a.hb.body").alias("metin"), T.paragraphs(F.col("_a.hb.body")).alias("fikralar"),
    )


def render(articles: DataFrame) -> Column:
    """An article as a law text prints it, the inverse of segment for one article."""
    kind = F.when(F.col("madde_type") == "gecici", "Geçici Madde ").when(F.col("madde_type") == "ek", "Ek Madde ").otherwise("Madde ")
    return F.concat(kind, F.regexp_extract("madde_no", r"(\d+)", 1), F.lit(" – "), F.when(F.col("baslik") != "", F.concat("baslik", F.lit("\n"))).otherwise(F.lit("")), F.col("metin"))
