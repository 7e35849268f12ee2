"""Readers and writers of JSON lines, JSON documents, CSV and indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAW_LIST = "mevzuatNo STRING, mevAdi STRING, kabulTarih STRING, resmiGazeteTarihi STRING, resmiGazeteSayisi STRING, mevzuatTertip STRING, mevzuatTur INT, mevzuatTurEnumString STRING, url STRING"
# Type codes of legislation and their names.
LAW_TYPES = {1: "Kanun", 2: "Cumhurbaşkanlığı Kararnamesi", 3: "Yönetmelik", 4: "KHK", 5: "Tüzük", 7: "Yönetmelik (Bakanlık)"}
MOST_FILE_BYTES, MOST_ROWS = 1 << 26, 100_000  # of a file that is read, and a document that is written, by one task
ADDRESS = "https://mevzuat.example/MevzuatMetin/{kind}/{type}.{edition}.{number}.{ending}"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines. strict raises at a bad line; else bad lines are dropped. Blank lines never count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def lines_with_numbers(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("dev_full.jsonl", "test_full.jsonl")) -> DataFrame:
    """(file_name, line_no, line) of the files of a glob, line numbers from 1. A file is read whole,
    as only so its lines have numbers; one above MOST_FILE_BYTES is an error."""
    large = F.raise_error(F.concat(F.col("_metadata.file_name"), F.lit(" is too large to be read whole")))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.when(F.col("_metadata.file_size") > MOST_FILE_BYTES, large).otherwise(F.col("value")).alias("text"))
    return files.where(~F.col("file_name").isin(*exclude)).select("file_name", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def preferred(spark: SparkSession, candidates: list[str], reader: Callable[[str], DataFrame]) -> DataFrame | None:
    """What the reader makes of the first path that exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in candidates:
        p = hadoop(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return reader(path)
    return None


def law_list(spark: SparkSession, path: str) -> DataFrame:
    """(kanun_no, type, edition, short_name, full_name) of a JSON array of laws: numbers that are no
    integers are dropped, edition 5 and a name from type and number are the defaults."""
    raw = spark.read.schema(LAW_LIST).option("multiLine", True).json(path)
    number = F.col("mevzuatNo").try_cast("int")
    return raw.where(number.isNotNull()).select(
        number.alias("kanun_no"), F.col("mevzuatTur").alias("type"), F.coalesce(F.col("mevzuatTertip").try_cast("int"), F.lit(5)).alias("edition"),
        F.concat(F.lit("T"), F.col("mevzuatTur").cast("string"), F.lit("_"), number.cast("string")).alias("short_name"), F.trim("mevAdi").alias("full_name"),
    )


def law_type(code: Column) -> Column:
    """The name of a type code, Bilinmiyor if there is none."""
    names = F.create_map(*[F.lit(x) for pair in LAW_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit("Bilinmiyor"))


def addresses(laws: DataFrame, base: str | None = None) -> DataFrame:
    """laws(kanun_no, type, edition) with the addresses of their files: those of the site at base, or
    without one those of a made-up host, for tests."""

    def one(pattern: str) -> Column:
        return F.format_string(pattern, "type", "edition", "kanun_no")

    if base is None:
        parts = {k: ADDRESS.format(kind=k, type="%d", edition="%d", number="%d", ending=k) for k in ("pdf", "docx", "html")}
        return laws.withColumns({f"{k}_url": one(p) for k, p in parts.items()})
    page = F.format_string(base.replace("%", "%%") + "/mevzuat?MevzuatNo=%d&MevzuatTur=%d&MevzuatTertip=%d", "kanun_no", "type", "edition")
    return laws.withColumns({f"{k}_url": one(base.replace("%", "%%") + "/MevzuatMetin/%d.%d.%d." + k) for k in ("pdf", "docx")} | {"html_url": page})


def named(laws: DataFrame, names: list[str]) -> DataFrame:
    """The laws of these short names, all without any names."""
    return laws.where(F.col("short_name").isin(*names)) if names else laws


def binary_texts(spark: SparkSession, path: str, extract: Callable[[bytes], str | None], glob: str = "*") -> DataFrame:
    """(path, text) of the files of a folder by an extractor from bytes to text, such as a PDF library's;
    it is sent to the tasks, and a file that it fails on has a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content in batch.column(1).to_pylist():
                try:
                    texts.append(extract(content))
                except Exception:  # noqa: BLE001 whatever a library raises on a broken file
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string")


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; append adds to what is there, ignore leaves it."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A small table as one JSON array; one of more than MOST_ROWS is an error, write_json_lines has no
    limit."""
    if df.count() > MOST_ROWS:
        raise ValueError(f"a document of more than {MOST_ROWS} rows; write JSON lines")
    whole = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
