"""Nulls in any column, empty tables, repeated rows and extra columns with the names that operators use."""

import os

import pytest

from lexspark.llm import bpe, characters, languages, leaks, overlaps, packing, pairs, repeats, scans, split
from pyspark.sql import functions as F

CLASHES = ("_text", "_n", "_h", "_b", "_salt", "_row", "_block", "word", "words", "doc", "salt", "id", "key", "keys", "hashes", "scope", "value", "label", "h", "t", "piece", "container", "passage", "last", "n", "kind", "fixes", "rare", "right", "src", "pos")


def clashing(df):
    """df with columns of the names that the operators give their own."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_split(spark):
    long = "söz " * 1000
    df = spark.createDataFrame([(1, long), (None, long), (1, long), (2, None), (None, None), (3, "")], "row_id bigint, text string")
    plain = split.split_items(df, ["row_id"])
    assert rows_of(plain) == rows_of(split.split_items(clashing(df), ["row_id"]))
    each = plain.where("row_id = 3").count()
    assert each == 1 and plain.where("row_id is null").count() * 2 == plain.where("row_id = 1").count()


def test_overlaps(spark):
    e = spark.createDataFrame([("dev", 1, "aynı soru", None), ("dev", 1, "aynı soru", None), (None, None, "Aynı soru?", ["D", None]), ("dev", 3, None, None)], "split string, eval_id bigint, question string, gold_doc_ids array<string>")
    t = spark.createDataFrame([(1, "AYNI SORU", None), (None, "aynı soru", "D"), (3, None, "D"), (4, "", None)], "train_id bigint, question string, source_doc_id string")
    got = rows_of(overlaps.overlaps(e, t))
    assert got == rows_of(overlaps.overlaps(clashing(e), clashing(t)))
    assert len(got) == 5  # two equal rows with both, the bound one with D alone


def test_scans(spark):
    shared = "Kanun hükümleri uygulanır ve taraflar bildirimde bulunur. "
    text = shared * 8
    misread = {50: "uygu1anır", None: "tarafl4r", 62: "bi1dirimde"}  # each in no more texts than scans may have it
    rows = [(i, "metin", text, "A Kanunu") for i in range(20)] + [(50, "metin", text + misread[50], "A Kanunu")] * 2 + [(None, "metin", text + misread[None], None), (60, "baslik", None, None), (61, "metin", "", None), (62, None, text + misread[62], "A Kanunu")]
    df = spark.createDataFrame(rows, "row_id bigint, field string, text string, title string")
    noise, texts = scans.repair(clashing(df))
    assert {(r["row_id"], r["kind"]) for r in noise.collect()} == {(i, "misread") for i in misread}
    out = texts.collect()
    assert len(out) == len(rows) - 1
    assert not any(w in r["text"] for r in out for w in misread.values()) and [r["text"] for r in out if r["row_id"] == 61] == [""]


def test_leaks(spark):
    passage = "bir iki üç dört beş altı yedi sekiz"
    texts = spark.createDataFrame([("documents", 1, passage), ("documents", 1, passage), (None, None, "önce " + passage), ("documents", 2, None)], "src string, text_id bigint, text string")
    items = spark.createDataFrame([(7, passage, passage), (8, passage.upper().replace("İ", "i"), None), (9, None, "")], "row_id bigint, question string, answer string")
    got = rows_of(leaks.leaks(texts, items, "row_id", ["question", "answer"]))
    assert len(got) == 6
    assert got == rows_of(leaks.leaks(clashing(texts), clashing(items), "row_id", ["question", "answer"]))


def test_pairs(spark):
    df = spark.createDataFrame([(1, None, None), (None, "Soru nedir burada?", None), (2, "Soru nedir burada?", "Soru nedir burada?"), (2, "Soru nedir burada?", "Soru nedir burada?"), (3, None, "Evet.")], "qa_id bigint, question string, answer string")
    got = [(r["qa_id"], r["defect"]) for r in pairs.defects(clashing(df), {}).collect()]
    assert sorted(got, key=str) == [(1, "empty"), (2, "copies_question"), (2, "copies_question"), (None, "empty")]


def test_repeats(spark):
    df = spark.createDataFrame([(1, "a", "Soru"), (2, "A ", "soru?"), (3, None, None), (4, "", " "), (5, "a", None)], "n bigint, id string, question string")
    distinct, copies = repeats.collapse(clashing(df), "n", ["id", "question"])
    assert sorted(tuple(r) for r in distinct.collect()) == [(1, 2), (3, 2), (5, 1)]
    assert sorted(tuple(r) for r in copies.collect()) == [(1, 2), (3, 4)]


def test_characters(spark):
    df = spark.createDataFrame([(1, "ﬁil"), (None, "ﬁil"), (1, "ﬁil"), (2, None), (3, ""), (4, "ﬁ" * 100_000)], "row_id bigint, metin string")
    got = [r["row_id"] for r in characters.changed(clashing(df), "row_id", "metin", "madde").collect()]
    assert sorted(got, key=str) == [1, 1, 4, None]
    assert characters.changed(df.limit(0), "row_id", "metin", "madde").count() == 0


@pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no vocabulary here")
def test_encoding(spark):
    df = spark.createDataFrame([(1, "Madde"), (None, "Madde"), (1, "Madde"), (2, None), (3, "")], "doc_id bigint, text string")
    assert rows_of(bpe.token_ids(clashing(df))) == rows_of(bpe.token_ids(df)) and bpe.token_ids(df).where("size(ids) = 0").count() == 2


def test_containers(spark):
    df = spark.createDataFrame([(1, 10), (None, 10), (1, 10), (2, None), (3, 0), (None, None), (4, 5000)], "doc_id bigint, n_tokens bigint")
    out = packing.containers(clashing(df))
    assert out.agg(F.sum("n_tokens")).collect()[0][0] == 5030 and out.count() == 7
    assert out.groupBy("container").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0


def test_languages(spark):
    dictionaries = languages.train([("tr", "Kanun hükümleri uygulanır ve taraflar bildirimde bulunur. " * 3), ("en", "The parties give notice and the law applies to them. " * 3)] * 4)
    df = spark.createDataFrame([(1, "The parties give notice and the law applies.", None), (None, "Kanun hükümleri taraflara uygulanır ve bulunur.", "en"), (2, None, "tr"), (3, "", None), (4, "12 34", "tr")], "doc_id bigint, text string, lang string")
    got = {(r["doc_id"], r["state"], r["lang"]) for r in languages.languages(languages.segments(clashing(df), dictionaries)).collect()}
    assert got == {(1, "missing", "en"), (None, "wrong", "tr")}
    assert languages.languages(languages.segments(df.limit(0), dictionaries)).count() == 0
    assert languages.languages(languages.segments(df, languages.fit(df.limit(0), "doc_id", "text", "lang"))).count() == 0
