import json

import pytest
from pyspark.sql import functions as F

from lexspark.operators.search import Retriever
from lexspark.sources import files, web
from lexspark.streaming.questions import answer_stream


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\nbad\n', encoding="utf-8")
    assert sorted(r["a"] for r in files.json_lines(spark, str(path), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        files.json_lines(spark, str(path), "a int", strict=True).collect()
    for name in ("dev_a.jsonl", "dev_full.jsonl"):
        (tmp_path / name).write_text("one\r\ntwo\n", encoding="utf-8")
    rows = files.lines_with_numbers(spark, str(tmp_path / "dev_*.jsonl")).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [("dev_a.jsonl", 1, "one"), ("dev_a.jsonl", 2, "two"), ("dev_a.jsonl", 3, "")]
    found = files.preferred(spark, [str(tmp_path / "none"), str(path)], lambda p: files.json_lines(spark, p, "a int"))
    assert found.count() == 2 and files.preferred(spark, [str(tmp_path / "none")], spark.read.text) is None


def test_law_list_and_addresses(spark, tmp_path):
    path = tmp_path / "laws.json"
    path.write_text(json.dumps([{"mevzuatNo": "10", "mevAdi": " Bir Kanun ", "mevzuatTertip": "5", "mevzuatTur": 1}, {"mevzuatNo": "x", "mevAdi": "y", "mevzuatTur": 4}, {"mevzuatNo": "7", "mevAdi": "K", "mevzuatTur": 4}]), encoding="utf-8")
    laws = files.law_list(spark, str(path)).orderBy("kanun_no")
    assert [tuple(r) for r in laws.collect()] == [(7, 4, 5, "T4_7", "K"), (10, 1, 5, "T1_10", "Bir Kanun")]
    assert [r[0] for r in laws.select(files.law_type(F.col("type"))).collect()] == ["KHK", "Kanun"]
    assert spark.range(1).select(files.law_type(F.lit(99))).collect()[0][0] == "Bilinmiyor"
    assert files.addresses(laws).first()["pdf_url"].endswith("/pdf/4.5.7.pdf")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    files.write_json_lines(df, str(tmp_path / "j"))
    files.write_json_lines(df, str(tmp_path / "j"), "append")
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    files.write_document(df, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).first()[0])[0]["n"] == 1
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("t = 'a,b'").count() == 1


def test_paged_source(spark):
    def page(url, body):
        if body["length"] > 60 and body["start"] == 200:
            raise OSError("too large")
        return {"total": 430, "data": [{"no": i} for i in range(body["start"], min(430, body["start"] + body["length"]))]}

    class Fake(web.PagedSource):
        fetch = staticmethod(page)

    spark.dataSource.register(Fake)
    df = spark.read.format("paged").option("url", "http://x").option("pause", 0).load()
    assert sorted(json.loads(r[0])["no"] for r in df.collect()) == list(range(430))


def test_files(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("a",)], "url string")
    got = {r["url"]: r["content"] for r in web.files(urls, lambda u: b"x" if u == "a" else None, 2, 0).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {"a": b"x", "b": None}


def test_question_stream(spark, tmp_path):
    rows = [(f"D{i}", "K", "Kanun", str(i), None, t, "u") for i, t in enumerate(["kira bedeli", "vergi borcu", "miras payı"])]
    retriever = Retriever.build(spark.createDataFrame(rows, "doc_id string, kanun_short string, kanun_full string, madde_no string, baslik string, metin string, url string"))
    asked = tmp_path / "q"
    asked.mkdir()
    for i, text in enumerate(["kira", "vergi"]):
        (asked / f"{i}.json").write_text(json.dumps({"query_id": f"q{i}", "question": text}) + "\n", encoding="utf-8")
        answer_stream(spark, str(asked), str(tmp_path / "out"), str(tmp_path / "state"), retriever, 1, "bm25").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("query_id").collect()
    assert [(r["query_id"], r["doc_id"]) for r in out] == [("q0", "D0"), ("q1", "D1")]
