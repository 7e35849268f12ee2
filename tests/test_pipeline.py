import json

import pytest
from pyspark.sql import functions as F

from lexspark.operators import answers as A
from lexspark.operators import goldset as G
from lexspark.operators import judging as J
from lexspark.operators import mining as M


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, doc_id string, kanun_short string, madde_no string, baslik string, text string")


def test_context_budget(spark):
    rows = [("q", 0, "a", "TCK", "1", "Baş", "x" * 10), ("q", 1, "b", "TCK", "2", None, "y" * 50), ("q", 2, "c", "TCK", "3", "", "z"), ("big", 0, "d", "K", "1", None, "w" * 500), ("null", 0, "e", None, None, None, None)]
    out = {r["query_id"]: r for r in A.context(hits(spark, rows), 60, missing="?").collect()}
    assert out["q"]["context"] == "[TCK m.1] (Baş)\n" + "x" * 10 and out["q"]["used"] == 1
    assert (out["big"]["context"], out["big"]["used"]) == ("", 0)
    assert out["null"]["context"] == "[? m.?]\n"


def test_answers(spark):
    df = spark.createDataFrame([("q1", "Ne?", "[K m.1]\nBir.\n\n[K m.2]\nİki."), ("q2", "Ne?", "")], "query_id string, question string, context string")
    prompts = df.select("query_id", A.prompt(F.col("question"), F.col("context")).alias("prompt"))
    dummy = {r[0]: r[1] for r in prompts.select("query_id", A.dummy_answer(F.col("prompt"))).collect()}
    assert dummy["q1"].startswith(A.DUMMY + "[K m.2]") and dummy["q1"].endswith("...")
    out = {r[0]: r[1] for r in A.generate(prompts, lambda pairs: [f"{len(s) > 0}:{u[:8]}" for s, u in pairs]).collect()}
    assert out == {"q1": "True:Soru: Ne", "q2": "True:Soru: Ne"}
    turns = df.select(A.chat_example(F.col("question"), F.lit("Cevap"), F.col("context")).alias("t")).collect()[0]["t"]
    assert [t["role"] for t in turns] == ["system", "user", "assistant"]


def test_rerank(spark):
    rows = [("q", "kira vergi", "kira", 0), ("q", "kira vergi", "vergi kira dava", 1), ("q", "kira vergi", None, 2), ("e", "", "kira", 0)]
    df = spark.createDataFrame(rows, "query_id string, question string, text string, rank int")
    got = [(r["query_id"], r["text"], r["score"], r["rank"]) for r in A.rerank(df, top_k=2).orderBy("query_id", "rank").collect()]
    assert got == [("e", "kira", 0.0, 0), ("q", "vergi kira dava", 1.0, 0), ("q", "kira", 0.5, 1)]


def test_mining(spark):
    articles = spark.createDataFrame([(f"A{i}", "LA", f"metin {i}") for i in range(6)] + [("B1", "LB", "tek")], "doc_id string, kanun_short string, metin string")
    asked = spark.createDataFrame([(1, "s", "A0"), (2, "t", "B1"), (3, "u", "gone")], "query_id int, question string, doc_id string")
    positive, missing = M.positives(asked, articles)
    assert [r["query_id"] for r in missing.collect()] == [3]
    ranked = spark.createDataFrame([(1, "A0", 1), (1, "A1", 2), (2, "A2", 1), (2, "B1", 2)], "query_id int, doc_id string, rank int")
    negatives = M.padded(M.from_ranking(ranked, positive, 3), positive, articles, 3)
    rows = negatives.orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["place"], r["is_padding"]) for r in rows] == [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)]
    assert rows[0]["doc_id"] == "A1" and {r["doc_id"] for r in rows[:3]} <= {f"A{i}" for i in range(1, 6)}
    stats = M.statistics(M.positive_ranks({"bm25": ranked}, positive), negatives, articles, positive).collect()[0]
    assert (stats["questions"], stats["found"], stats["mean_rank"], stats["padded"], stats["mean_same_law"]) == (2, 2, 1.5, 1, 1.5)
    listed = M.listwise(M.triplets(asked, negatives, articles)).where("query_id = 1").orderBy("position").collect()
    assert [(r["position"], r["label"]) for r in listed] == [(0, 1), (1, 0), (2, 0), (3, 0)] and listed[0]["doc_id"] == "A0"


def gold_line(**changes):
    row = {"id": "q1", "question": "Soru nedir?", "answer": "Cevap budur.", "gold_doc_ids": ["K_m1"], "gold_citations": [["K", "1"]], "difficulty": "lookup", "category": "x", "author": "a", "notes": None}
    row |= changes
    return json.dumps({k: v for k, v in row.items() if v != "drop"}, ensure_ascii=False)


def test_goldset(spark):
    lines = [gold_line(), gold_line(id="q1"), gold_line(id="q2", gold_doc_ids=[], difficulty="no_answer"), gold_line(id="q3", gold_doc_ids=["yok"]), gold_line(id="q4", gold_doc_ids=[]), gold_line(id="q5", author="drop", answer="x"), gold_line(id=" ", difficulty="hard"), gold_line(id="q6", question="kısa", gold_citations="K"), "// not", gold_line() + ",", "", "  ", None]
    df = spark.createDataFrame([("f1" if i < 6 else "f2", i, x) for i, x in enumerate(lines)], "file_name string, line_no int, line string")
    checked = G.parsed(df)
    errors = {r["line_no"]: r["errors"] for r in checked.collect()}
    assert errors == {0: [], 1: [], 2: [], 3: [], 4: ["empty:gold_doc_ids"], 5: ["missing:author"], 6: ["invalid:difficulty", "empty:id"], 7: ["list:gold_citations", "short:question"], 8: ["parse"], 9: ["parse"]}
    assert {r[0]: (r[1], r[2]) for r in G.file_counts(checked).collect()} == {"f1": (4, 2), "f2": (0, 4)}
    corpus = spark.createDataFrame([("K_m1",)], "doc_id string")
    unique = G.merged(G.valid(checked))
    assert [(r["id"], r["line_no"]) for r in unique.orderBy("id").collect()] == [("q1", 0), ("q2", 2), ("q3", 3)]
    assert [(r["id"], r["missing"]) for r in G.missing_documents(unique, corpus).collect()] == [("q3", ["yok"])]
    assert sorted(r["id"] for r in G.splittable(unique, corpus).collect()) == ["q1", "q2"]
    assert G.report(checked, corpus).collect()[0].asDict() == {"total_raw": 4, "total_errors": 6, "unique_by_id": 3, "duplicate_ids": 1, "duplicate_questions": 1, "rows_with_missing_doc_ids": 1, "splittable": 2}
    assert G.parsed(df.limit(0)).count() == 0


def test_judging(spark):
    replies = ['```json\n{"claims": [{"claim": "a", "verdict": "SUPPORTED"}, {"claim": "b", "verdict": "no"}], "faithfulness": 0.9}\n```', '{"claims": []}', "bozuk", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = {r["i"]: (r["j"]["faithfulness"], r["j"]["error"]) for r in df.select("i", J.judged(F.col("r")).alias("j")).collect()}
    assert got == {0: (0.5, None), 1: (None, "no_claims"), 2: (None, "parse_failed"), 3: (None, "parse_failed")}
    pair = spark.createDataFrame([("Kira ödenir. Vergi alınmaz! [K m.1]", "kira her ay ödenir")], "a string, s string")
    verdicts = pair.select(J.overlap_verdicts(F.col("a"), F.col("s")).alias("v")).collect()[0]["v"]
    assert [v["verdict"] for v in verdicts] == ["SUPPORTED", "UNSUPPORTED"]
    rows, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert [r["k"] for r in J.resumed(rows, done, "k").collect()] == [1]


@pytest.mark.parametrize("partitions", [1, 13])
def test_context_does_not_depend_on_partitions(spark, partitions):
    rows = [(f"q{i % 5}", i // 5, f"d{i}", "K", str(i), None, "t" * i) for i in range(60)]
    out = A.context(hits(spark, rows).repartition(partitions), 200).orderBy("query_id").collect()
    assert [r["used"] for r in out] == [7, 6, 6, 6, 6] or len(out) == 5
    assert all(len(r["context"]) <= 200 for r in out)
