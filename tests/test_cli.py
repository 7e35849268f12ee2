import json

from lexspark import cli


def test_index_search_eval_and_mine(spark, tmp_path):
    rows = [(i, f"D{i}", "K", "Kanun", str(i), None, t, "u", i) for i, t in enumerate(["kira bedeli ödenir", "vergi borcu alınır", "miras payı bölünür", "kira süresi"])]
    spark.createDataFrame(rows, "row_id int, doc_id string, kanun_short string, kanun_full string, madde_no string, baslik string, metin string, url string, loaded_at int").write.parquet(str(tmp_path / "c"))
    gold = [{"id": f"q{i}", "question": q, "answer": "Cevap", "gold_doc_ids": [d], "gold_citations": [["K", "1"]], "category": "x"} for i, (q, d) in enumerate([("kira bedeli", "D0"), ("vergi", "D1")])]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, gold)), encoding="utf-8")
    spark.createDataFrame([("q0", "kira bedeli", "D0"), ("q1", "vergi", "D1")], "query_id string, question string, doc_id string").write.parquet(str(tmp_path / "q"))
    run = lambda *a: cli.main([str(tmp_path / x[1:]) if x.startswith("@") else x for x in a])
    run("build-index", "--corpus", "@c", "--output-dir", "@i")
    run("search", "--index-dir", "@i", "--questions", "@q", "--out", "@h", "--mode", "bm25", "--top-k", "1")
    assert {(r["query_id"], r["doc_id"]) for r in spark.read.parquet(str(tmp_path / "h")).collect()} == {("q0", "D0"), ("q1", "D1")}
    run("run-eval", "--index-dir", "@i", "--test-set", "@g.jsonl", "--out", "@e", "--mode", "bm25", "--rerank")
    summary = {(r["metric"], r["category"]): r["mean"] for r in spark.read.option("header", True).csv(str(tmp_path / "e/summary")).collect()}
    assert float(summary["recall_1", "x"]) == 1.0 and float(summary["mrr_10", None]) == 1.0
    run("mine", "--index-dir", "@i", "--corpus", "@c", "--questions", "@q", "--out", "@m", "--num-negatives", "2")
    assert all(len(r["negatives"]) == 2 for r in spark.read.parquet(str(tmp_path / "m")).collect())


def test_judge_resumes(spark, tmp_path):
    spark.createDataFrame([(1, '{"claims": [{"verdict": "PARTIAL"}]}'), (2, "x")], "id int, reply string").write.parquet(str(tmp_path / "r"))
    for _ in range(2):
        cli.main(["judge", "--replies", str(tmp_path / "r"), "--out", str(tmp_path / "o")])
    assert {(r["id"], r["faithfulness"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {(1, 0.5), (2, None)}
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
