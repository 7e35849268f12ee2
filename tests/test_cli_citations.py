import json

from lexspark import cli


def test_run_eval_scores_citations_and_questions_without_hits(spark, tmp_path):
    rows = [(i, f"D{i}", "K", "Kanun", str(i), None, t, "u", i) for i, t in enumerate(["kira bedeli", "vergi borcu", "miras payı", "kira süresi"])]
    spark.createDataFrame(rows, "row_id int, doc_id string, kanun_short string, kanun_full string, madde_no string, baslik string, metin string, url string, loaded_at int").write.parquet(str(tmp_path / "c"))
    asked = [("q0", "kira", [["K", "0"], ["K", "3"]]), ("q1", "zzz", [["K", "1"]])]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps({"id": i, "question": q, "answer": "Cevap", "gold_doc_ids": ["D0"], "gold_citations": c, "category": "x"}) for i, q, c in asked), encoding="utf-8")
    cli.main(["build-index", "--corpus", str(tmp_path / "c"), "--output-dir", str(tmp_path / "i"), "--skip-dense"])
    cli.main(["run-eval", "--index-dir", str(tmp_path / "i"), "--test-set", str(tmp_path / "g.jsonl"), "--out", str(tmp_path / "e"), "--mode", "bm25"])
    got = {r["query_id"]: r for r in spark.read.json(str(tmp_path / "e/per_example")).collect()}
    # the dummy answer to q0 cites the second of the two articles found; q1 finds none and is answered all the same
    assert [(r["cit_p"], r["cit_r"], r["cit_f1"]) for r in (got["q0"], got["q1"])] == [(1.0, 0.5, 0.666667), (0.0, 0.0, 0.0)]
    assert got["q1"]["em"] == 0.0 and got["q1"]["f1"] is not None and got["q1"]["recall_1"] == 0.0
    summary = {(r["metric"], r["category"]): (float(r["mean"]), int(r["n"])) for r in spark.read.option("header", True).csv(str(tmp_path / "e/summary")).collect()}
    assert summary["cit_r", "x"] == (0.25, 2) and summary["em", "x"] == (0.0, 2)
