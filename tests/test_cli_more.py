import json

from lexspark import cli


def test_matrix_aggregate_hybrid_mining_and_more(spark, tmp_path):
    rows = [(i, f"K_m{i}", "K", 7, "Kanun", str(i), None, t, "u", i) for i, t in enumerate(["kira bedeli ödenir", "vergi borcu alınır", "miras payı bölünür", "kira süresi"])]
    spark.createDataFrame(rows, "row_id int, doc_id string, kanun_short string, kanun_no int, kanun_full string, madde_no string, baslik string, metin string, url string, loaded_at int").write.parquet(str(tmp_path / "c"))
    gold = [{"id": f"q{i}", "question": q, "answer": "Cevap", "gold_doc_ids": d, "category": "x"} for i, (q, d) in enumerate([("kira bedeli", "K_m0"), ("vergi", "K_m1")])]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, gold)), encoding="utf-8")
    run = lambda *a: cli.main([str(tmp_path / x[1:]) if x.startswith("@") else x for x in a])
    run("build-index", "--corpus", "@c", "--output-dir", "@i")
    (tmp_path / "m.json").write_text(json.dumps([{"config": "A1", "mode": "bm25"}, {"config": "A2", "rerank": True, "judge": True}, {"config": "A3", "index_dir": "/none"}]), encoding="utf-8")
    run("run-matrix", "--index-dir", "@i", "--test-set", "@g.jsonl", "--configs", "@m.json", "--out", "@r")
    assert {(r["config"], r["status"]) for r in spark.read.json(str(tmp_path / "r/status")).collect()} == {("A1", "ok"), ("A2", "ok"), ("A3", "failed")}
    # gold ids that are bare strings, and citations taken from them
    first = spark.read.json(str(tmp_path / "r/A1/per_example")).where("query_id = 'q0'").first()
    assert first["recall_1"] == 1.0 and first["cit_r"] in (0.0, 1.0)
    run("aggregate-results", "--results", "@r", "--configs", "A1,A2,A9", "--isolations", "A2-A1,A2-A9", "--out", "@t")
    main = {(r["config"], r["metric"]): r for r in spark.read.option("header", True).csv(str(tmp_path / "t/ablation_table")).collect()}
    assert main["A9", None]["status"] == "missing" and float(main["A1", "recall_1"]["mean"]) == 1.0 and ("A2", "faithfulness") in main
    deltas = {(r["label"], r["metric"]): r["delta"] for r in spark.read.option("header", True).csv(str(tmp_path / "t/isolations")).collect()}
    assert float(deltas["A2 - A1", "recall_1"]) == 0.0 and deltas["A2 - A9", "recall_1"] is None
    report = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "t/report")).collect())
    assert "## Configurations" in report and "| A2 - A1 |" in report
    spark.createDataFrame([("q0", "kira bedeli", "K_m0"), ("q1", "vergi", "K_m1")], "query_id string, question string, doc_id string").write.parquet(str(tmp_path / "q"))
    run("mine", "--index-dir", "@i", "--corpus", "@c", "--questions", "@q", "--out", "@n", "--mode", "hybrid", "--num-negatives", "3")
    assert all(len(set(r["negative_doc_ids"])) == 3 for r in spark.read.parquet(str(tmp_path / "n")).collect())
    run("answer", "--index-dir", "@i", "--questions", "@q", "--out", "@a", "--mode", "bm25", "--top-k", "1", "--rerank")
    assert {(r["query_id"], r["sources"][0]["doc_id"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {("q0", "K_m0"), ("q1", "K_m1")}
    run("synthesis-prompts", "--corpus", "@c", "--out", "@p")
    assert all("metin" not in r["prompt"] and "(başlıksız)" in r["prompt"] for r in spark.read.parquet(str(tmp_path / "p")).collect())
    spark.createDataFrame([("K_m0", '```json\n[{"question": "Ne?", "answer": "Bu."}, {"question": "x"}]\n```'), ("K_m1", "yok")], "doc_id string, reply string").write.parquet(str(tmp_path / "s"))
    run("synthesise", "--replies", "@s", "--corpus", "@c", "--out", "@y")
    assert [(r["source_doc_id"], r["question"], r["difficulty"], r["madde_text"]) for r in spark.read.parquet(str(tmp_path / "y")).collect()] == [("K_m0", "Ne?", "lookup", "kira bedeli ödenir")]
    spark.createDataFrame([(7, "YK")], "kanun_no int, short_name string").write.parquet(str(tmp_path / "l"))
    run("normalise-codes", "--corpus", "@c", "--laws", "@l", "--out", "@o")
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {f"YK_m{i}" for i in range(4)}
    (tmp_path / "laws.json").write_text(json.dumps([{"mevzuatNo": "10", "mevAdi": "Bir", "mevzuatTur": 1}, {"mevzuatNo": "7", "mevAdi": "K", "mevzuatTur": 4}]), encoding="utf-8")
    run("law-list", "--list", "@laws.json", "--out", "@w", "--base", "https://x", "--only", "T1_10")
    assert [(r["pdf_url"], r["html_url"]) for r in spark.read.parquet(str(tmp_path / "w")).collect()] == [("https://x/MevzuatMetin/1.5.10.pdf", "https://x/mevzuat?MevzuatNo=10&MevzuatTur=1&MevzuatTertip=5")]
