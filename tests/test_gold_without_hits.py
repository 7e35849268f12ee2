import __spark_entry__ as entry


def test_gold_questions_without_hits_score_zero(spark, tmp_path):
    columns = "row_id long, id string, question string, gold_doc_ids array<string>, category string"
    dev = [(1, "q1", "kira bedeli", ["a"], "x"), (2, "q2", "vergi", ["b"], "x"), (3, "q3", "miras", ["c"], None)]
    full = [(1, "q4", "dava", ["a", "b"], "y"), (2, "q1", "başka", ["z"], "y")]
    hits = [(1, "q1", "b", 1.0, "kira", 0), (2, "q1", "a", 2.0, "kira bedeli", 1), (3, "q4", "a", 1.0, "dava", 0), (4, "none", "a", 1.0, "dava", 0)]
    spark.createDataFrame(dev, columns).write.parquet(str(tmp_path / "dev_omer.parquet"))
    spark.createDataFrame(full, columns).write.parquet(str(tmp_path / "test_full.parquet"))
    spark.createDataFrame(hits, "hit_id long, question_id string, doc_id string, score double, text string, rank int").write.parquet(str(tmp_path / "hit.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()

    # q2 (category x) and q3 (no category) have no hit; q1 has its document second in the order "first" only
    recall = {"q1": 1.0, "q2": 0.0, "q3": 0.0, "q4": 0.5}
    mrr = {c: {"q1": 0.5 if c == "first" else 1.0, "q2": 0.0, "q3": 0.0, "q4": 1.0} for c in ("first", "score", "overlap")}
    want = {(c, q, m): v for c in mrr for m, values in (("recall_5", recall), ("mrr_10", mrr[c])) for q, v in values.items()}
    assert {(r["config"], r["query_id"], r["metric"]): r["value"] for r in run("hit_metrics")} == want
    means = {(r["config"], r["metric"]): (r["mean"], r["n"], r["status"]) for r in run("ablation_table")}
    assert means == {("first", "recall_5"): (0.375, 4, "ok"), ("first", "mrr_10"): (0.375, 4, "ok"), **{(c, m): (v, 4, "ok") for c in ("score", "overlap") for m, v in (("recall_5", 0.375), ("mrr_10", 0.5))}, ("absent", None): (None, 0, "missing")}
    table = {(r["category"], r["metric"]): (r["mean"], r["n"]) for r in run("category_table") if r["config"] == "first"}
    assert table == {("x", "recall_5"): (0.5, 2), ("x", "mrr_10"): (0.25, 2), ("y", "recall_5"): (0.5, 1), ("y", "mrr_10"): (1.0, 1), ("unknown", "recall_5"): (0.0, 1), ("unknown", "mrr_10"): (0.0, 1), (None, "recall_5"): (0.375, 4), (None, "mrr_10"): (0.375, 4)}
    assert {r["category"]: (r["first"], r["score"], r["overlap"]) for r in run("category_pivot")} == {"x": (0.5, 0.5, 0.5), "y": (0.5, 0.5, 0.5), "unknown": (0.0, 0.0, 0.0)}
    deltas = {(r["label"], r["metric"]): r["delta"] for r in run("isolation_deltas")}
    assert deltas == {("reranking", "recall_5"): 0.0, ("reranking", "mrr_10"): 0.125, ("sorting", "recall_5"): 0.0, ("sorting", "mrr_10"): 0.125, ("missing", "recall_5"): None, ("missing", "mrr_10"): None}
