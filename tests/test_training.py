import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import evaluation as E
from lexspark.operators import goldset as G
from lexspark.operators import mining as M
from lexspark.operators import ranking as R
from lexspark.operators.pipeline import Pipeline
from lexspark.operators.search import Retriever
from lexspark.sources import files


def test_draws_reach_every_value_of_a_large_group(spark):
    pool = spark.createDataFrame([("hot", f"v{i:03d}") for i in range(300)] + [("one", "w"), (None, "z")], "g string, v string")
    asked = spark.createDataFrame([(i, "hot", 5) for i in range(400)] + [(900, "one", 5), (901, "none", 5), (902, None, 5), (903, "hot", 0), (904, "hot", 1000)], "q int, g string, wanted int")
    got = {}
    for r in R.draws(asked, pool, "q", "g", "v").collect():
        got.setdefault(r["q"], []).append((r["place"], r["v"]))
    assert {q: len(set(v)) for q, v in got.items()} == {**{i: 5 for i in range(400)}, 900: 1, 904: 300}
    assert len({v for q in range(400) for _, v in got[q]}) > 290


def test_padding_falls_back_to_the_corpus_and_pools(spark):
    articles = spark.createDataFrame([("A", None, "t"), ("B", "L", "t"), ("C", "L", "t"), ("D", "", "t")], "doc_id string, kanun_short string, metin string")
    asked = spark.createDataFrame([(1, "s", "A"), (2, "t", "B")], "query_id int, question string, doc_id string")
    positive, _ = M.positives(asked, articles)
    none = spark.createDataFrame([], "query_id int, doc_id string, place int")
    got = {}
    for r in M.padded(none, positive, articles, 3).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert got == {1: {"B", "C", "D"}, 2: {"C"}}
    negatives = spark.createDataFrame([(1, "B", 1), (2, "A", 1), (2, "C", 2)], "query_id int, doc_id string, place int")
    pools = {(r["query_id"], r["doc_id"]): r["relevant"] for r in M.gate_pools(positive, negatives).collect()}
    assert pools == {(1, "A"): True, (1, "B"): False, (1, "C"): False, (2, "B"): True, (2, "A"): False, (2, "C"): False}
    assert M.candidate_count(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1)], "query_id int, position int")).collect() == [(2, 2)]
    with pytest.raises(Exception, match="candidates per query"):
        M.candidate_count(spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "query_id int, position int")).collect()


def test_threshold_metrics(spark):
    rows = [(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.5, False), (0.4, False), (None, True)]
    m = E.threshold_metrics(spark.createDataFrame(rows, "score double, relevant boolean")).collect()[0]
    assert (m["accuracy"], m["accuracy_threshold"]) == (0.833333, 0.8) and (m["f1"], m["f1_threshold"], m["precision"], m["recall"]) == (0.857143, 0.6, 0.75, 1.0)
    assert m["average_precision"] == round((1 + 1 + 3 / 4) / 3, 6)
    empty = E.threshold_metrics(spark.createDataFrame([], "score double, relevant boolean")).collect()
    assert len(empty) == 1 and empty[0]["f1"] is None
    nested = spark.createDataFrame([("A", {"recall@5": 0.123456}, None), ("B", None, {"em": 1.0})], "config string, retrieval map<string,double>, answer map<string,double>")
    assert {tuple(r) for r in E.summary_facts(nested).collect()} == {("A", "recall@5", 0.1235), ("B", "em", 1.0)}


def test_citations_ids_and_share(spark):
    articles = spark.createDataFrame([("K_m1", "İŞK", "1"), ("K_m2", "İŞK", "2")], "doc_id string, kanun_short string, madde_no string")
    rows = spark.createDataFrame([(1, [["A", "3"]], ["K_m1"]), (2, [], ["K_m2", "gone", "K_m1"]), (3, None, None), (4, [["x"]], ["K_m1"])], "id int, gold_citations array<array<string>>, gold_doc_ids array<string>")
    assert {r["id"]: r["citations"] for r in G.citations(rows, articles).collect()} == {1: ["a|3"], 2: ["işk|1", "işk|2"], 3: [], 4: ["işk|1"]}
    ids = spark.createDataFrame([('["a", "b"]',), ("a",), ("",), (None,), ("[bad",)], "v string")
    assert [r[0] for r in ids.select(T.id_array(F.col("v"))).collect()] == [["a", "b"], ["a"], [], [], []]
    split = R.share_split(spark.range(101), F.col("id")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 6, "train": 95}


def test_pipeline_answers_every_question(spark):
    rows = [(f"D{i}", "K", "Kanun", str(i), None, t, "u") for i, t in enumerate(["kira bedeli", "vergi borcu", "miras payı", None])]
    articles = spark.createDataFrame(rows, "doc_id string, kanun_short string, kanun_full string, madde_no string, baslik string, metin string, url string")
    asked = spark.createDataFrame([("q1", "kira bedeli"), ("q2", "zzz"), ("q3", None)], "query_id string, question string")
    retriever = Retriever.build(articles, with_dense=False)
    out = {r["query_id"]: r for r in Pipeline(retriever, lambda pairs: [f"{len(u)}" for _, u in pairs], mode="bm25", top_k=2).answer(asked).collect()}
    assert out["q1"]["sources"][0]["doc_id"] == "D0" and out["q1"]["context_chars"] > 0 and out["q1"]["answer"].isdigit()
    assert (out["q2"]["sources"], out["q2"]["context_chars"], out["q3"]["sources"]) == ([], 0, [])


def test_other_encoder(spark):
    rows = [("D0", "K", "Kanun", "1", None, "a", "u"), ("D1", "K", "Kanun", "2", None, "bbbb", "u")]
    articles = spark.createDataFrame(rows, "doc_id string, kanun_short string, kanun_full string, madde_no string, baslik string, metin string, url string")
    retriever = Retriever.build(articles, with_sparse=False, encoder=lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)))
    asked = spark.createDataFrame([("q", "x")], "query_id string, question string")
    assert [r["doc_id"] for r in retriever.rank(asked, 2, "dense").orderBy("rank").collect()] == ["D1", "D0"]


def test_bounds_of_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_ROWS", 3)
    with pytest.raises(ValueError):
        files.write_document(spark.range(4), str(tmp_path / "d"))
    (tmp_path / "b").mkdir()
    for name, content in (("a.bin", b"abc"), ("b.bin", b"\xff")):
        (tmp_path / "b" / name).write_bytes(content)
    got = {r["path"][-5:]: r["text"] for r in files.binary_texts(spark, str(tmp_path / "b"), lambda c: c.decode()).collect()}
    assert got == {"a.bin": "abc", "b.bin": None}


def test_query_blocks_and_repeated_queries(spark):
    from lexspark.operators.sparse import SparseIndex

    docs = spark.createDataFrame([(f"d{i}", "madde " * (i % 3) + f"kira{i % 5} vergi{i % 7}") for i in range(60)], "doc_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"madde kira{i % 5} vergi{i % 7}") for i in range(30)], "query_id string, question string")
    index = SparseIndex.build(docs)
    whole = {tuple(r) for r in index.search(asked, 7).collect()}
    assert len(whole) == 210 and whole == {tuple(r) for r in index.search(asked, 7, block=4).collect()}
    # what is shuffled is each task's best
    assert index.search(asked)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
