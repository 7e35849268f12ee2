import math
import random

import numpy as np
import pytest

from lexspark.operators import dense, fuse
from lexspark.operators.search import Retriever, candidate_depth
from lexspark.operators.sparse import SparseIndex

WORDS = ["kira", "vergi", "ceza", "miras", "dava", "ve", "bir", "sözleşme"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = [(f"D{i:03d}", " ".join(rng.choices(WORDS, weights=[1, 1, 1, 1, 1, 9, 9, 1], k=rng.randint(1, 30)))) for i in range(120)]
    return docs + [("D200", ""), ("D201", docs[0][1]), ("D202", None)]


def bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {d: (t or "").split() for d, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else eps * mean for w, v in idf.items()}
    out = {}
    for d, t in toks.items():
        if set(query) & set(t):
            out[d] = round(sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query), 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_against_brute_force_and_saved(spark, corpus, tmp_path):
    df = spark.createDataFrame(corpus, "doc_id string, text string")
    queries = [("q1", "kira vergi kira"), ("q2", "ve bir dava"), ("q3", "yok"), ("q4", None)]
    asked = spark.createDataFrame(queries, "query_id string, question string")
    index = SparseIndex.build(df)
    index.save(str(tmp_path / "i"))
    for one in (index, SparseIndex.load(spark, str(tmp_path / "i"))):
        got = {}
        for r in one.search(asked, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], pytest.approx(r["score"], abs=1e-5)))
        assert got == {q: bm25(corpus, t.split())[:7] for q, t in queries[:2]}
    padded = index.search(asked, 5, pad=True).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in padded} == {q: 5 for q, _ in queries}
    empty = SparseIndex.build(df.limit(0))
    assert empty.search(asked).count() == 0


def test_dense_exact_and_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    data = centres[rng.integers(0, 8, 600)] + 0.25 * rng.normal(size=(600, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[5] = data[7]
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)] + [(900, None)], "doc_id int, embedding array<float>").repartition(3)
    asked = df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    f32 = data.astype(np.float32).astype(np.float64)
    want = {}
    for q in range(0, 600, 50):
        s = np.round(f32 @ f32[q], 6)
        want[q] = sorted(range(600), key=lambda i: (-s[i], i))[:10]
    for block in (4096, 5):
        got = {}
        for r in dense.search(df, asked, 10, block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want
    cells = dense.fit_cells(df, 8)
    near = dense.search_cells(dense.with_cells(df, cells), cells, asked, 10, probes=3).collect()
    found = sum(r["doc_id"] in want[r["query_id"]] for r in near)
    assert found >= 0.9 * sum(map(len, want.values()))
    assert dense.search(df, asked.limit(0)).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 9.0, 1), ("q", "y", 5.0, 2), ("q", "z", 1.0, 3)], "query_id string, doc_id string, score double, rank int")
    b = spark.createDataFrame([("q", "y", 0.5, 1), ("q", "w", 0.5, 2)], "query_id string, doc_id string, score double, rank int")
    got = [(r["doc_id"], round(r["score"], 9)) for r in fuse.reciprocal_ranks([a, b], 3).orderBy("rank").collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9)), ("w", round(1 / 62, 9))]
    boost = spark.createDataFrame([("q", "w")], "query_id string, doc_id string")
    assert {r["doc_id"]: r["score"] for r in fuse.weighted(a, b, boost).collect()} == {"x": 0.5, "y": 0.75, "z": 0.0, "w": 0.6}


def test_retriever(spark, corpus, tmp_path):
    rows = [(d, "K", "Kanun", str(i), None, t, "u") for i, (d, t) in enumerate(corpus)]
    articles = spark.createDataFrame(rows, "doc_id string, kanun_short string, kanun_full string, madde_no string, baslik string, metin string, url string")
    asked = spark.createDataFrame([("q1", "kira miras"), ("q2", "dava")], "query_id string, question string")
    built = Retriever.build(articles)
    built.save(str(tmp_path / "r"))
    loaded = Retriever.load(spark, str(tmp_path / "r"))
    for mode in ("bm25", "dense", "hybrid"):
        rank = lambda r: [(x["query_id"], x["rank"], x["doc_id"]) for x in r.search(asked, 5, mode).orderBy("query_id", "rank").collect()]
        assert rank(built) == rank(loaded) and [x[1] for x in rank(built)] == [0, 1, 2, 3, 4] * 2
    sparse_only = Retriever.load(spark, str(tmp_path / "r"), load_dense=False)
    assert sparse_only.vectors is None and sparse_only.search(asked, 3, "bm25").count() == 6
    with pytest.raises(ValueError):
        built.search(asked, 5, "magic")
    assert (candidate_depth(5, 50, True, False), candidate_depth(5, 50, False, True), candidate_depth(5, 50, False, False)) == (50, 10, 5)
