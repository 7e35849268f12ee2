import numpy as np
import pytest

from lexspark.operators import dense


def test_probes_have_no_default_and_all_cells_are_exact(spark):
    data = np.random.default_rng(5).normal(size=(300, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data / np.linalg.norm(data, axis=1, keepdims=True))], "doc_id int, embedding array<float>")
    asked = df.where("doc_id % 60 = 0").withColumnRenamed("doc_id", "query_id")
    centres = dense.fit_cells(df, 16)
    indexed = dense.with_cells(df, centres)
    with pytest.raises(TypeError, match="probes"):
        dense.search_cells(indexed, centres, asked)
    pairs = lambda found: {(r["query_id"], r["doc_id"]) for r in found.collect()}
    assert pairs(dense.search_cells(indexed, centres, asked, probes=16)) == pairs(dense.search(df, asked))


def test_measured_probes_and_best_rows(spark):
    data = np.random.default_rng(6).normal(size=(900, 8))
    data[300:600] = data[0]  # a third of all rows is one vector
    df = spark.createDataFrame([(f"d{i:03d}", v.tolist()) for i, v in enumerate(data)], "doc_id string, embedding array<double>").repartition(3)
    asked = df.where("right(doc_id, 2) in ('00', '50')").withColumnRenamed("doc_id", "query_id")
    centres = dense.fit_cells(df, 12)
    exact = {(r["query_id"], r["doc_id"]) for r in dense.search(df, asked, block=4).collect()}
    near = {(r["query_id"], r["doc_id"]) for r in dense.search_index(dense.with_cells(df, centres), centres, asked).collect()}
    assert len(exact) == 180 and len(exact & near) >= 0.9 * len(exact)
    scores = np.round(data @ data[0], 6)
    assert {d for q, d in exact if q == "d000"} == {f"d{i:03d}" for i in sorted(range(900), key=lambda i: (-scores[i], i))[:10]}


def test_term_frequencies(spark):
    from pyspark.sql import functions as F

    from lexspark.functions import text as T

    df = spark.createDataFrame([(["b", "a", "b", "", "a", "b"],), ([],), (["x"],)], "w array<string>")
    got = [sorted(map(tuple, r[0])) for r in df.select(T.term_frequencies(F.col("w"))).collect()]
    assert got == [[("", 1), ("a", 2), ("b", 3)], [], [("x", 1)]]
