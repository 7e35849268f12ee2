import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexspark.functions import scores as S
from lexspark.operators import evaluation as E


def brute(p, g):
    shared = [sum((Counter(zip(*(p[i:] for i in range(n)))) & Counter(zip(*(g[i:] for i in range(n))))).values()) for n in range(1, 5)]
    f1 = 2 * shared[0] / (len(p) + len(g)) if shared[0] else 0.0
    bleu = 0.0
    if len(p) >= 4 and g:
        logs = sum(math.log((o + 1) / (len(p) - n + 1)) for n, o in enumerate(shared)) / 4
        bleu = math.exp(logs) * (math.exp(1 - len(g) / len(p)) if len(p) < len(g) else 1.0)
    table = [[0] * (len(g) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p, 1):
        for j, y in enumerate(g, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    lcs = table[-1][-1]
    rouge = 2 * lcs / (len(p) + len(g)) if lcs else 0.0
    return f1, bleu, rouge


def test_answer_metrics_against_brute_force(spark):
    rng = random.Random(1)
    pairs = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 9))), " ".join(rng.choices("abcde", k=rng.randint(0, 9)))) for i in range(80)] + [(90, None, "a"), (91, None, None)]
    out = {r["i"]: r for r in E.answer_metrics(spark.createDataFrame(pairs, "i int, pred string, gold string"), ["i"]).collect()}
    for i, p, g in pairs:
        want = brute((p or "").split(), (g or "").split())
        assert [out[i][c] for c in ("f1", "bleu", "rouge_l")] == pytest.approx(want, abs=1e-6)
        assert out[i]["em"] == float((p or "") == (g or ""))


def test_lcs_of_long_lists():
    rng = random.Random(2)
    a, b = rng.choices("abcd", k=300), rng.choices("abcd", k=200)
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
        prev = cur
    assert S.lcs(a, b) == prev[-1] and S.lcs([], b) == 0


def test_retrieval_metrics(spark):
    ranked = [("q1", d, r) for r, d in enumerate(["b", "a", "c", "a"], 1)] + [("q2", "z", 1)]
    gold = [("q1", ["a", "x", "a"]), ("q2", []), ("q3", ["a"]), ("q4", None)]
    out = {r["query_id"]: r for r in E.retrieval_metrics(spark.createDataFrame(ranked, "query_id string, doc_id string, rank int"), spark.createDataFrame(gold, "query_id string, gold_doc_ids array<string>")).collect()}
    assert (out["q1"]["recall_1"], out["q1"]["recall_3"], out["q1"]["mrr_10"]) == (0.0, 0.5, 0.5)
    assert out["q1"]["ndcg_10"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert all(out[q][m] == 0.0 for q in ("q2", "q3", "q4") for m in ("recall_10", "mrr_10", "ndcg_10"))


def test_citation_scores_and_claims(spark):
    cases = [([], [], 1.0, 1.0, 1.0), (["a"], [], 0.0, 0.0, 0.0), ([], ["a"], 0.0, 0.0, 0.0), (["a", "b"], ["a"], 0.5, 1.0, 2 / 3)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g, *_) in enumerate(cases)], "i int, p array<string>, g array<string>")
    for r in df.select("i", S.citation_scores(F.col("p"), F.col("g")).alias("x")).collect():
        assert list(r["x"][:3]) == pytest.approx(cases[r["i"]][2:])
    claims = spark.createDataFrame([([("x", "supported"), ("y", "PARTIAL"), ("z", None)],), ([],), (None,)], "c array<struct<claim:string,verdict:string>>")
    assert [r[0] for r in claims.select(S.claim_score(F.col("c"))).collect()] == [0.5, None, None]


def test_aggregates(spark):
    facts = spark.createDataFrame([("A", "q1", "x", "m", 1.0), ("A", "q2", None, "m", 0.0), ("A", "q3", "", "m", float("nan")), ("B", "q1", "x", "m", 0.5), ("B", "q2", None, "m", None)], "config string, query_id string, category string, metric string, value double")
    means = {(r["config"], r["metric"]): (r["mean"], r["n"]) for r in E.macro(facts, ["config"]).collect()}
    assert means == {("A", "m"): (0.5, 2), ("B", "m"): (0.5, 1)}
    rolled = {(r["config"], r["category"]): (r["mean"], r["n"]) for r in E.by_category(facts).collect()}
    assert rolled == {("A", "x"): (1.0, 1), ("A", "unknown"): (0.0, 1), ("A", None): (0.5, 2), ("B", "x"): (0.5, 1), ("B", "unknown"): (None, 0), ("B", None): (0.5, 1)}
    status = {r["config"]: (r["status"], r["n"]) for r in E.configurations(E.macro(facts, ["config"]), ["A", "C"]).collect()}
    assert status == {"A": ("ok", 2), "C": ("missing", 0)}
    got = {r["label"]: r["delta"] for r in E.deltas(E.macro(facts, ["config"]), [("A", "B", "ab"), ("A", "C", "ac")]).collect()}
    assert got == {"ab": 0.0, "ac": None}
    assert E.pivoted(E.by_category(facts), ["A", "B", "C"], "m").where("category = 'x'").collect()[0].asDict() == {"category": "x", "A": 1.0, "B": 0.5, "C": None}
    assert E.markdown([{"a": 1.0, "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1.0000 | — |"


def test_ranked_rows(spark):
    scored = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("q", 3, True), ("n", 1, False)], "query_id string, rank int, relevant boolean")
    assert {r[0]: r[1] for r in E.average_precision(scored).collect()} == {"q": round((1 + 2 / 3) / 2, 6), "n": 0.0}
    gate = E.gate(spark.createDataFrame([(1,), (4,), (None,)], "rank int")).collect()[0]
    assert (gate["r_1"], gate["r_5"], gate["mean_rank"]) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 2.5)
