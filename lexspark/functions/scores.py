"""Column functions of retrieval, answer and citation quality."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the gold ids among the first k; 0 without gold ids."""
    own = F.array_distinct(F.coalesce(gold, F.array()))
    hit = F.size(F.array_intersect(F.slice(retrieved, 1, k), own))
    return F.when(F.size(own) > 0, hit / F.size(own)).otherwise(F.lit(0.0))


def mrr_at(retrieved: Column, gold: Column, k: int) -> Column:
    """One over the rank of the first gold id among the first k, else 0."""
    first = F.filter(F.transform(F.slice(retrieved, 1, k), lambda d, i: F.when(F.array_contains(gold, d), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(first) > 0, F.lit(1.0) / F.element_at(F.when(F.size(first) > 0, first), 1)).otherwise(F.lit(0.0))


def ndcg_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Discounted gain over the ideal; an id retrieved twice gains twice, so it may exceed 1."""
    own = F.array_distinct(F.coalesce(gold, F.array()))
    gains = F.transform(F.slice(retrieved, 1, k), lambda d, i: F.when(F.array_contains(own, d), 1.0 / F.log2((i + 2).cast("double"))).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(own), F.lit(k)), F.lit(1))), lambda i: 1.0 / F.log2((i + 1).cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return F.when(F.size(own) > 0, total(gains) / total(ideal)).otherwise(F.lit(0.0))


def shared_grams(pred: Column, gold: Column, orders: int = 4) -> Column:
    """Array of the sizes of the multiset intersections of 1-grams, 2-grams and so on. Counting is
    linear in the tokens, which expressions over arrays are not."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = x or [], y or []
            counts = [(Counter(zip(*(x[i:] for i in range(n)))), Counter(zip(*(y[i:] for i in range(n))))) for n in range(1, orders + 1)]
            rows.append([(p & g).total() for p, g in counts])
        return pa.array(rows, pa.list_(pa.int32()))

    return run(pred, gold)


def f1(overlap: Column, n_pred: Column, n_gold: Column) -> Column:
    return F.when((n_pred > 0) & (n_gold > 0) & (overlap > 0), 2.0 * overlap / (n_pred + n_gold)).otherwise(F.lit(0.0))


def token_f1(shared: Column, n_pred: Column, n_gold: Column) -> Column:
    """F1 of two token multisets from shared_grams and their sizes; 0 if either is empty."""
    return f1(F.element_at(shared, 1), n_pred, n_gold)


def bleu(shared: Column, n_pred: Column, n_gold: Column, orders: int = 4) -> Column:
    """Sentence BLEU from shared_grams with one added on every order; 0 if a side is empty or the
    prediction has fewer tokens than the highest order."""
    logs = F.lit(0.0)
    for n in range(1, orders + 1):
        logs = logs + F.ln((F.element_at(shared, n) + 1.0) / F.greatest(n_pred - (n - 2) * 1.0, F.lit(1.0)))
    brevity = F.when(n_pred < n_gold, F.exp(1.0 - n_gold / F.greatest(n_pred, F.lit(1)))).otherwise(F.lit(1.0))
    return F.when((n_pred >= orders) & (n_gold > 0), brevity * F.exp(logs / orders)).otherwise(F.lit(0.0))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit by bit: a row of the table is one number."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = 0
    for w in b:
        at = row | places.get(w, 0)
        row = at & ~(at - ((row << 1) | 1))
    return row.bit_count()


def lcs_length(pred: Column, gold: Column) -> Column:
    """Longest common subsequence of two token arrays; 0 for null."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([lcs(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return run(pred, gold)


def rouge_l(pred: Column, gold: Column, beta: float = 1.0) -> Column:
    """F of the longest common subsequence; 0 if a side is empty."""
    common = lcs_length(pred, gold)
    p, r, bb = common / F.greatest(F.size(pred), F.lit(1)), common / F.greatest(F.size(gold), F.lit(1)), beta * beta
    return F.when(common > 0, (1 + bb) * p * r / (r + bb * p)).otherwise(F.lit(0.0))


def citation_scores(pred: Column, gold: Column) -> Column:
    """struct(p, r, f1, n_pred, n_gold) of two sets of citation keys: 1 if both are empty, 0 if one is."""
    n_pred, n_gold, common = F.size(pred), F.size(gold), F.size(F.array_intersect(pred, gold))
    both = (n_pred == 0) & (n_gold == 0)
    share = lambda n: F.when(both, 1.0).when(n > 0, common / n).otherwise(0.0)
    return F.struct(
        share(n_pred).alias("p"), share(n_gold).alias("r"), F.when(both, 1.0).otherwise(f1(common, n_pred, n_gold)).alias("f1"), n_pred.alias("n_pred"), n_gold.alias("n_gold")
    )


def claim_score(claims: Column) -> Column:
    """Mean of verdicts, SUPPORTED 1, PARTIAL a half, others 0; null without claims."""
    worth = lambda c: F.when(F.upper(c["verdict"]) == "SUPPORTED", 1.0).when(F.upper(c["verdict"]) == "PARTIAL", 0.5).otherwise(0.0)
    return F.when(F.size(claims) > 0, F.aggregate(claims, F.lit(0.0), lambda a, c: a + worth(c)) / F.greatest(F.size(claims), F.lit(1)))
