import random

from lexspark.operators import ranking
from pyspark.sql import functions as F


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(v / 8, rng.randrange(5), rng.randrange(3)) for v in rng.sample(range(-4000, 4000), 700)]
    df = spark.createDataFrame(rows, "v double, n bigint, m bigint").repartition(3)
    for descending in (False, True):
        want, n, m = [], 0, 0
        for v, a, b in sorted(rows, reverse=descending):
            n, m = n + a, m + b
            want.append((v, a, b, n, m))
        out = ranking.running_sums(df, "v", ["n", "m"], descending, ranges=7)
        got = sorted((tuple(r) for r in out.select("v", "n", "m", "upto_n", "upto_m").collect()), reverse=descending)
        assert got == want
        assert {tuple(r) for r in out.select("total_n", "total_m").collect()} == {(n, m)}
    assert ranking.running_sums(df.limit(0), "v", ["n", "m"]).count() == 0


def test_nearest_rank(spark):
    values = [5, 1, 1, 9, None, 7, 1]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r["share"]: r["value"] for r in ranking.nearest_rank(df, F.col("v"), [0.0, 0.5, 0.9]).collect()}
    known = sorted(v for v in values if v is not None)
    assert got == {s: known[int(len(known) * s)] for s in (0.0, 0.5, 0.9)}
    assert ranking.nearest_rank(df.where("v > 100"), F.col("v"), [0.5]).count() == 0
