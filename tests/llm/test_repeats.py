import json
import random

from lexspark.llm import repeats
from pyspark.sql import functions as F


def test_collapse_against_brute_force(spark):
    rng = random.Random(3)
    base = [(f"q{k:03d}", f"Soru {k} ıI İi?") for k in range(60)] + [("hot", "Aynı soru")] * 300 + [(None, None), ("", " "), ("x", None)]
    rows = []
    for i, (key, q) in enumerate(base + rng.choices(base, k=200)):
        q = q and "".join(rng.choice([c.upper(), c]) + rng.choice(["", "", " ", "."]) for c in q)
        rows.append((i, key, q, rng.choice("ab")))
    df = spark.createDataFrame(rows, "n bigint, id string, question string, src string").repartition(5)

    def fold(x):
        return "".join(c for c in (x or "").translate(str.maketrans("İIı", "iii")).lower() if c.isalnum())

    groups = {}
    for i, key, q, src in rows:
        groups.setdefault((src, fold(key), fold(q)), []).append(i)
    for bits in (repeats.BLOCK_BITS, 1 << 16):
        distinct, copies = repeats.collapse(df, "n", ["id", "question"], ["src"], bits)
        assert sorted(tuple(r) for r in distinct.collect()) == sorted((s, min(g), len(g)) for (s, *_), g in groups.items())
        assert sorted(tuple(r) for r in copies.collect()) == sorted((s, min(g), i) for (s, *_), g in groups.items() for i in g if i != min(g))


def test_blocks_of_hashes_and_what_is_shuffled(spark):
    n, bits = 30_000, 1 << 17  # four blocks
    df = spark.range(n).selectExpr("id as n", "concat('Kayıt ', if(id < 500, id % 250, id)) as t", "if(id % 2 = 0, null, 'x') as g").repartition(6)
    keyed = df.select(repeats.block_of(F.xxhash64("t"), 4).alias("_block"), F.xxhash64("t").alias("_h"))
    merged = repeats.filters(keyed, bits).cache()
    assert {r["block"] for r in merged.collect()} == {0, 1, 2, 3}
    possible = sum(repeats.may_repeat(keyed.where(F.col("_block") == b), merged, b, bits).where("_again").count() for b in range(4))
    assert 500 <= possible <= 500 + 0.03 * n
    distinct, copies = repeats.collapse(df, "n", ["t"], ["g"], bits)
    assert distinct.count() == n - 250 and copies.count() == 250
    assert copies.where("copy_id <> first_id + 250").count() == 0


def test_lines_and_empty_table(spark):
    good = [json.dumps({"id": "q1", "question": "Ne?"}), '{"question":"Ne?", "id":"q1"}', '{"id": 5}']
    bad = ["", "// x", '{"id":"q"},', '{"id": NaN}', '["id"]', '{"id":"q', None, '{"id":"\\u12"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "n int, line string")
    out = {r["n"]: r["r"] for r in df.select("n", repeats.record_fields(F.col("line")).alias("r")).collect()}
    assert [out[i] and tuple(out[i]) for i in range(3)] == [("q1", "Ne?"), ("q1", "Ne?"), ("5", None)]
    assert all(out[i] is None for i in range(3, len(out)))
    empty = spark.createDataFrame([], "n bigint, id string, question string")
    distinct, copies = repeats.collapse(empty, "n", ["id", "question"])
    assert distinct.count() == 0 and copies.count() == 0
