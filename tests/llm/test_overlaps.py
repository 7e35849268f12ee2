import random

from lexspark.llm import overlaps
from lexspark.llm.words import words_of
from pyspark.sql import functions as F


def test_against_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 18))] for _ in range(60)]

    def variant(words):
        words = [w for w in words if rng.random() > 0.12] + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3))]
        rng.shuffle(words)
        return " ".join(w.upper() if rng.random() < 0.3 else w for w in words) + "?"

    docs = [f"D{k}" for k in range(5)]
    evaluated = [(rng.choice(["dev", "test"]), i, variant(rng.choice(base)), rng.choice([[], None, rng.sample(docs, 2), ["D0", "D0"]])) for i in range(120)]
    evaluated += [("dev", 200, None, []), ("dev", 201, "?", []), ("dev", 202, "Aynı soru", ["D1"]), ("test", 202, "aynı  SORU!", [])]
    trained = [(i, variant(rng.choice(base)), rng.choice([*docs, None])) for i in range(300)]
    trained += [(400 + i, "Aynı soru?", "D1") for i in range(150)] + [(600, None, "D1"), (601, "", "D1")]
    e = spark.createDataFrame(evaluated, "split string, eval_id bigint, question string, gold_doc_ids array<string>")
    t = spark.createDataFrame(trained, "train_id bigint, question string, source_doc_id string")
    want = set()
    for split, i, q, gold in evaluated:
        a = set(words_of(q))
        for j, p, doc in trained:
            b = set(words_of(p))
            if a and b and 10 * len(a & b) >= 7 * len(a | b) and (not gold or doc in gold):
                want.add((split, i, j))
    got = [tuple(r) for r in overlaps.overlaps(e, t).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    several = overlaps.overlapping(e, t, filter_bits=1 << 17)
    assert sorted(tuple(r) for r in several.pairs().collect()) == sorted(want)
    laws = t.select("train_id", (F.col("train_id") % 3).alias("law"))
    report = {(r["split"], r["law"]): (r["pairs"], r["questions"], r["training_rows"]) for r in several.report(laws, ["law"]).collect()}
    counted = {}
    for split, i, j in want:
        counted.setdefault((split, j % 3), set()).add((i, j))
    assert report == {k: (len(v), len({i for i, _ in v}), len({j for _, j in v})) for k, v in counted.items()}
    assert overlaps.overlaps(e.limit(0), t).count() == 0
    assert overlaps.overlaps(e, t.limit(0)).count() == 0
