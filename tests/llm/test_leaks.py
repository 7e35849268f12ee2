import random

from lexspark.llm import leaks
from lexspark.llm.words import words_of


def brute(texts, items, n):
    out = set()
    for i, *fields in items:
        runs = {tuple(w[k : k + n]) for f in fields for w in [words_of(f)] for k in range(len(w) - n + 1)}
        for src, j, t in texts:
            w = words_of(t)
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((i, src, j))
    return out


def test_against_brute_force_and_offsets(spark):
    rng = random.Random(4)
    vocabulary = [f"söz{k}" for k in range(6)] + ["Iğdır", "İLK", "ve", "madde"]

    def text(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(n))

    items = [(i, text(rng.randint(0, 12)), rng.choice([None, "", text(9)])) for i in range(40)]
    items.append((40, *items[0][1:]))
    texts = [("documents", i, text(rng.randint(0, 30))) for i in range(120)]
    texts += [("synthetic_qa", i, "önce - " + (items[i][1] or "").upper() + " sonra") for i in range(20)] + [("documents", 200, None), ("documents", 201, "")]
    texts.append(("documents", 202, text(20_000)))
    df = spark.createDataFrame(texts, "src string, text_id bigint, text string")
    test = spark.createDataFrame(items, "row_id bigint, question string, answer string")
    for least, block in ((4, 10**6), (4, 60)):
        out = leaks.leaks(df, test, "row_id", ["question", "answer"], least, block).collect()
        assert {(r["item_id"], r["src"], r["text_id"]) for r in out} == brute(texts, items, least)
    wide = [(50 + i, " ".join(f"w{rng.randrange(60)}" for _ in range(40)), None) for i in range(200)]
    wide.append((300, " ".join(f"k{i}" for i in range(2000)), None))  # more words than two digits tell apart
    quoted = [("documents", 300 + i, " ".join(wide[i][1].split()[k : k + 9])) for i in range(200) for k in (0, 1, 17, 31)] + [("documents", 9000, " ".join(f"k{i}" for i in range(1990, 2000))), ("documents", 9001, "k0 k1 k2 k3 k4 k5 k6 k8")]
    got = leaks.leaks(spark.createDataFrame(quoted, "src string, text_id bigint, text string"), spark.createDataFrame(wide, "row_id bigint, question string, answer string"), "row_id", ["question", "answer"]).collect()
    assert {(r["item_id"], r["src"], r["text_id"]) for r in got} == brute(quoted, wide, 8)
    stored = {(s, i): t for s, i, t in texts}
    questions = {i: (words_of(q), words_of(a)) for i, q, a in items}
    for r in out:
        run = words_of(stored[r["src"], r["text_id"]][r["start"] : r["end"]])
        assert len(run) >= least and any(run[:least] == w[k : k + least] for w in questions[r["item_id"]] for k in range(len(w)))
    assert leaks.leaks(df, test.limit(0), "row_id", ["question", "answer"]).count() == 0
    assert leaks.leaks(df.limit(0), test, "row_id", ["question", "answer"]).count() == 0
