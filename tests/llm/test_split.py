import random

import pytest

from lexspark.llm import split


def article(rng, n):
    lines = []
    for k in range(n):
        lines.append(f"({k + 1}) " + " ".join("".join(rng.choices("abçdeğıi", k=rng.randint(2, 12))).capitalize() + rng.choice(["", "", ",", ".", " m. 3/1 ve No. 5."]) for _ in range(rng.randint(3, 200))))
        lines += [f"{c}) öğe {k}," for c in "abcç"[: rng.randint(0, 4)]]
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text = [article(rng, 6), "x" * 5000, "á" * 2000, "söz " * 900, article(rng, 20)][seed % 5]
    limit, overlap = rng.choice([(1500, 150), (200, 30), (100, 0)])
    pieces = split.pieces_of(text, limit, overlap)
    assert "".join(text[n:e] for _, n, e in pieces) == text
    assert all(e - s <= limit for s, _, e in pieces)
    assert all(0 <= n - s <= overlap for s, n, _ in pieces)
    for (s, n, _), (_, before, _) in zip(pieces[1:], pieces):
        assert s >= before and (" " not in text[s - 1 : n] or s == n or text[s - 1].isspace())


def test_natural_boundaries():
    paragraphs = [f"({k}) " + "Söz verilir. " * 40 for k in range(1, 6)]
    text = "\n".join(paragraphs)
    starts = [text[n : n + 3] for _, n, _ in split.pieces_of(text)]
    assert starts == ["(1)", "(3)", "(5)"]
    long = "Bir cümle burada biter. " * 200
    assert all(long[n:e].rstrip().endswith(".") for _, n, e in split.pieces_of(long))


def test_items(spark):
    rows = [(1, "a", "kısa"), (2, "b", ""), (3, "c", None), (4, "d", "söz " * 1000), (4, "d", "söz " * 1000)]
    df = spark.createDataFrame(rows, "row_id bigint, text2 string, text string")
    out = split.split_items(df, ["row_id"]).orderBy("row_id", "piece").collect()
    assert [(r["row_id"], r["text"]) for r in out[:2]] == [(1, "kısa"), (2, "")]
    long = [r for r in out if r["row_id"] == 4]
    assert len(long) % 2 == 0 and {len(r["text"]) <= 1500 for r in long} == {True}
    first = [r for i, r in enumerate(long) if i % 2 == 0]
    assert "".join(r["text"][r["new"] - r["start"] :] for r in first) == "söz " * 1000
    assert split.split_items(df.limit(0), ["row_id"]).count() == 0


def test_siblings_merge_only_whole_and_words_of_any_length():
    text = "(1) " + "Uzun fıkra cümlesi burada. " * 70 + "\n(2) Kısa fıkra.\n(3) Bir kısa fıkra daha."
    starts = [text[n : n + 3] for _, n, _ in split.pieces_of(text)]
    assert starts[0] == "(1)" and starts[-1] == "(2)" and "(2)" not in starts[1:-1]
    word = "á" * 3_000_000
    pieces = split.pieces_of(word)
    assert pieces[-1][2] == len(word) and all(e - s <= 1500 for s, _, e in pieces)


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([(1, "söz " * 1000)], "row_id bigint, text string")
    plan = split.split_items(df, ["row_id"], with_text=False).where("piece = 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
