import math
import random
from collections import defaultdict

import numpy as np

from lexspark.llm import packing


def packed(spark, lengths, **options):
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, n_tokens bigint")
    return packing.containers(df, **options).collect()


def check(rows, lengths, capacity):
    room, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        room[r["container"]] += r["n_tokens"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["n_tokens"]))
    assert max(room.values(), default=0) <= capacity
    for i, n in enumerate(lengths):
        if n is None:
            assert i not in pieces
            continue
        own = sorted(pieces[i])
        assert [p[0] for p in own] == list(range(max(1, math.ceil(n / capacity))))
        assert all(s == p * capacity for p, s, _ in own) and sum(x[2] for x in own) == n
    return len(room)


def test_every_item_once_within_capacity_and_near_the_bound(spark):
    rng = random.Random(1)
    lengths = [min(5000, int(rng.lognormvariate(5.5, 1.2))) for _ in range(3000)] + [700] * 1500 + [None, 0, 2048, 2049, 1]
    used = check(packed(spark, lengths), lengths, 2048)
    assert used <= 1.03 * sum(n or 0 for n in lengths) / 2048 + 1
    used = check(packed(spark, lengths, buckets=16), lengths, 2048)
    assert used <= 1.15 * sum(n or 0 for n in lengths) / 2048 + 1


def test_few_and_no_items(spark):
    assert packed(spark, []) == []
    assert check(packed(spark, [0, 0]), [0, 0], 2048) <= 1
    assert check(packed(spark, [6, 6, 4, 4, 3, 3, 2, 2], capacity=10), [6, 6, 4, 4, 3, 3, 2, 2], 10) == 3


def test_bounds_minimise_padding():
    rng = random.Random(2)
    counts = np.array([0] + [rng.randrange(4) for _ in range(12)])

    def padding(bounds):
        return sum(counts[n] * (min(b for b in bounds if b >= n) - n) for n in range(1, 13))

    import itertools

    top = max(n for n in range(13) if counts[n])
    best = min(padding((*c, top)) for k in range(3) for c in itertools.combinations(range(1, top), k))
    assert padding(packing.bucket_bounds(counts, 3)) == best
