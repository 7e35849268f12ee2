"""Filling containers of a fixed capacity with whole items (problem 9).

The global histogram of lengths goes to the driver: at most one row per length up to the
capacity, however many items there are. Dynamic programming over it chooses the bucket bounds
that minimise padding. Token-budget batches form inside each bucket; batches of a bucket alone
would leave the room that is no multiple of its bound, so that room takes batches of lower
buckets, best fit first. The plan is a list of rank ranges per bucket, its size bounded by
buckets and distinct rests of room and not by the items, and every item finds its container
from its bucket and its rank there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import stored

ROWS_PER_SALT = 100_000


def least_of_ranges(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive ranges of values, whose entries are numbered from first, the least value and its
    number, the first of equal ones."""
    starts = np.cumsum(sizes) - sizes
    least = np.minimum.reduceat(values, starts)
    at = np.flatnonzero(values == np.repeat(least, sizes))
    where = at[np.searchsorted(at, starts)]
    return least, first + where - starts


def bucket_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most that many buckets over lengths 1..len(counts)-1 such that the sum
    of (bound - length) over all items is least. counts[n] is the number of items of length n.

    A bucket over the distinct lengths i..j costs lengths[j] * items - tokens. Where the last bucket of
    the best choice begins never moves back as j grows, so each row of the table is filled by halving:
    for the middle j first, for those below and above it between the begins already known. The
    middles of one depth are looked at together."""
    lengths = np.flatnonzero(counts[1:]) + 1
    m = len(lengths)
    if m <= buckets:
        return lengths.tolist()
    n = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.float64)
    depths, spans = [], np.array([[1, m]])
    while len(spans):
        a, b = spans.T
        j = (a + b) // 2
        depths.append((j, a - 1, b + 1))
        spans = np.concatenate([np.stack([a, j - 1], 1), np.stack([j + 1, b], 1)])
        spans = spans[np.argsort(spans[:, 0])]
        spans = spans[spans[:, 0] <= spans[:, 1]]
    best = np.concatenate([[0.0], lengths * n[1:]])
    choice = np.zeros((buckets, m + 1), dtype=np.int32)
    for k in range(1, buckets):
        new, begin = np.zeros(m + 1), np.zeros(m + 2, dtype=np.int64)
        begin[m + 1] = m
        for js, below, above in depths:
            lo, hi = begin[below], np.minimum(begin[above], js - 1)
            sizes = hi - lo + 1
            i = np.arange(sizes.sum()) + np.repeat(lo + sizes - np.cumsum(sizes), sizes)
            cost = best[i] + np.repeat(lengths[js - 1], sizes) * (np.repeat(n[js], sizes) - n[i])
            new[js], begin[js] = least_of_ranges(cost, lo, sizes)
        choice[k] = begin[: m + 1]
        best = new
    bounds, j = [], m
    for k in range(buckets - 1, -1, -1):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(choice[k, j]) if k else 0
    return bounds[::-1]


def batch_plan(bounds: list[int], items: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rules (bucket, first rank, first container, items a container) and the number of
    containers. bounds ascend; items[b] is the number of items in bucket b."""
    rules: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first container, how many)
    used = 0
    for b in range(len(bounds) - 1, -1, -1):
        size, left, rank = bounds[b], items[b], 0
        open_rooms = sorted(r for r in rooms if rooms[r])
        for room in open_rooms[bisect_left(open_rooms, size) :]:
            each = room // size
            while left and rooms[room]:
                first, many = rooms[room].pop()
                full = min(many, left // each)
                if full < many:
                    rooms[room].append((first + full, many - full))
                if full:
                    rules.append((b, rank, first, each))
                    rooms[room - each * size].append((first, full))
                    rank, left = rank + full * each, left - full * each
                if left and full < many:  # fewer than a container takes
                    start, count = rooms[room].pop()
                    rules.append((b, rank, start, each))
                    rooms[room - left * size].append((start, 1))
                    if count > 1:
                        rooms[room].append((start + 1, count - 1))
                    rank, left = rank + left, 0
        if left:
            each = capacity // size
            rules.append((b, rank, used, each))
            full, rest = divmod(left, each)
            if full:
                rooms[capacity - each * size].append((used, full))
            if rest:
                rooms[capacity - rest * size].append((used + full, 1))
            used += full + bool(rest)
    return rules, used


def containers(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacity: int = 2048, buckets: int = 512) -> DataFrame:
    """(id_col, piece, start, n_tokens, container) for every row with a length: an item within
    the capacity is one piece, a longer one is cut into full pieces and a rest. Rows of a null
    length are left out; an item of length 0 takes no room and is put into some container.
    Repeated ids are packed row by row. The sum of n_tokens in a container never exceeds the
    capacity. An empty table gives none."""
    spark = lengths.sparkSession
    sized = stored(lengths.select(id_col, F.col(length_col).cast("bigint").alias("_n")).where("_n is not null"))
    last = F.greatest(F.expr(f"(_n - 1) div {capacity}"), F.lit(0))
    pieces = sized.select(id_col, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        id_col, "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).alias("n_tokens")
    )
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    total, bounds = int(counts[1:].sum()), bucket_bounds(counts, buckets)
    upto = np.concatenate([[0], np.cumsum(counts[1:])])
    items = np.diff([0, *(int(upto[b]) for b in bounds)]).tolist()
    rules, used = batch_plan(bounds, items, capacity)
    rules.sort()
    table = np.array(rules, dtype=np.int64).reshape(-1, 4)
    # a rule is found by one number: bucket, then first rank
    keys = table[:, 0] * (total + 1) + table[:, 1]
    shared = spark.sparkContext.broadcast((table, keys))

    salts = 1 + total // ROWS_PER_SALT
    kind = lengths.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece bigint, start bigint, n_tokens bigint"
    bucket_of = F.lit(np.searchsorted(np.array(bounds, dtype=np.int64), np.arange(1, capacity + 1)).tolist())
    bucket = F.get(bucket_of, (F.col("n_tokens") - 1).cast("int")).cast("bigint")
    placed = pieces.where("n_tokens > 0").withColumn("_b", bucket).withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    within = Window.partitionBy("_b", "_salt").orderBy(id_col, "piece")
    offsets = (
        placed.groupBy("_b", "_salt").agg(F.count("*").alias("_c"))
        .withColumn("_offset", F.sum("_c").over(Window.partitionBy("_b").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_b", "_salt", F.coalesce("_offset", F.lit(0)).alias("_offset"))
    )
    ranked = placed.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["_b", "_salt"])
    ranked = ranked.select(id_col, "piece", "start", "n_tokens", "_b", (F.col("_r") + F.col("_offset")).alias("_rank"))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, keys_ = shared.value
        for batch in batches:
            b, rank = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            rule = table_[np.searchsorted(keys_, b * (total + 1) + rank, side="right") - 1]
            at = rule[:, 2] + (rank - rule[:, 1]) // rule[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at, pa.int64())], [*batch.schema.names[:4], "container"])

    packed = ranked.mapInArrow(assigned, schema + ", container bigint")
    weightless = pieces.where("n_tokens = 0").withColumn("container", F.pmod(F.xxhash64(id_col), F.lit(max(1, used))))
    return packed.unionByName(weightless)
