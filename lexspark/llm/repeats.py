"""Collapsing records that differ only in formatting (problem 6).

Each record is reduced to a canonical form and hashed. Every partition notes, in two Bloom filters,
the hashes it saw once and those it saw again; merged, a hash seen once in two partitions counts as
seen again. The filters grow with the records: the hashes fall into as many blocks as it takes, each
with filters of its own of at most so many bits, and a partition sends the positions it set, not
whole filters. Only rows that the filter of their block says may repeat are shuffled and grouped
exactly; all others are singletons where they stand.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.ranking import join_groups
from lexspark.session import stored

PROBES = 2
BITS_PER_RECORD = 16  # of distinct records one in seventy is taken for a possible repeat
BLOCK_BITS = 1 << 29  # the filter of a block, 64 MB, is what a task holds at a time
CHUNK = 1 << 16  # bits of a filter that are merged in one place
BUFFER = 1 << 20  # hashes that a task gathers before it sends their positions


def folded(text: Column) -> Column:
    """Letters and digits only, in lower case, with i, ı, I and İ as one letter; null as empty."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), "İIı", "iii")), r"[^\p{L}\p{N}]+", "")


def record_fields(line: Column) -> Column:
    """id and question of a line that is one valid JSON object, else null. Strict: trailing text,
    bare words and unfinished strings are no JSON; values that are no strings count as their
    JSON text, missing ones as empty."""
    kind = pa.struct([("id", pa.string()), ("question", pa.string())])

    def no_constant(name: str) -> None:
        raise ValueError(name)

    def parse(text: str | None) -> dict | None:
        try:
            record = json.loads(text, parse_constant=no_constant) if text else None
        except (ValueError, RecursionError):
            return None
        if not isinstance(record, dict):
            return None
        values = {k: record.get(k) for k in ("id", "question")}
        values = {k: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False) for k, v in values.items()}
        return {k: v if v is None else v.encode("utf-8", "replace").decode() for k, v in values.items()}

    @F.arrow_udf("struct<id:string,question:string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([parse(t) for t in column.to_pylist()], kind)

    return run(line)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The probes of each hash within its block, one column each."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)], axis=1).astype(np.int64)


def block_of(hashes: Column, blocks: int) -> Column:
    return (F.shiftrightunsigned(hashes, 40) % blocks).cast("int")


def filters(hashes: DataFrame, bits: int) -> DataFrame:
    """(block, chunk, again): of hashes(block, hash), where in the chunks of each block's filter two
    or more records fall, over all partitions, as packed bits. A task sends two bytes a probe."""

    def positions_set(blocks: np.ndarray, hashes_: np.ndarray) -> pa.RecordBatch:
        at, n = np.unique(blocks.repeat(PROBES) * bits + positions(hashes_, bits).ravel(), return_counts=True)
        chunk, low, more = at // CHUNK, (at % CHUNK).astype(np.uint16), n > 1
        starts = np.flatnonzero(np.diff(chunk, prepend=-1))
        ends = [*starts[1:], len(at)]
        once = [low[i:j].tobytes() for i, j in zip(starts, ends)]
        again = [low[i:j][more[i:j]].tobytes() for i, j in zip(starts, ends)]
        first = chunk[starts]
        return pa.RecordBatch.from_pydict({"block": pa.array(first // (bits // CHUNK), pa.int32()), "chunk": pa.array(first % (bits // CHUNK), pa.int32()), "once": pa.array(once, pa.binary()), "again": pa.array(again, pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= BUFFER:  # sent early, as if by a partition of its own
                yield positions_set(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield positions_set(*map(np.concatenate, zip(*held)))

    def merge(parts: pa.Table) -> pa.Table:
        once, again = (np.frombuffer(b"".join(parts[c].to_pylist()), np.uint16) for c in ("once", "again"))
        repeated = np.bincount(once, minlength=CHUNK) > 1
        repeated[again] = True
        return pa.table({"block": parts["block"][:1], "chunk": parts["chunk"][:1], "again": pa.array([np.packbits(repeated).tobytes()], pa.binary())})

    filled = hashes.mapInArrow(fill, "block int, chunk int, once binary, again binary")
    return filled.groupBy("block", "chunk").applyInArrow(merge, "block int, chunk int, again binary")


def may_repeat(keyed: DataFrame, merged: DataFrame, block: int, bits: int) -> DataFrame:
    """keyed of a block with _again: whether the block's filter holds all probes of _h."""
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.where(F.col("block") == block).toLocalIterator():
        bitmap[row["chunk"] * (CHUNK // 8) :][: CHUNK // 8] = np.frombuffer(row["again"], np.uint8)
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def again(column: pa.Array) -> pa.Array:
        at = positions(column.to_numpy(zero_copy_only=False), bits)
        seen = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pa.array(seen.all(axis=1))

    return keyed.withColumn("_again", again("_h"))


def collapse(records: DataFrame, row_col: str, by: list[str], group: list[str] | None = None, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """Two tables: (group, first_id, copies) with a row per distinct record, and (group, first_id,
    copy_id) with a row per further copy. Records are the same if the canonical forms of the
    columns in by agree within the group columns, null being a group; first_id is the smallest
    row_col. Nulls agree with empty values. An empty table gives two empty tables."""
    group = group or []
    keys = [f"_k{i}" for i in range(len(by))]
    same = [f"_g{i}" for i in range(len(group))] + keys
    within = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")).alias(f"_g{i}") for i, g in enumerate(group)]
    keyed = records.select(*group, F.col(row_col).alias("_row"), *within, *[folded(F.col(c)).alias(k) for c, k in zip(by, keys)])
    keyed = stored(keyed.withColumn("_h", F.xxhash64(*same)))
    wanted = max(CHUNK, BITS_PER_RECORD * keyed.count())
    bits = min(block_bits, 1 << (wanted - 1).bit_length())
    blocks = -(-wanted // bits)
    keyed = keyed.withColumn("_block", block_of(F.col("_h"), blocks))
    if blocks > 1:  # each block's rows are then read for its own turn alone
        keyed = stored(keyed, "_block")
    merged = stored(filters(keyed.select("_block", "_h"), bits))
    if blocks == 1:
        marked = may_repeat(keyed, merged, 0, bits)
    else:
        turns = (may_repeat(keyed.where(F.col("_block") == b), merged, b, bits) for b in range(blocks))
        marked = functools.reduce(DataFrame.unionByName, map(stored, turns))
    possible = marked.where("_again")
    groups = stored(possible.groupBy(*group, *same).agg(F.min("_row").alias("first_id"), F.count("*").alias("copies")))
    alone = marked.where("not _again").select(*group, F.col("_row").alias("first_id"), F.lit(1).cast("bigint").alias("copies"))
    distinct = groups.select(*group, "first_id", "copies").unionByName(alone)
    copies = join_groups(possible.select("_row", *same), groups.where("copies > 1"), same, "copies")
    return distinct, copies.where("_row <> first_id").select(*group, "first_id", F.col("_row").alias("copy_id"))
