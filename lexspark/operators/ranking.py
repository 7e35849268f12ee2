"""Ranks and samples that no single task has to make for a whole table or a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import stored


def hash_rank(df: DataFrame, by: list[str], key: Column, seed: int = 42, rank: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row by md5(seed:key) within its group, the whole table if
    by is empty, and the size of the group as group_size. Hashes are ranked within their first
    byte's share of the group, and the shares' sizes added, so a group of a third of all rows is
    spread over 256 tasks. Rows of equal key are ranked arbitrarily among themselves."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).withColumn("_part", F.substr("_h", F.lit(1), F.lit(2)))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    hashed = hashed.select("*", *keys)
    sizes = hashed.groupBy(*names, "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*names) if by else Window.partitionBy()
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*names, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("group_size"))
    within = F.row_number().over(Window.partitionBy(*names, "_part").orderBy("_h"))
    ranked = hashed.withColumn("_r", within).join(sizes, [*names, "_part"])
    return ranked.select(*df.columns, (F.col("_r") + F.col("_before")).alias(rank), "group_size")


def hash_sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """The n rows of least md5(seed:key): a sample that SQL can repeat."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key).limit(n)


def stratified_sample(df: DataFrame, by: str, key: Column, total: int, seed: int = 42) -> DataFrame:
    """As many rows of each group, total div groups of them, and further rows by hash to fill up."""
    each = total // max(1, df.select(by).distinct().count())
    ranked = hash_rank(df, [by], key, seed)
    first, rest = ranked.where(F.col("rank") <= each), ranked.where(F.col("rank") > each)
    return first.select(*df.columns).unionByName(hash_sample(rest, key, max(0, total - first.count()), seed).select(*df.columns))


def stratified_split(df: DataFrame, by: str, key: Column, ratio: float = 0.2, least_group: int = 5, seed: int = 42) -> DataFrame:
    """df with a split column: of a group of enough rows the share, one at least, is test."""
    size, n = F.col("group_size"), F.greatest(F.lit(1), F.floor(F.col("group_size") * ratio))
    ranked = hash_rank(df, [by], key, seed)
    return ranked.select(*df.columns, F.when((size >= least_group) & (F.col("rank") <= n), "test").otherwise("dev").alias("split"))


def running_sums(counts: DataFrame, value: str, columns: list[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """counts with upto_<c>, the sum of each column over all values up to the row's, and total_<c>, over
    all; values must be unique and not null. Rows are partitioned by ranges of the value, summed
    within them, and the sums of the ranges before added, so no task has the whole table. There are
    as many ranges as the session has shuffle partitions, unless told."""
    order = F.desc(value) if descending else F.asc(value)
    # written, as the ranges are read twice and have to be the same
    placed = stored(counts.repartitionByRange(*([ranges] if ranges else []), order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before, whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = [F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns] + [F.sum(f"_{c}").over(whole).alias(f"total_{c}") for c in columns]
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(c).over(within).alias(f"_within_{c}") for c in columns]).join(sizes.select("_range", *sums), "_range")
    upto = [(F.col(f"_before_{c}") + F.col(f"_within_{c}")).alias(f"upto_{c}") for c in columns]
    return summed.select(*counts.columns, *upto, *[f"total_{c}" for c in columns])


def nearest_rank(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """(share, value): the element at floor(n * share) of the sorted values, from the histogram."""
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    wanted = running_sums(counts, "value", ["n"]).select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    return wanted.where(F.col("upto_n") > F.floor(F.col("total_n") * F.col("share"))).groupBy("share").agg(F.min("value").alias("value"))


def share_split(df: DataFrame, key: Column, share: float = 0.05, seed: int = 42) -> DataFrame:
    """df with a split column: the share of least hash, rounded up, is test, the rest train."""
    ranked = hash_rank(df, [], key, seed)
    return ranked.select(*df.columns, F.when(F.col("rank") <= F.ceil(F.col("group_size") * share), "test").otherwise("train").alias("split"))


def draws(asked: DataFrame, pool: DataFrame, key: str, group: str, value: str, seed: int = 42) -> DataFrame:
    """(key, value, place) for asked(key, group, wanted): so many values of pool(group, value) from the
    query's group, places from 0. The values of a group stand in the order of md5(seed:value), and each
    query begins at the place that the first eight digits of md5(seed:key) give and goes on round the
    end. So any value may be drawn, and a query meets only those it draws, however large its group.
    Null groups have none."""
    ranked = hash_rank(pool.where(F.col(group).isNotNull()), [group], F.col(value), seed, "_rank")
    begin = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit(8)), 16, 10).cast("bigint")
    sized = asked.join(ranked.where("_rank = 1").select(group, "group_size"), group)
    most = F.least(F.col("wanted").cast("bigint"), F.col("group_size"))
    spots = sized.where(most > 0).select(key, group, "group_size", begin.alias("_begin"), F.explode(F.sequence(F.lit(0).cast("bigint"), most - 1)).alias("place"))
    spots = spots.withColumn("_rank", (F.col("_begin") + F.col("place")) % F.col("group_size") + 1)
    return spots.drop("group_size").join(ranked.select(group, value, "_rank"), [group, "_rank"]).select(key, value, "place")


def join_groups(members: DataFrame, groups: DataFrame, keys: list[str], size: str, rows: int = 100_000) -> DataFrame:
    """members joined with groups(keys, size, ...) on the keys, size being how many members a key has.
    Members of a key of more than so many are spread over salts, and the key's rows in groups
    repeated for each; that few keys can be so large bounds what is broadcast. members and groups
    are read more than once; keys of null match nothing."""
    bound = max(rows, members.count() // 10_000)  # fewer than 10,000 keys can have more members
    salts = F.greatest(F.ceil(F.col(size) / bound), F.lit(1)).cast("int")
    large = groups.where(F.col(size) > bound).select(*keys, salts.alias("_salts")).distinct()
    salted = members.join(F.broadcast(large), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*members.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")
