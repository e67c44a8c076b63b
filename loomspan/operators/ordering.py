"""Reproducible order, splits and samples by hash, without one-partition windows.

A global rank is a rank within a bucket (the hash's first three hex digits, at
most 4096 of them) plus the rows in the buckets before it, so the only window
over everything runs over the bucket counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomspan.shared import cut

SPLIT_SEED, REGRESSION_SEED, DATASET_SEED, ARENA_SEED = 20260630, 20260701, 20260702, 20260704


def hash_of(*parts) -> Column:
    """sha256 of the parts joined by colons; columns are given as Column."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def ranked(df: DataFrame, bucket: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    """Add a 1-based global ``rank`` and ``total``; ``bucket`` has few values and orders before ``order``."""
    keys = [f"_b{i}" for i in range(len(bucket))]
    df = df.withColumns(dict(zip(keys, bucket)))
    counts = df.groupBy(*keys).count()
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(W.partitionBy()).alias("total"))
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    joined = df.withColumn("_within", within).withColumnsRenamed({k: f"{k}x" for k in keys})
    on = [F.col(f"{k}x").eqNullSafe(F.col(k)) for k in keys]
    out = joined.join(F.broadcast(counts), on)  # as many rows as buckets
    return out.withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within", *keys, *(f"{k}x" for k in keys))


def hash_ranked(df: DataFrame, parts: list, tie: str, name: str = "rank") -> DataFrame:
    df = df.withColumn("_hash", hash_of(*parts))
    return ranked(df, [F.substring("_hash", 1, 3)], [F.col("_hash"), F.col(tie)], name).drop("_hash")


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """Rows dealt by ranges of the keys and sorted there (written once); adds ``_part`` (the range, in order) and ``_id`` (in it)."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    return placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_id", F.col("_id").bitwiseAND((1 << 33) - 1))


def bases(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each range of ``in_ranges`` what the ranges before it sum up to, as a small table to broadcast."""
    totals = placed.groupBy("_part").agg(*(F.coalesce(c, F.lit(0)).cast("decimal(38,0)").alias(k) for k, c in sums.items()))
    before, rows = [0] * len(sums), []
    for part, *own in sorted(map(tuple, totals.collect())):  # as many rows as ranges
        rows.append((part, *map(int, before)))
        before = [x + int(y) for x, y in zip(before, own)]
    return F.broadcast(df_of(placed, rows, ["_part", *sums]))


def df_of(like: DataFrame, rows: list, names: list[str]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names))


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Add the 1-based position in a total order of any keys.

    Rows are dealt by ranges of the keys and sorted there, so no key value and
    no bucket makes a large task; a position is that in the range plus the rows
    of the ranges before it, one number a range.
    """
    placed = in_ranges(df, order)
    return placed.join(bases(placed, {"_base": F.count("*")}), "_part").withColumn(name, F.col("_base") + F.col("_id") + 1).drop("_id", "_part", "_base")


def running_totals(df: DataFrame, order: list, columns: list[str], suffix: str = "_upto") -> DataFrame:
    """Add the running total of each whole-number column over everything, in a total order (nulls add nothing).

    A prefix scan: totals inside a range by a window over that range alone,
    plus the sums of the ranges before it. No window holds more than a range.
    """
    placed = in_ranges(df, order)
    before = bases(placed, {f"_base_{i}": F.sum(c) for i, c in enumerate(columns)})
    inside = W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = {f"{c}{suffix}": F.col(f"_base_{i}") + F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).over(inside) for i, c in enumerate(columns)}
    return placed.join(before, "_part").withColumns(sums).drop("_part", "_id", *(f"_base_{i}" for i in range(len(columns))))


def ordinal(df: DataFrame, key: str, name: str = "ord") -> DataFrame:
    """1-based position in the order of a unique key."""
    return positions(df, [key], name).select(*df.columns, name)


def split_by_hash(df: DataFrame, key: str, seed: int = SPLIT_SEED, train: float = 0.5, validation: float = 0.25, keep_rank: bool = False) -> DataFrame:
    """Add ``part``: floor cuts of the hash order, the rest held out (and, on wish, the ``rank`` in it)."""
    out = hash_ranked(df, [seed, F.col(key)], key)
    first = F.floor(F.col("total") * train)
    second = first + F.floor(F.col("total") * validation)
    part = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "validation").otherwise("held_out")
    return out.withColumn("part", part).drop("total", *([] if keep_rank else ["rank"]))


#: Rows of a sample up to which one task merges the best rows of all tasks.
TOP_ROWS = 1_000


def sample_by_hash(df: DataFrame, k: int, parts: list, tie: str) -> DataFrame:
    """The k rows of the smallest hash (all, if there are fewer).

    Above ``TOP_ROWS`` no task sees the sample: counts by three more hex digits
    of the hash (4,096 at most) say in which prefix the k-th row lies. Rows
    below it are taken where they lie; those in it are counted again until few
    are to be taken.
    """
    hashed = df.withColumn("hash", hash_of(*parts))
    prefix, left = "", k
    while left > TOP_ROWS and len(prefix) < 63:
        counts = hashed.filter(F.col("hash").startswith(prefix)).groupBy(F.substring("hash", 1, len(prefix) + 3).alias("digits")).count()
        for digits, n in sorted(map(tuple, counts.collect())):
            if n > left:
                prefix = digits
                break
            left -= n
        else:  # fewer rows than k: only without a prefix
            return hashed
    rest = hashed.filter(F.col("hash").startswith(prefix)).orderBy("hash", tie).limit(left)
    return hashed.filter(F.col("hash") < prefix).unionByName(rest) if prefix else rest


def cut_by_hash(df: DataFrame, k: int, parts: list, tie: str, first: str, rest: str) -> DataFrame:
    out = hash_ranked(df, parts, tie)
    return out.withColumn("part", F.when(F.col("rank") <= k, first).otherwise(rest)).drop("rank", "total")


def take_with_repeats(df: DataFrame, key: str, n: int, seed: int, label: str) -> DataFrame:
    """n rows: the whole pool again and again, each round in its own hash order; adds ``round``."""
    size = df.count()
    if not size or n <= 0:
        return df.limit(0).withColumn("round", F.lit(0))
    rounds = math.ceil(n / size)
    full = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 2)))) if rounds > 1 else df.limit(0).withColumn("round", F.lit(0))
    last = sample_by_hash(df, n - (rounds - 1) * size, [seed + rounds - 1, label, F.col(key)], key).drop("hash")
    return full.unionByName(last.withColumn("round", F.lit(rounds - 1)))


def tier_sizes(df: DataFrame, tier: str) -> dict:
    """Rows of each tier, in the tiers' order (tiers are few)."""
    return dict(sorted(tuple(r) for r in df.groupBy(tier).count().collect()))


def staged_fill(df: DataFrame, tier: str, key: str, n: int, seed: int, label: str) -> DataFrame:
    """n rows by tier and then hash; raises if there are fewer.

    Counts per tier give its quota: whole tiers, one that is cut by a top-k of
    its hash order, and no others. Nothing ranks the table.
    """
    sizes, out, left = tier_sizes(df, tier), df.limit(0), n
    if sum(sizes.values()) < n:
        raise ValueError(f"{sum(sizes.values())} rows for {n}")
    for t, size in sizes.items():
        pool = df.filter(F.col(tier) == t)
        out = out.unionByName(pool if size <= left else sample_by_hash(pool, left, [seed, label, F.col(key)], key).drop("hash"))
        left -= min(left, size)
        if not left:
            break
    return out


def staged_repeats(df: DataFrame, tier: str, key: str, n: int, seed: int, label: str) -> DataFrame:
    """n rows of the first tier that has any, again and again if it is short (``round``); raises if no tier has a row."""
    sizes = tier_sizes(df, tier)
    if n and not sizes:
        raise ValueError(f"no rows for {n}")
    first = next(iter(sizes), None)
    return take_with_repeats(df.filter(F.col(tier) == first), key, n, seed, f"{label}:{first}")


def stratified_sample(df: DataFrame, group: str, order: list[str], per_group: int, n: int) -> DataFrame:
    """``per_group`` rows of each group, filled to n by (group, order); the last of ``order`` is a unique key.

    The rank filter is a per-group limit that tasks apply before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    core = df.withColumn("_n", rank).filter(F.col("_n") <= per_group).drop("_n")
    rest = df.join(core.select(order[-1]), order[-1], "left_anti")
    return core.unionByName(rest.orderBy(group, *order).limit(max(0, n - core.count())).select(*core.columns))


def shard_items(df: DataFrame, key: str, shards: int) -> DataFrame:
    return ordinal(df, key).withColumn("shard", ((F.col("ord") - 1) % shards).cast("int")).drop("ord")


def keep_first(df: DataFrame, keys: list[str], order) -> DataFrame:
    """One row per key, of the least ``order``; pre-aggregated, so no window sorts a hot key."""
    rest = [c for c in df.columns if c not in keys]
    least = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return least.select(*keys, "_row.*").select(*df.columns)


def number_by_first(df: DataFrame, name: str, order: str, pattern: str = "fn_%04d") -> DataFrame:
    """Names numbered in the order in which they first appear."""
    firsts = df.groupBy(name).agg(F.min(order).alias("_first"))
    return ordinal(firsts, "_first").select(name, F.format_string(pattern, "ord").alias("code"))


def stable_int(*parts, digits: int = 16) -> Column:
    """The first hex digits of the hash as a number (16 digits need DECIMAL(20))."""
    return F.conv(F.substring(hash_of(*parts), 1, digits), 16, 10).cast("bigint" if digits < 16 else "decimal(20,0)")
