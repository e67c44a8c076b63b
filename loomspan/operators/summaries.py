"""Grouped statistics with the reports' conventions for nulls and empty groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.operators import ranks
from loomspan.operators.ordering import positions
from loomspan.shared import cut


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is zero."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ci95(value: str) -> list[Column]:
    """mean and half width of the normal 95 % interval; one value has width 0, none has nulls."""
    n = F.count(value)
    half = F.when(n == 1, F.lit(0.0)).otherwise(1.96 * F.stddev_samp(value) / F.sqrt(n))
    return [F.count(value).alias("n"), r6(F.avg(value)).alias("mean"), r6(half).alias("ci95")]


def score_summary(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The groups, n, mean, median (mean of the middle two), min and max of the values that are not null; exact at any size."""
    counted = ranks.Counted(df, groups, value)
    middle = F.when(F.size("values") > 0, (F.col("values")[0] + F.col("values")[F.size("values") - 1]) / 2)
    rows = counted.summary().join(counted.at(ranks.middle), "group", "left")
    return counted.named(rows.select("group", "n", r6(F.col("mean")).alias("mean"), r6(middle).alias("median"), "low", "high"))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The value at position n // 2 (from 0) of each group's sorted values."""
    found = ranks.at_ranks(df, [group], value, ranks.upper_middle)
    return found.select(group, F.col("values")[0].alias("upper_median"))


#: Distinct differences up to which a resample looks them up in its own row; values of a block and tasks of the resampling by counts.
MOST_VALUES, BLOCK, TASKS = 10_000, 100_000, 64


def bootstrap_by_counts(df: DataFrame, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """(replicate, mean) of resamples of the table's own size, by multinomial counts of its distinct values.

    A resample draws how often each distinct value comes, so it costs distinct
    values, not rows. Values are cut into blocks by their place in the order:
    how many draws fall on each block comes from one multinomial draw, and those
    of a block's values from another, each from a counter-based generator named
    by seed, replicate and block. So the result does not depend on the number
    of partitions, and no task holds more than a block. Nulls are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = cut(positions(counts, ["v"], "at").select("v", "n", F.floor((F.col("at") - 1) / BLOCK).cast("long").alias("block")))
    totals = [r["n"] for r in placed.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()]  # a row a block
    whole = sum(totals)
    chunks = max(1, min(TASKS, resamples, TASKS * 8 // max(1, len(totals))))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")
        block, chunk = int(rows["block"].iloc[0]), int(rows["chunk"].iloc[0])
        values, shares = rows["v"].to_numpy(), rows["n"].to_numpy() / totals[block]
        numbers = range(chunk, resamples, chunks)
        of = lambda r, kind: np.random.Generator(np.random.Philox(key=[seed << 1 | (kind > 0), r], counter=[0, 0, 0, kind]))
        sums = []
        for r in numbers:
            fall = of(r, 0).multinomial(whole, np.array(totals) / whole)[block] if len(totals) > 1 else whole
            sums.append(float(of(r, block + 1).multinomial(fall, shares) @ values))
        return pd.DataFrame({"replicate": list(numbers), "sum": sums})

    spread = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sums = spread.groupBy("block", "chunk").applyInPandas(draw, "replicate long, sum double")
    return sums.groupBy("replicate").agg((F.sum("sum") / max(whole, 1)).alias("mean"))


def bootstrap_means(df: DataFrame, value: str, resamples: int) -> DataFrame:
    """(replicate, mean) of resamples of the table's own size, drawn by an integer hash of replicate and draw.

    A draw picks a rank in the sorted values, so all it needs is how many rows
    each distinct value has: draws are made and summed in tasks, without a join
    to the rows. The work is rows times resamples, as SQL can say it too; with
    more than ``MOST_VALUES`` distinct values it is done by counts instead.
    """
    counts = df.groupBy(value).count().orderBy(value).limit(MOST_VALUES + 1).collect()
    if len(counts) > MOST_VALUES:
        return bootstrap_by_counts(df, value, resamples)
    n, upto, edges = sum(c["count"] for c in counts), 0, []
    for c in counts:
        upto += c["count"]
        edges.append((upto, float(c[value])))
    prime, multiplier, step = 2147483647, 48271, 7919  # fixed values of the hash
    draws = df.sparkSession.range(n * resamples).select(F.expr(f"id div {max(n, 1)}").alias("replicate"), F.expr(f"id % {max(n, 1)}").alias("i"))
    seed = (F.col("replicate") + 1) * multiplier % prime
    draws = draws.withColumn("s", seed).withColumn("x", (F.col("s") + F.col("i") * step) % prime)
    draws = draws.withColumn("y", (F.col("x") * F.col("x") % prime * multiplier + F.col("s")) % prime)
    draws = draws.select("replicate", (F.col("y") * F.col("y") % prime % max(n, 1)).alias("pick"))
    if len(edges) <= 32:
        found = F.lit(None).cast("double")
        for edge, v in reversed(edges):
            found = F.when(F.col("pick") < edge, F.lit(v)).otherwise(found)
    else:
        place = F.size(F.filter(F.array(*(F.lit(e) for e, _ in edges)), lambda e: e <= F.col("pick")))
        found = F.get(F.array(*(F.lit(v) for _, v in edges)), place)
    return draws.groupBy("replicate").agg((F.sum(found) / max(n, 1)).alias("mean"))
