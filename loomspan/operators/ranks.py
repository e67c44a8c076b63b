"""Exact values at ranks (medians, quantiles) of groups of any size, by distributed selection.

Rows become counts per (group, value), which are dealt by ranges of (group,
value): a group with all rows spreads over all ranges. Sums per (group, range)
say in which range a rank lies, and only that range is searched. No window and
no buffer holds a group; the largest one holds a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomspan.operators.ordering import in_ranges

Ranks = Callable[[Column], list[Column]]


def middle(n: Column) -> list[Column]:
    """The ranks (from 0) of the one or two middle values."""
    return [F.floor((n - 1) / 2), F.floor(n / 2)]


def upper_middle(n: Column) -> list[Column]:
    return [F.floor(n / 2)]


def nearest(*shares: float) -> Ranks:
    """The nearest ranks at or above shares of the rows: the first value that so many do not exceed."""
    return lambda n: [F.greatest(F.ceil(F.lit(s) * n) - 1, F.lit(0)) for s in shares]


def between(*shares: float) -> Ranks:
    """For each share the two ranks that an interpolated quantile lies between."""
    return lambda n: [r for s in shares for r in (F.floor(F.lit(s) * (n - 1)), F.ceil(F.lit(s) * (n - 1)))]


class Counted:
    """Counts per (group, value), in ranges; ``group`` is one column, a struct of the group's columns (so a null is a group, too)."""

    def __init__(self, df: DataFrame, groups: list[str], value: str):
        self.groups = groups
        group = F.struct(*(F.col(g).alias(g) for g in groups)) if groups else F.struct(F.lit(1).alias("all"))
        counts = df.select(group.alias("group"), F.col(value).alias("value")).groupBy("group", "value").agg(F.count("*").alias("count"))
        self.placed = in_ranges(counts, ["group", "value"])

    def named(self, rows: DataFrame) -> DataFrame:
        """The group's columns in place of the struct."""
        return rows.select(*(F.col("group")[g].alias(g) for g in self.groups), *(c for c in rows.columns if c != "group"))

    def at(self, ranks: Ranks, name: str = "values") -> DataFrame:
        """(group, values): the values at the ranks (from 0) that ``ranks`` gives for the group's number of rows with a value."""
        filled = self.placed.filter(F.col("value").isNotNull())
        parts = filled.groupBy("group", "_part").agg(F.sum("count").alias("own"))
        by_group = W.partitionBy("group")  # as many rows as ranges
        parts = parts.withColumn("before", F.sum("own").over(by_group.orderBy("_part")) - F.col("own")).withColumn("n", F.sum("own").over(by_group))
        wanted = F.array(*(F.struct(F.lit(k).alias("k"), r.cast("long").alias("rank")) for k, r in enumerate(ranks(F.col("n")))))
        here = F.filter(wanted, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("own")))
        asked = parts.select("group", "_part", "before", here.alias("wanted")).filter(F.size("wanted") > 0)
        inside = W.partitionBy("group", "_part").orderBy("value")
        found = filled.join(asked, ["group", "_part"]).withColumn("upto", F.col("before") + F.sum("count").over(inside))
        hit = F.filter("wanted", lambda w: (w["rank"] >= F.col("upto") - F.col("count")) & (w["rank"] < F.col("upto")))
        hits = found.select("group", "value", F.explode(hit).alias("w"))
        by_rank = F.array_sort(F.collect_list(F.struct("w.k", "value")))  # as many as ranks are asked for
        return hits.groupBy("group").agg(F.transform(by_rank, lambda x: x["value"]).alias(name))

    def summary(self) -> DataFrame:
        """(group, n, mean, low, high) of the values that are not null; a group without any has n = 0."""
        value, count = F.col("value"), F.when(F.col("value").isNotNull(), F.col("count"))
        n = F.coalesce(F.sum(count), F.lit(0))
        return self.placed.groupBy("group").agg(
            n.alias("n"), F.try_divide(F.sum(value * count), n).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")
        )


def at_ranks(df: DataFrame, groups: list[str], value: str, ranks: Ranks, name: str = "values") -> DataFrame:
    """The groups' columns and ``name``, an array of the values at the ranks; groups without values are left out."""
    counted = Counted(df, groups, value)
    return counted.named(counted.at(ranks, name))


def quantiles(df: DataFrame, groups: list[str], value: str, *shares: float, name: str = "quantiles") -> DataFrame:
    """Exact interpolated quantiles per group, as an array in the order of the shares."""
    counted = Counted(df, groups, value)
    n = counted.summary().select("group", "n")
    rows = counted.at(between(*shares), "v").join(n, "group")
    part = lambda i, s: F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))
    made = F.array(*(F.col("v")[2 * i] + (F.col("v")[2 * i + 1] - F.col("v")[2 * i]) * part(i, s) for i, s in enumerate(shares)))
    return counted.named(rows.select("group", made.alias(name)))
