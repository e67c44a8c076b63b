"""Evaluation arenas: successes that nothing touched before, sampled by hash, with the checks and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.operators import lineage, ordering as o
from loomspan.shared import cut

READY, SHORT = "ready", "insufficient"


@dataclass
class Arena:
    rows: DataFrame
    #: Distinct successes that were free to be chosen, and the state of the arena.
    available: int
    status: str

    def distribution(self, *columns: str) -> DataFrame:
        return self.rows.groupBy(*columns).agg(F.count("*").alias("n"))

    def report(self, requested: int) -> DataFrame:
        """One row: how many were asked for, were free, and were chosen, and the state."""
        sizes = self.rows.agg(F.lit(requested).cast("long").alias("requested"), F.lit(self.available).cast("long").alias("available"), F.count("*").alias("selected"))
        return sizes.withColumn("status", F.lit(self.status))


def build(rows: DataFrame, key: str, success: Column, touched: dict[str, DataFrame], size: int, least: int, seed: int, label: str = "arena") -> Arena:
    """Up to ``size`` successes of the least hash that no touched set holds; ready with ``least`` free ones or more.

    The sample is checked against every touched set once more, and raises with the set's name if they meet.
    """
    free = rows.filter(success)
    for ids in touched.values():
        free = free.join(ids.select(key).distinct(), key, "left_anti").select(*rows.columns)
    free = cut(free)
    chosen = cut(o.sample_by_hash(free, size, [seed, label, F.col(key)], key).drop("hash"))
    return checked(chosen, key, touched, free.count(), least)


def checked(chosen: DataFrame, key: str, touched: dict[str, DataFrame], available: int, least: int) -> Arena:
    """An arena of ready-made rows, after the same checks."""
    for name, ids in touched.items():
        lineage.assert_disjoint(chosen, ids, key, f"arena and {name}")
    return Arena(chosen, available, READY if available >= least else SHORT)
