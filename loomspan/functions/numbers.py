"""Rounding, shares and schedules of the reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.operators.ordering import running_totals

#: Calls, milliseconds and tokens a tier of the budget allows (fixed values).
BUDGET_TIERS = {"large": (1000, 3_600_000, 2_000_000), "middle": (300, 1_200_000, 600_000), "small": (100, 600_000, 200_000)}


def half_even(x: Column) -> Column:
    """Rounding to whole numbers with ties to even."""
    return F.bround(x, 0).cast("long")


def replay_size(n_core: int, share: float) -> int:
    return round(n_core * share)


def in_budget_tiers(rows: DataFrame, order: list, calls: str, milliseconds: str, tokens: str) -> DataFrame:
    """Running totals of the three over all rows, in order, and per tier whether they are over its caps (``over_<tier>``)."""
    out = running_totals(rows, order, [calls, milliseconds, tokens])
    return out.withColumns({f"over_{tier}": over_budget(*(F.col(f"{c}_upto") for c in (calls, milliseconds, tokens)), tier) for tier in BUDGET_TIERS})


def over_budget(calls: Column, milliseconds: Column, tokens: Column, tier: str = "large") -> Column:
    """Whether running totals are over a cap (reaching it is allowed)."""
    a, b, c = BUDGET_TIERS[tier]
    return (calls > a) | (milliseconds > b) | (tokens > c)


def cosine_rate(step: Column, warm: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    share = (step - warm) / F.lit(max(1, total - warm))
    return F.when(step < warm, step / F.lit(max(1, warm))).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * share)))


def divergence(p: Column, q: Column, temperature: float = 1.0) -> Column:
    """Kullback-Leibler divergence of two distributions, times the squared temperature."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * F.log(a / b)), F.lit(0.0), lambda a, v: a + v) * temperature**2
