"""How an output departed from an earlier right call, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bounds of the reports (fixed values): forgetting that may stay, the slice that must hold, retention bands.
FORGET_LIMIT, SLICE_LEAST = 0.02, 0.40
STRONG, USABLE = 0.60, 0.40


def subtype(old: Column, new: Column) -> Column:
    """drop, add and value (maps of argument to value), joined by +; empty if the arguments agree."""
    names, found = F.map_keys(old), F.map_keys(new)
    other = F.exists(F.array_intersect(names, found), lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
    kinds = F.array(
        F.when(F.size(F.array_except(names, found)) > 0, "drop"), F.when(F.size(F.array_except(found, names)) > 0, "add"), F.when(other, "value")
    )
    return F.array_join(F.array_compact(kinds), "+")


def drift_type(parsed: Column, old_name: Column, new_name: Column, old: Column, new: Column) -> Column:
    """format_drift (no call) before function_flip (another name) before parameter_drift; none if the calls agree."""
    return (
        F.when(~F.coalesce(parsed, F.lit(False)), "format_drift")
        .when(~old_name.eqNullSafe(new_name), "function_flip")
        .when(subtype(old, new) != "", "parameter_drift")
        .otherwise("none")
    )


def exit_label(forget: Column, kept: Column) -> Column:
    """success, partial or failure by the forgetting gate and the slice."""
    return F.when(forget > FORGET_LIMIT, "failure").when(kept >= SLICE_LEAST, "success").otherwise("partial")


def retention_band(retention: Column) -> Column:
    return F.when(retention >= STRONG, "strong").when(retention >= USABLE, "usable").otherwise("retry")


def gate(n: Column, least: int = 50) -> Column:
    """GO with enough rows, else STOP and how many it takes."""
    return F.when(n >= least, "GO").otherwise(f"STOP_LT_{least}")


def probe_tag(n: Column, least: int = 30) -> Column:
    """PROBE for numbers too small to conclude from."""
    return F.when(n < least, "PROBE").otherwise("")


def failure_class(router: Column, validator: Column) -> Column:
    """router_fail before validator_fail; none if both hold (a missing verdict is a failure)."""
    return F.when(~F.coalesce(router, F.lit(False)), "router_fail").when(~F.coalesce(validator, F.lit(False)), "validator_fail").otherwise("none")
