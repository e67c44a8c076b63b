"""What loaded splits look like, and whether they can be used: summary, coverage and the verifier's self-check."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from loomspan.functions import calls
from loomspan.operators.ordering import keep_first


def summary(rows: DataFrame, fields: list[str], pool_size: str = "pool_size") -> DataFrame:
    """Per split: episodes, smallest, largest and mean function pool, and how many rows have each field filled."""
    filled = [F.count_if(F.coalesce(F.col(c).cast("string") != "", F.lit(False))).alias(f"n_{c}") for c in fields]
    return rows.groupBy("split").agg(F.count("*").alias("n_episodes"), F.min(pool_size).alias("pool_min"), F.max(pool_size).alias("pool_max"), F.avg(pool_size).alias("pool_mean"), *filled)


def categories(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "category").agg(F.count("*").alias("n_episodes"))


def self_check(rows: DataFrame, order: str, truth: str = "ground_truth") -> DataFrame:
    """Per split, of its first row: whether the verifier takes the right call and refuses one with a wrong argument."""

    def verdicts(text):
        wanted = json.loads(text)
        right = calls.Call(calls.accepted_call(wanted).name, calls.first_arguments(wanted))
        wrong = calls.wrong_arguments(right)
        return json.dumps([calls.verdict({"name": c.name, "arguments": c.arguments}, wanted)[2] for c in (right, wrong)])

    first = keep_first(rows.select("split", F.col(order).alias("_at"), F.col(truth).alias("_truth")), ["split"], "_at")
    found = F.from_json(calls.text_udf(verdicts, "string", None)("_truth"), "array<boolean>")
    return first.select("split", found.alias("v")).select("split", F.get("v", F.lit(0)).alias("known_correct"), F.get("v", F.lit(1)).alias("known_wrong"))


def assert_usable(rows: DataFrame, fields: list[str], order: str, least_pools: dict[str, int], most_pools: dict[str, int]) -> None:
    """Raise with every split that is incomplete, has pools out of bounds, or fails the self-check, and for splits that are not there."""
    faults = []
    found = {r["split"]: r for r in summary(rows, fields).collect()}  # splits are few
    for name in {*least_pools, *most_pools} - set(found):
        faults.append((name, "no rows"))
    for name, r in found.items():
        faults += [(name, f"{c} filled in {r[f'n_{c}']} of {r['n_episodes']}") for c in fields if r[f"n_{c}"] != r["n_episodes"]]
        if r["pool_min"] < least_pools.get(name, 0) or r["pool_max"] > most_pools.get(name, r["pool_max"]):
            faults.append((name, f"pools of {r['pool_min']} to {r['pool_max']}"))
    faults += [(r["split"], "self-check") for r in self_check(rows, order).collect() if r["known_correct"] is not True or r["known_wrong"] is not False]
    if faults:
        raise ValueError(f"splits that can't be used: {sorted(faults)}")
