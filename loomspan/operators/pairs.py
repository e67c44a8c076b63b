"""The pairing probe: a stratified choice of failures, a structured and a prose patch of each, and the checks on them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from loomspan.functions import calls, patches as p
from loomspan.operators import ordering as o
from loomspan.operators.summaries import ratio


def choose(failures: DataFrame, n: int, per_class: int) -> DataFrame:
    """``per_class`` failures of either class, filled up to n by class: smallest pools first, then by id."""
    size = F.coalesce(F.json_array_length(F.get_json_object("record", "$.function_pool")), F.lit(0))
    rows = failures.withColumn("pool_size", size)
    return o.stratified_sample(rows, "failure_class", ["pool_size", "episode_id"], per_class, n).drop("pool_size")


def _clean(record: str, plain: str, padded: str) -> bool:
    return not p.leaked(padded[len(plain) :], p.forbidden(p.units(json.loads(record))))


def pairs(failures: DataFrame) -> DataFrame:
    """One row a failure: token counts of its three patches, their ratios, and whether units, lengths and padding are as they must be."""
    of = lambda family, column: F.max(F.when(F.col("family") == family, F.col(column)))
    short = dict(zip(p.FAMILIES, ("struct", "nl", "padded")))
    columns = [of(f, c).alias(f"{a}_{name}") for f, a in short.items() for c, name in (("patch_text", "text"), ("token_count", "tokens"), ("iu_ids", "ids"))]
    texts = p.materialize(failures).groupBy(F.col("trigger_episode_id").alias("episode_id")).agg(*columns)
    rows = failures.select("episode_id", "failure_class", "record").join(texts, "episode_id")
    clean = calls.text_udf(_clean, "boolean", False)
    return rows.select(
        "episode_id",
        "failure_class",
        *(F.col(f"{a}_tokens").cast("long").alias(f"{a}_tokens") for a in short.values()),
        ratio(F.col("struct_tokens"), F.col("nl_tokens")).alias("struct_to_nl"),
        ratio(F.col("padded_tokens"), F.col("struct_tokens")).alias("padded_to_struct"),
        ((F.col("struct_ids") == F.col("nl_ids")) & (F.col("nl_ids") == F.col("padded_ids"))).alias("same_units"),
        F.col("padded_tokens").between(F.col("struct_tokens") * 0.95, F.col("struct_tokens") * 1.05).alias("in_tolerance"),
        clean("record", "nl_text", "padded_text").alias("padding_without_information"),
    )


def assert_paired(made: DataFrame, n: int, per_class: int) -> None:
    """Raise unless there are n pairs, enough of either class, and all of them hold."""
    count = {r["failure_class"]: r["count"] for r in made.groupBy("failure_class").count().collect()}
    faults = [f"{sum(count.values())} pairs for {n}"] if sum(count.values()) != n else []
    faults += [f"{count.get(c, 0)} pairs of {c}" for c in ("router_fail", "validator_fail") if count.get(c, 0) < max(1, per_class)]
    bad = made.filter(~(F.col("same_units") & F.col("in_tolerance") & F.col("padding_without_information"))).select("episode_id").orderBy("episode_id").limit(20)
    faults += [r["episode_id"] for r in bad.collect()]
    if faults:
        raise ValueError(f"pairs that do not hold: {faults}")
