"""The external-model surface: seeded requests, batched calls, pass@k records.

A runner is any callable on a pandas batch of requests; what it returns is
data. It is built once per partition, and never sees rows that need no model:
those are split off before the call and united after it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.operators.ordering import stable_int


def requests(episodes: DataFrame, key: str, seed: int, tag: str, samples: int = 16, batch: int = 4) -> DataFrame:
    """One row per batch of samples: offset, size and a seed derived from the offset."""
    rows = episodes.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(batch))))
    return rows.withColumns({"size": F.least(F.lit(batch), F.lit(samples) - F.col("offset")), "seed": stable_int(seed, F.col(key), F.lit(tag), F.col("offset"))})


def generate(rows: DataFrame, make_runner: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a runner, in Arrow batches."""

    def run(batches):
        runner = make_runner()
        for batch in batches:
            if len(batch):
                yield runner(batch)

    return rows.mapInPandas(run, schema)


def generate_where(rows: DataFrame, needed: Column, make_runner, schema: str, otherwise: dict[str, Column]) -> DataFrame:
    """As ``generate`` for rows that need it; the others get fixed columns without a call."""
    asked = generate(rows.filter(needed), make_runner, schema)
    rest = rows.filter(~F.coalesce(needed, F.lit(False))).withColumns(otherwise)
    return asked.unionByName(rest.select(*asked.columns))


def pass_records(samples: DataFrame, key: str, success: str = "success", index: str = "sample_index") -> DataFrame:
    """Hits and successful samples of each episode (a fixed number of samples each)."""
    good = F.array_sort(F.collect_list(F.when(F.col(success), F.col(index))))
    return samples.groupBy(key).agg(F.count_if(F.col(success)).alias("hits"), F.count("*").alias("sample_count"), good.alias("successful"))


def partition_of(hits: Column, scaffold: Column) -> Column:
    """sampling_rescuable before scaffold_only before neither."""
    return F.when(hits > 0, "sampling_rescuable").when(scaffold, "scaffold_only").otherwise("neither")
