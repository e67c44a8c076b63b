"""Targets of the log-probability probe: families of outputs to be scored, with fragile flags and flipped outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.operators.ordering import keep_first

TARGET = ("target_id", "target_family", "episode_id", "split", "partition", "target_output", "function_name")


def _named(rows: DataFrame, prefix: Column, family: Column) -> DataFrame:
    return rows.withColumns({"target_id": F.concat_ws(":", prefix, "episode_id"), "target_family": family})


def repaired(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Repaired episodes of train and validation (``rows``: episode_id, partition, target_output, function_name); repeats count once."""
    placed = rows.join(split.select("episode_id", F.col("part").alias("split")), "episode_id").filter(F.col("split").isin("train", "validation"))
    named = _named(placed, F.concat(F.lit("teacher:"), "split"), F.concat("split", F.lit("_teacher_repaired")))
    named = named.withColumn("partition", F.coalesce("partition", F.lit("unknown")))
    return keep_first(named.select(*TARGET), ["target_family", "episode_id", "target_output"], F.struct("function_name", "partition"))


def sampled(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Successful samples of training episodes, one for each episode and call (``sample_index`` least)."""
    train = split.filter("part = 'train'").select("episode_id")
    first = keep_first(rows.join(train, "episode_id", "left_semi"), ["episode_id", "target_output"], "sample_index")
    named = _named(first.withColumn("split", F.lit("train")), F.lit("base_pass16:train"), F.lit("train_base_pass16_success"))
    return named.withColumn("partition", F.coalesce("partition", F.lit("unknown"))).select(*TARGET)


def kept_right(rows: DataFrame, outcomes: DataFrame, shared: list[str], united: list[str]) -> DataFrame:
    """Episodes that the base gets right, with ``first_shared_fragile``, ``united_fragile`` and ``flipped_outputs`` (run to output).

    ``outcomes`` (run, episode_id, success, output) are the trained runs' results: an episode is fragile if all of
    ``shared`` fail, or any of ``united``; flipped outputs are those of runs that fail with a call. There are few runs.
    """
    wrong = ~F.coalesce(F.col("success"), F.lit(False))
    missed = lambda runs: F.count_distinct(F.when(F.col("run").isin(runs) & wrong, F.col("run")))
    flips = F.array_sort(F.collect_set(F.when(wrong & F.col("output").isNotNull(), F.struct("run", "output"))))
    per = outcomes.groupBy("episode_id").agg(missed(shared).alias("s"), missed(united).alias("u"), flips.alias("flips"))
    named = _named(rows, F.lit("r_success_correct"), F.lit("r_success_correct")).withColumns({"split": F.lit("r_success_eval"), "partition": F.lit("r_success")})
    joined = named.select(*TARGET).join(per, "episode_id", "left")
    return joined.select(
        *TARGET,
        F.coalesce(F.col("s") == len(set(shared)), F.lit(False)).alias("first_shared_fragile"),
        F.coalesce(F.col("u") > 0, F.lit(False)).alias("united_fragile"),
        F.map_from_entries(F.coalesce("flips", F.array().cast("array<struct<run:string,output:string>>"))).alias("flipped_outputs"),
    )


def families(repaired_rows: DataFrame, samples: DataFrame, right: DataFrame, split: DataFrame, outcomes: DataFrame, shared: list[str], united: list[str]) -> DataFrame:
    """All targets; flags and flips are null but for the episodes that the base gets right."""
    kept = kept_right(right, outcomes, shared, united)
    return repaired(repaired_rows, split).unionByName(sampled(samples, split)).unionByName(kept, allowMissingColumns=True)
