"""Merged shard records: inventory, partition, repaired rows and successful samples, behind leakage checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomspan.functions.drift import gate
from loomspan.operators import lineage
from loomspan.operators.generation import partition_of
from loomspan.operators.summaries import ratio
from loomspan.shared import cut
from loomspan.sources import sinks

PARTS = ("sampling_rescuable", "scaffold_only", "neither")


def partition_counts(records: DataFrame) -> DataFrame:
    """One row: records, each part, repaired ones, and their shares (0.0 of nothing)."""
    n = lambda c: F.count_if(c)
    repaired, total = n(F.col("teacher_success")), F.count("*")
    columns = [total.alias("total_failures"), repaired.alias("repaired_count")]
    for part in PARTS:
        columns += [n(F.col("partition") == part).alias(part), ratio(n(F.col("partition") == part), total).alias(f"{part}_rate")]
    for part in PARTS[:2]:
        columns.append(ratio(n((F.col("partition") == part) & F.col("teacher_success")), repaired).alias(f"{part}_repaired_rate"))
    return records.agg(*columns)


def inventory(records: DataFrame, least: int = 50) -> DataFrame:
    """One row: the number of repaired records, the gate, and how many each function and failure class has."""
    repaired = records.filter("teacher_success")
    spread = lambda c: repaired.groupBy(F.coalesce(c, F.lit("")).alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias(f"by_{c}"))  # noqa: E731  a row a kind
    counts = repaired.agg(F.count("*").alias("repaired_count")).withColumn("gate", gate(F.col("repaired_count"), least))
    return counts.join(spread("function_name"), F.lit(True)).join(spread("failure_class"), F.lit(True))  # one row each


@dataclass
class Merged:
    records: DataFrame
    inventory: DataFrame
    partition: DataFrame
    repaired: DataFrame
    samples: DataFrame


def merge_shards(rows: DataFrame, key: str, forbidden: dict[str, DataFrame], folder: str | None = None, least: int = 50) -> Merged:
    """From a run's merged rows (``ord``, ``hits``, ``teacher_success``, ``successful``) to the four outputs, written on wish.

    Raises, before anything is written, if a repaired record is in a forbidden id set.
    """
    records = cut(rows.withColumn("partition", partition_of(F.col("hits"), F.col("teacher_success"))))
    repaired = records.filter("teacher_success")
    for label, ids in forbidden.items():
        lineage.assert_disjoint(repaired, ids, key, f"repaired records and {label}")
    columns = ["ord", key, "failure_class", "function_name", "partition"]
    samples = records.select(*columns, F.explode("successful").alias("sample_index"))
    made = Merged(records, inventory(records, least), partition_counts(records), repaired.select(*columns), samples)
    if folder is not None:
        sinks.write_document(made.inventory, f"{folder}/inventory")
        sinks.write_document(made.partition, f"{folder}/partition")
        sinks.write_jsonl(made.repaired.orderBy("ord"), f"{folder}/repaired")
        sinks.write_jsonl(made.samples.orderBy("ord", "sample_index"), f"{folder}/samples")
    return made
