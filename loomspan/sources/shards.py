"""Shard runs: a manifest, runs that can be lost and taken up again, and an exact merge.

``prepare`` deals the items in order over the shards and writes them with a
manifest: how many ids each shard has and the digest of them. ``run`` works on
the shards that have no commit yet, a group of them in one job, under an
attempt name of its own; a shard whose rows carry exactly its ids is committed,
any other is refused. ``merge`` reads the committed attempts, checks them
against the items once more and gives the rows in the items' order.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from loomspan.operators import lineage
from loomspan.operators.ordering import positions
from loomspan.sources.commits import digest, publish, published
from loomspan.sources.records import exists

COMMIT = "shard int, attempt string, n long, sum_hash string"


class ShardRun:
    """A folder with items, manifest, attempts and commits; ``key`` is the items' unique id."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key

    def prepare(self, items: DataFrame, order: list, shards: int) -> None:
        """Write items with ``ord`` (place in the order, from 1) and ``shard`` (dealt in turn), then the manifest; a prepared run stays as it is."""
        if exists(self.spark, f"{self.folder}/manifest/_SUCCESS"):
            return
        placed = positions(items, order, "ord").withColumn("shard", ((F.col("ord") - 1) % shards).cast("int"))
        placed.write.mode("overwrite").partitionBy("shard").parquet(f"{self.folder}/items")
        self.spark.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/schema")
        numbers = self.spark.range(shards).select(F.col("id").cast("int").alias("shard"))
        rows = numbers.join(self.items().groupBy("shard").agg(*digest(self.key)), "shard", "left").na.fill({"n": 0, "sum_hash": "0"})
        rows.write.mode("overwrite").parquet(f"{self.folder}/manifest")

    def items(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schema").first()["value"]))  # there may be no file to take it from
        return self.spark.read.schema(schema).parquet(f"{self.folder}/items")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def commits(self) -> list:
        """(shard, attempt, n, sum_hash) of the shards that are done."""
        return published(self.spark, f"{self.folder}/commits", COMMIT)

    def missing(self) -> list[int]:
        done = {c["shard"] for c in self.commits()}
        return sorted(r["shard"] for r in self.manifest().select("shard").collect() if r["shard"] not in done)

    def run(self, work: Callable[[DataFrame], DataFrame], shards: list[int] | None = None, at_once: int = 64) -> list[int]:
        """Give the missing shards (of ``shards``) to ``work``, which keeps key and ``shard``; the shards committed by this call.

        Raises after the commits of a group if some of its shards do not carry their ids.
        """
        todo = [s for s in self.missing() if shards is None or s in shards]
        done = []
        for k in range(0, len(todo), at_once):
            group, attempt = todo[k : k + at_once], uuid.uuid4().hex
            path = f"{self.folder}/attempts/{attempt}"
            work(self.items().filter(F.col("shard").isin(group))).write.partitionBy("shard").parquet(path)
            done += self.commit(attempt, group)
        return done

    def commit(self, attempt: str, group: list[int]) -> list[int]:
        """Publish those shards of an attempt that carry exactly the manifest's ids; raise for the others."""
        path = f"{self.folder}/attempts/{attempt}"
        parts = self.spark.read.parquet(path) if exists(self.spark, f"{path}/shard=*") else None
        found = {r["shard"]: (r["n"], r["sum_hash"]) for r in parts.groupBy("shard").agg(*digest(self.key)).collect()} if parts is not None else {}
        done, refused = [], []
        for row in self.manifest().filter(F.col("shard").isin(group)).orderBy("shard").collect():
            shard, wanted = row["shard"], (row["n"], row["sum_hash"])
            if found.get(shard, (0, "0")) != wanted:
                refused.append((shard, found.get(shard, (0, "0"))[0], wanted[0]))
            elif publish(self.spark, f"{self.folder}/commits/{shard:06d}.json", {"shard": shard, "attempt": attempt, "n": wanted[0], "sum_hash": wanted[1]}):
                done.append(shard)
        if refused:
            raise ValueError(f"shards that do not carry their ids (shard, rows, wanted): {refused[:20]}")
        return done

    def merge(self) -> DataFrame:
        """The rows of all shards with ``ord``, in order; raises while shards are missing or if they do not cover the items exactly."""
        if missing := self.missing():
            raise ValueError(f"shards without a commit: {missing[:20]}")
        by_attempt = defaultdict(list)
        for c in self.commits():
            if c["n"]:
                by_attempt[c["attempt"]].append(c["shard"])
        rows = None
        for attempt, shards in sorted(by_attempt.items()):  # an attempt is a folder; there are few
            part = self.spark.read.parquet(f"{self.folder}/attempts/{attempt}").filter(F.col("shard").isin(shards))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.items()
        return lineage.merge_exact(rows.drop("ord"), self.items(), self.key, "ord")
