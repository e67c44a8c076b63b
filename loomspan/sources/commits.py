"""Commit records: what is written counts only once a record of it stands.

Rows go to a folder of their own; a record, one small JSON file, is then put
in place by a rename that never replaces a file. Whoever comes second is told
so, and rows without a record are not read. A lost executor or driver leaves
rows without a record at worst, which the next run writes anew.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomspan.sources.records import exists


def digest(key: str) -> list[Column]:
    """n and sum_hash, which tell sets of ids apart whatever the order."""
    return [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash")]


def publish(spark: SparkSession, path: str, record: dict) -> bool:
    """Put the record in place; False if one stands there already."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    store = target.getFileSystem(conf)
    store.mkdirs(target.getParent())
    draft = hadoop.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else hadoop.FileContext.getFileContext(conf)
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(draft, target, options)  # without OVERWRITE it fails where a file stands
    except Py4JJavaError as error:
        store.delete(draft, False)
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def published(spark: SparkSession, folder: str, schema: str) -> list:
    """The records of a folder (as many as were published)."""
    return spark.read.schema(schema).json(folder).collect() if exists(spark, folder) else []


SAVE = "name string, n long"


class Saves:
    """A sink written save by save; a save that has its record is never written again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def names(self) -> set[str]:
        return {r["name"] for r in published(self.spark, f"{self.folder}/_commits", SAVE)}

    def write(self, name: str, rows: DataFrame) -> bool:
        """Write and commit one save; False if it stands already."""
        if exists(self.spark, f"{self.folder}/_commits/{name}.json"):
            return False
        path = f"{self.folder}/save={name}"
        rows.write.mode("overwrite").parquet(path)
        return publish(self.spark, f"{self.folder}/_commits/{name}.json", {"name": name, "n": self.spark.read.parquet(path).count()})

    def read(self) -> DataFrame | None:
        """The rows of the committed saves; None before the first."""
        names = sorted(self.names())
        if not names:
            return None
        return self.spark.read.option("basePath", self.folder).parquet(*(f"{self.folder}/save={n}" for n in names)).drop("save")
