"""The folder that all executors share, and what is written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(spark: SparkSession) -> None:
    """A session setting that right results need.

    In Spark 4.1 a union claims the partitioning that its children have in
    common. An aggregate above it then goes without a shuffle, and counts a key
    twice where one child is dealt another way in the end (tests/test_unions.py).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the session is local (tests) a temporary
    folder takes its place; on a cluster that would lose data, so it fails.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomspan-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A path for a new folder there."""
    settle(spark)
    root = shared_dir(spark)
    if not re.match(r"\w+:", root):
        root = f"file://{root}"
    return f"{root}/loomspan-{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    settle(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
