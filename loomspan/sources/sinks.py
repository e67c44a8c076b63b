"""Sinks: rows as JSON lines or Parquet by Spark; small reports as one document."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, functions as F


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_named(df: DataFrame, path: str, name: str) -> None:
    """Rows as JSON lines in a folder for each value of ``name`` (for ``records.named_jsonl``); every task writes its own part of each."""
    df.withColumnRenamed(name, "name").write.partitionBy("name").json(path)


def write_file(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in one file of this name (for sources that tell categories by file names)."""
    spark, partial = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.json(partial)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(partial), hadoop.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    written = store.globStatus(hadoop.Path(f"{partial}/part-*"))
    store.delete(target, False)
    if len(written):
        store.rename(written[0].getPath(), target)
    else:
        store.create(target).close()
    store.delete(folder, True)


def write_with_counts(df: DataFrame, path: str, key: str) -> dict:
    """Write rows and return their number and that of distinct keys, read back."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").json(path)
    rows = seen.get["rows"]
    return {"rows": rows, "unique": df.sparkSession.read.json(path).select(key).distinct().count() if rows else 0}


def write_by_seed(df: DataFrame, path: str) -> None:
    """Progressive output: only the seeds at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seed").parquet(path)


def append_unseen(df: DataFrame, path: str, key: str, seen: DataFrame | None) -> None:
    """Resume: append the rows whose key the sink does not hold."""
    (df if seen is None else df.join(seen.select(key), key, "left_anti")).write.mode("append").parquet(path)


def report_rows(summary: DataFrame, most: int = 10_000) -> list:
    """A report's rows on the driver; a report of more rows than ``most`` is no report."""
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def document(summary: DataFrame, most: int = 10_000) -> str:
    """A report's rows as pretty JSON."""
    return json.dumps([r.asDict(recursive=True) for r in report_rows(summary, most)], indent=2, ensure_ascii=False, sort_keys=True, default=str)


def write_document(summary: DataFrame, path: str) -> None:
    spark = summary.sparkSession
    spark.createDataFrame([(document(summary),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(summary: DataFrame, title: str, most: int = 10_000) -> str:
    """A report's rows as a table: numbers with four places, missing values as NA."""
    rows = report_rows(summary, most)
    shown = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows]) + "\n"
