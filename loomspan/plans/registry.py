"""The queries on the driver's tables, each with its SQL for DuckDB where it has one."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""

    def keep(make):
        name = make.__name__
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        QUERIES[name].__doc__ = inspect.getdoc(make)
        if sql:
            SQL[name] = inspect.cleandoc(sql)
        return make

    return keep
