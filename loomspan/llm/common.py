"""Small helpers the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomspan.shared import cut, drop_folder, fresh_folder, settle, shared_dir  # noqa: F401  the operators take them from here
from loomspan.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


#: Rows of a batch as the text operators see it.
BATCH_ROWS = 512


def give_back() -> None:
    """Return freed memory to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def map_batches(df: DataFrame, run: Callable, schema, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with this package at hand; ``rows`` bounds the batches that ``run`` sees."""
    ship(df.sparkSession)

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def task(batches):
        yield from run(sliced(batches) if rows else batches)
        give_back()  # the worker lives on, other tasks need the memory

    return df.mapInArrow(task, schema)


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df`` (cheap to count: read or cut) to be broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order (null: none)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def running_sums(values: Column) -> Column:
    """Sums of an array of longs up to each place, in log2(n) passes over it."""
    last = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    add = lambda sums, k: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - back(k)), F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), last), values, add)


def content_key(key: str = "doc_id", text: str = "text") -> Column:
    """A row's identity in the pipeline: its key and, as keys repeat or are missing, its text (96 bits of hash); never null, missing keys last."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("long"), F.hash(text).alias("short"))


def whole_row(df: DataFrame, but: str | None = None) -> Column:
    """The columns of ``df`` (but one) as one struct, so that no name of theirs meets a name of ours."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c != but))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
