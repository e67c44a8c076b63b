"""Sharding along a Hilbert curve over document metadata.

Several metadata dimensions are quantised to a few bits each; a row's place on
the Hilbert curve through that grid is its sort key, and equal runs of the
order are the shards. Rows that are near in all dimensions fall into the same
few shards, so a filter on any of them prunes files.

The law is ``rows``: shard counts are at most one apart. Only metadata moves:
it is range-partitioned by (curve index, key), sorted, written to the shared
checkpoint folder, and ranked by per-partition counts and their prefix sums.
The key breaks curve ties, so a grid cell with a third of all rows is dealt
over many partitions. Texts move only in ``write_shards``. Rows with equal
texts are not kept together: counts that differ by one at most rule that out.

Defined results: null values quantise to 0 and null keys sort first; a null
text has size 16 and the checksum of no bytes; rows with equal keys are ordered
by size and checksum; an empty table gives no rows; input columns whose names
clash with the result's are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.llm.common import cut, documents, ship

BITS = 4


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the curve of integer grid cells (rows by dimensions).

    The cell's axes are turned into the curve's transposed index by undoing
    rotations from the top bit down and Gray-coding, then interleaved.
    """
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    top, bit = len(x) - 1, 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(len(x)):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
        bit >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[top] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            index = index << 1 | ((x[d] ^ turn) >> b & 1)
    return index


def by_hash(column: str, bits: int = BITS) -> Column:
    """A cell for a category: equal values share it."""
    return F.coalesce(F.pmod(F.xxhash64(column), F.lit(1 << bits)), F.lit(0)).cast("int")


def by_log(column: Column, bits: int = BITS) -> Column:
    """A cell for a size: powers of two, the last one open."""
    return F.least(F.floor(F.log2(F.greatest(column, F.lit(1)))).cast("int"), F.lit((1 << bits) - 1))


def by_range(column: str, low, high, bits: int = BITS) -> Column:
    """A cell for a number: equal widths between the bounds."""
    if low is None or high == low:
        return F.lit(0)
    width = (float(high) - float(low)) / (1 << bits)
    return F.coalesce(F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("int"), F.lit((1 << bits) - 1)), F.lit(0))


def assign(rows: DataFrame, cells: list[Column], ties: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """Add curve, shard and slot to (narrow) rows, by the law ``rows``."""

    @F.pandas_udf("long")
    def curve(*grid: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([g.to_numpy() for g in grid]), bits))

    ship(rows.sparkSession)
    placed = rows.withColumn("curve", curve(*cells))
    ordered = cut(placed.repartitionByRange("curve", *ties).sortWithinPartitions("curve", *ties))
    marked = ordered.withColumn("_id", F.monotonically_increasing_id())
    marked = marked.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    # one row per partition: what is collected and broadcast has that many rows
    counts = sorted((r["_part"], r["count"]) for r in marked.groupBy("_part").count().collect())
    total = sum(n for _, n in counts)
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    bases = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _base long"))
    rank = F.col("_base") + F.col("_at")
    out = marked.join(bases, "_part").withColumn("_rank", rank)
    out = out.withColumn("shard", F.expr(f"cast(_rank * {shards} div {max(total, 1)} as int)"))
    out = out.withColumn("slot", F.expr(f"_rank - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}"))
    return out.drop("_id", "_part", "_at", "_base", "_rank")


def shard_documents(docs: DataFrame, shards: int = 40, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every document; with ``carry`` its whole row as ``_row``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []),
    )
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cells = [by_hash("lang"), by_hash("source"), by_log(F.col("size")), by_range("doc_id", low, high)]
    return assign(narrow, cells, ["doc_id", "size", "text_crc32"], shards)


def write_shards(docs: DataFrame, folder: str, shards: int = 40) -> None:
    """Write the documents as one Parquet folder per shard, in slot order.

    Whole rows go along the curve, so no key has to find them again: repeated
    and null keys stay as many rows as they were. Columns named shard or slot
    give way to the new ones.
    """
    placed = shard_documents(docs, shards, carry=True)
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    placed.select("shard", "slot", *kept).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)


def op7_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
