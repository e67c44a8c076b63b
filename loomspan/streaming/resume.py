"""Incremental collection: each record is judged once, however often it arrives.

Which keys were seen is state in the state store (RocksDB, a flag a key,
checkpointed with the query), so a micro-batch looks up its own keys and reads
nothing of the sink. New rows are judged and written in saves of a bounded
number of rows, each with a commit record; a batch that is run again after a
crash goes on behind its last save.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.ordering import positions
from loomspan.sources.commits import Saves

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def new_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a stream whose key comes for the first time; of several in one batch the least (nulls first)."""
    rest = [c for c in rows.columns if c != key]

    def first(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, least = state.exists, None
        for frame in frames:
            if known:
                continue
            frame = frame if least is None else pd.concat([least, frame])
            least = frame.sort_values(rest, key=lambda c: c.map(repr) if c.map(lambda v: isinstance(v, (dict, list, tuple))).any() else c, na_position="first").head(1) if rest else frame.head(1)
        if not known and least is not None:
            state.update((True,))
            yield least

    return rows.groupBy(key).applyInPandasWithState(first, rows.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def save_in_parts(saves: Saves, rows: DataFrame, key: str, judge: Callable[[DataFrame], DataFrame], label: str, every: int) -> int:
    """Judge and save ``rows`` in the order of their key, ``every`` rows a save; saves that stand are left. The number of saves."""
    placed = positions(rows, [key], "_at")  # written once; the key is unique, so a second run cuts the same parts
    parts = placed.select(F.max(F.floor((F.col("_at") - 1) / every)).alias("last")).first()["last"]
    for k in range(0 if parts is None else parts + 1):
        saves.write(f"{label}-{k:08d}", judge(placed.filter((F.col("_at") > k * every) & (F.col("_at") <= (k + 1) * every)).drop("_at")))
    return 0 if parts is None else parts + 1


def collect_stream(
    spark: SparkSession, source: str, schema: str, key: str, judge: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, save_every: int = 1_000_000
) -> StreamingQuery:
    """Start a query that saves ``judge(rows)`` for keys that no earlier batch had; run with availableNow.

    ``judge`` keeps the key. The sink is a folder of ``Saves``.
    """
    spark.conf.set(*STORE)
    saves = Saves(spark, sink)
    stream = new_keys(spark.readStream.schema(schema).json(source), key)

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()  # the ranges of the saves take a look at the keys first; state must not be asked twice
        try:
            save_in_parts(saves, rows, key, judge, f"{number:010d}", save_every)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, success: str = "success", arm: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number and success rate per arm and event-time window, for a stream or a table with ``ts`` and a boolean ``success``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rates = rows.groupBy(F.window("ts", width).alias("w"), arm).agg(F.count("*").alias("n"), F.avg(F.col(success).cast("int")).alias("rate"))
    return rates.select(F.col("w.start").alias("start"), arm, "n", "rate")
