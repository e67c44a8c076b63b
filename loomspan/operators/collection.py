"""Collection as one procedure: scan, sort, resume, generate, judge, save every N, report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomspan.functions import calls
from loomspan.functions.drift import failure_class
from loomspan.operators.generation import generate
from loomspan.operators.ordering import positions
from loomspan.sources.commits import Saves

Runner = Callable[[str], str]

#: A record: the episode's columns, what the model said, and the verdicts.
EPISODE = "episode_id string, split string, category string, query string, function_pool string, ground_truth string"
RECORD = (
    "episode_id string, split string, category string, query string, function_pool string, ground_truth_call string, predicted_call string, "
    "raw_model_output string, parse_error string, router_success boolean, validator_success boolean, call_success boolean, failure_class string, latency_ms long"
)


def record(row: dict, output: str, latency_ms: int) -> dict:
    """The record of an episode: its columns, the output parsed (or why not) and its verdicts; no call is a call of nothing."""
    truth, predicted, error = json.loads(row["ground_truth"]), None, None
    try:
        got = calls.call_in_output(output)
        predicted = {"name": got.name, "arguments": got.arguments}
    except calls.NotACall as why:
        error = str(why)
    router, validator, call = calls.verdict(predicted or {"name": "", "arguments": {}}, truth)
    plain = lambda v: None if v is None else json.dumps(v, sort_keys=True, ensure_ascii=False)
    kept = {c: row[c] for c in ("episode_id", "split", "category", "query", "function_pool")}
    made = {"ground_truth_call": plain(truth), "predicted_call": plain(predicted), "raw_model_output": output, "parse_error": error}
    return kept | made | {"router_success": router, "validator_success": validator, "call_success": call, "latency_ms": latency_ms}


def judged(rows: DataFrame, make_runner: Callable[[], Runner], prompt: str = "query") -> DataFrame:
    """Records of episodes: the runner is built once a task, asked once an episode."""

    def build():
        run = make_runner()

        def batch(frame: pd.DataFrame) -> pd.DataFrame:
            made = []
            for row in frame.to_dict("records"):
                began = time.monotonic()
                output = run(row[prompt])
                made.append(record(row, output, int((time.monotonic() - began) * 1000)))
            return pd.DataFrame(made)

        return batch

    schema = ", ".join(c for c in RECORD.split(", ") if not c.startswith("failure_class"))
    out = generate(rows, build, schema).withColumn("failure_class", failure_class(F.col("router_success"), F.col("validator_success")))
    return out.select(*(c.split()[0] for c in RECORD.split(", ")))


def collect(episodes: DataFrame, order: list[str], make_runner: Callable[[], Runner], folder: str, save_every: int = 100_000, most_saves: int | None = None, limit: int | None = None) -> DataFrame:
    """Collect the episodes in ``order`` (its last column is the unique ``episode_id``), ``save_every`` a save.

    Episodes of committed saves are not asked again; a run that was lost, or
    ended after ``most_saves`` saves, is taken up by the next. Gives all
    records so far.
    """
    saves = Saves(episodes.sparkSession, folder)
    rows = episodes if limit is None else episodes.orderBy(*order).limit(limit)
    known = saves.read()
    if known is not None:
        rows = rows.join(known.select("episode_id"), "episode_id", "left_anti").select(*rows.columns)
    placed = positions(rows, order, "_at")
    n, base = placed.count(), len(saves.names())
    for k in range(-(-n // save_every) if most_saves is None else min(most_saves, -(-n // save_every))):
        part = placed.filter((F.col("_at") > k * save_every) & (F.col("_at") <= (k + 1) * save_every)).drop("_at")
        saves.write(f"{base + k:010d}", judged(part, make_runner))
    found = saves.read()
    return episodes.sparkSession.createDataFrame([], RECORD) if found is None else found


def summary(records: DataFrame) -> DataFrame:
    """Per split: numbers of records and failures of either class, and the two checks of a useful collection."""
    n = lambda c: F.count_if(c)
    failed = n(~F.col("call_success"))
    return records.groupBy("split").agg(
        F.count("*").alias("n_total"),
        failed.alias("n_failures"),
        n(F.col("failure_class") == "router_fail").alias("n_router_fail"),
        n(F.col("failure_class") == "validator_fail").alias("n_validator_fail"),
        (failed > 0).alias("some_fail"),
        (failed < F.count("*")).alias("some_pass"),
    )


def assert_useful(records: DataFrame) -> None:
    """Raise with the splits in which all calls fail or none does."""
    bad = [r.asDict() for r in summary(records).filter("NOT (some_fail AND some_pass)").orderBy("split").limit(20).collect()]
    if bad:
        raise ValueError(f"splits without failures or without successes: {bad}")
