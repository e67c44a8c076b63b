"""Table functions: outputs to calls, records to information units, texts to tokens. Used by lateral joins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.functions import calls, patches

CALLS = "place int, name string, arguments string, error string"
UNITS = "place int, iu_id string, kind string, content string"


class _Calls:
    def eval(self, output: str):
        try:
            found = calls.calls_in_output(output or "")
        except (calls.NotACall, json.JSONDecodeError, RecursionError) as why:
            yield 0, None, None, str(why) or "no calls"
            return
        for place, call in enumerate(found, 1):
            yield place, None if call.name is None else str(call.name), json.dumps(call.arguments, sort_keys=True, ensure_ascii=False), None


class _Units:
    def eval(self, record: str):
        for place, unit in enumerate(patches.units(json.loads(record)) if record else (), 1):
            yield place, unit.id, unit.kind, json.dumps(unit.content, sort_keys=True, ensure_ascii=False)


calls_of = F.udtf(_Calls, returnType=CALLS, useArrow=True)
units_of = F.udtf(_Units, returnType=UNITS, useArrow=True)


def output_calls(rows: DataFrame, output: str) -> DataFrame:
    """A row for each call of each output, beside the row's own columns: place (from 1), name and arguments; an output without calls has one row of place 0 with its error."""
    return rows.alias("o").lateralJoin(calls_of(F.col(f"o.{output}").outer()))


def information_units(rows: DataFrame, record: str = "record") -> DataFrame:
    """A row for each information unit of each failure record (JSON); a record without units has none."""
    return rows.alias("o").lateralJoin(units_of(F.col(f"o.{record}").outer()))


def token_count(make_tokenizer: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Token counts of a text column by an injected tokenizer, built once a task; a null text has none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize = make_tokenizer()
        for texts in batches:
            yield pd.Series([0 if t is None else len(tokenize(t)) for t in texts], dtype="int64")

    return count
