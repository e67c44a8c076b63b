"""Names taken out of failure records: functions, fields, layers and errors get codes by first appearance.

The mapping is as long as the schemas of the functions are wide, not as the
table is long; it is sent to the tasks where its size allows it, else records
meet it by a join on their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomspan.functions.calls import renamed, text_udf
from loomspan.operators import ordering as o
from loomspan.shared import cut

#: Names up to which a mapping is sent to the tasks.
MOST_NAMES = 200_000
CODES = {"function": "fn_%04d", "field": "field_%04d", "layer": "layer_%02d", "error": "err_%02d"}
# Labels that get codes whether a record has them or not.
EXTRA_ERRORS = ("ParamError", "SchemaError", "FunctionError")


def _fields(value):
    if isinstance(value, dict):
        for name, inner in value.items():
            yield name
            yield from _fields(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from _fields(inner)


def names_in(failure: dict) -> list[tuple[str, str]]:
    """(kind, name) of all names of a record, in order of appearance."""
    truth, got = failure.get("ground_truth_call") or {}, failure.get("predicted_call") or {}
    pool = [f for f in failure.get("function_pool") or [] if isinstance(f, dict)]
    made = [("function", n) for n in (truth.get("name"), got.get("name"), *(f.get("name") for f in pool))]
    made += [("field", n) for part in (truth.get("accepted_arguments") or {}, got.get("arguments") or {}, pool) for n in _fields(part)]
    return [*((k, n) for k, n in made if n), ("error", failure.get("failure_class") or "none")]


def recoded(failure: dict, codes: dict[str, dict]) -> dict:
    """The record with its names replaced; the class stays, its code stands beside it."""
    function, field = codes["function"], codes["field"]

    def call(value, part):
        return value and {**value, "name": function.get(value.get("name"), value.get("name"))} | ({part: renamed(value[part], field)} if part in value else {})

    made = dict(failure)
    made["ground_truth_call"] = call(failure.get("ground_truth_call"), "accepted_arguments")
    made["predicted_call"] = call(failure.get("predicted_call"), "arguments")
    made["function_pool"] = [call(f, "parameters") if isinstance(f, dict) else f for f in failure.get("function_pool") or []]
    trace = dict(failure.get("trace") or {})
    for key, kind in (("harness_layer", "layer"), ("error_label", "error")):
        if key in trace:
            trace[key] = codes[kind].get(trace[key], trace[key])
    made["trace"] = trace
    made["decoupled_failure_label"] = codes["error"].get(failure.get("failure_class") or "none")
    return made


def mapping(failures: DataFrame, layers: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, code), names in the order of their first appearance by ``ord`` and place in the record."""
    listed = text_udf(lambda s: json.dumps(list(dict.fromkeys(names_in(json.loads(s))))), "string", None)
    rows = failures.select("ord", F.posexplode(F.from_json(listed("record"), "array<array<string>>")).alias("place", "n"))
    firsts = rows.groupBy(F.col("n")[0].alias("kind"), F.col("n")[1].alias("name")).agg(F.min(F.struct("ord", "place")).alias("first"))
    fixed = [("layer", n, i) for i, n in enumerate(layers)] + [("error", n, (1 << 40) + i) for i, n in enumerate(EXTRA_ERRORS)]
    extra = failures.sparkSession.createDataFrame(fixed, "kind string, name string, ord long").withColumn("first", F.struct("ord", F.lit(0).alias("place")))
    whole = cut(firsts.unionByName(extra.select("kind", "name", "first")).groupBy("kind", "name").agg(F.min("first").alias("first")))
    made = None
    for kind, code in CODES.items():
        placed = o.positions(whole.filter(F.col("kind") == kind), ["first", "name"]).select("kind", "name", F.format_string(code, "position").alias("code"))
        made = placed if made is None else made.unionByName(placed)
    return made


@dataclass
class Decoupled:
    mapping: DataFrame
    failures: DataFrame
    invariants: dict


def _looked_up(failure: dict) -> list[tuple[str, str]]:
    """All (kind, name) that ``recoded`` asks for."""
    trace = failure.get("trace") or {}
    more = [(kind, trace[key]) for key, kind in (("harness_layer", "layer"), ("error_label", "error")) if isinstance(trace.get(key), str)]
    return list(dict.fromkeys([*names_in(failure), *more]))


def _by_map(failures: DataFrame, codes: DataFrame) -> DataFrame:
    """Few names: the mapping goes to the tasks."""
    known = {kind: {} for kind in CODES}
    for r in codes.collect():  # at most MOST_NAMES rows
        known[r["kind"]][r["name"]] = r["code"]
    shipped = failures.sparkSession.sparkContext.broadcast(known)
    recode = text_udf(lambda s: json.dumps(recoded(json.loads(s), shipped.value), ensure_ascii=False), "string", None)
    return failures.withColumn("record", recode("record"))


def _by_join(failures: DataFrame, codes: DataFrame) -> DataFrame:
    """Any number of names: each record's own names meet the dictionary and come back to it as a short list."""
    listed = text_udf(lambda s: json.dumps(_looked_up(json.loads(s))), "string", None)
    names = failures.select("ord", F.explode(F.from_json(listed("record"), "array<array<string>>")).alias("n"))
    met = names.select("ord", F.col("n")[0].alias("kind"), F.col("n")[1].alias("name")).join(codes, ["kind", "name"])
    own = met.groupBy("ord").agg(F.to_json(F.collect_list(F.struct("kind", "name", "code"))).alias("_codes"))  # the names of a record

    def recode(record, short):
        known = {kind: {} for kind in CODES}
        for row in json.loads(short or "[]"):
            known[row["kind"]][row["name"]] = row["code"]
        return json.dumps(recoded(json.loads(record), known), ensure_ascii=False)

    joined = failures.join(own, "ord", "left").withColumn("record", text_udf(recode, "string", None)("record", "_codes"))
    return joined.select(*failures.columns)


def invariants(failures: DataFrame, made: DataFrame, codes: DataFrame) -> dict:
    """The six checks: classes as before, each kind's mapping one to one, no function's code an original name."""
    classes = lambda rows: rows.groupBy(F.get_json_object("record", "$.failure_class").alias("c")).agg(F.count("*").alias("n"))
    same = classes(failures).exceptAll(classes(made)).union(classes(made).exceptAll(classes(failures))).isEmpty()
    holds = {"failure_class_distribution_preserved": same}
    counts = {r["kind"]: r["n"] == r["n_codes"] == r["n_names"] for r in codes.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"), F.countDistinct("name").alias("n_names")).collect()}
    for kind in CODES:
        holds[f"{kind}_mapping_bijective"] = counts.get(kind, True)
    functions = codes.filter("kind = 'function'")
    holds["no_decoupled_function_name_equals_original"] = functions.join(functions.select(F.col("code").alias("name")), "name", "left_semi").isEmpty()
    return holds


def decouple(failures: DataFrame, layers: tuple[str, ...] = ()) -> Decoupled:
    """Records (ord, failure_class, record) recoded; raises unless all six invariants hold."""
    codes = cut(mapping(failures, layers))
    made = cut(_by_map(failures, codes) if codes.count() <= MOST_NAMES else _by_join(failures, codes))
    holds = invariants(failures, made, codes)
    if not all(holds.values()):
        raise ValueError(f"decoupling broke {[k for k, ok in holds.items() if not ok]}")
    return Decoupled(codes, made, holds)
