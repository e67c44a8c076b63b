"""Rules of the library on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import drift, patches as p, text as x
from loomspan.operators import decouple, ordering as o
from loomspan.operators.summaries import bootstrap_means
from loomspan.sources import sinks
from loomspan.streaming import resume


def test_reports_are_whole_or_fail(spark):
    rows = spark.range(5)
    assert sinks.markdown(rows, "R", most=5).count("\n") == 9
    for report in (sinks.document, lambda r, most: sinks.markdown(r, "R", most)):
        with pytest.raises(ValueError, match="more than 4 rows"):
            report(rows, 4)


def test_stable_names(spark):
    paths = ["a/b/main_r8_seed20260703.json", "x.tar.gz", "noend", ".hidden"]
    found = [r[0] for r in spark.createDataFrame([(s,) for s in paths], "s string").select(x.stable_name(F.col("s"))).collect()]
    assert found == ["main_r8", "x.tar", "noend", ".hidden"]


def test_whole_word_leaks(spark):
    rows = spark.createDataFrame([("Get_weather now", ["weather"]), ("the Weather.", ["weather"]), ("a+b", ["a+b"]), ("x", [])], "t string, w array<string>")
    assert [r[0] for r in rows.select(x.leaks_term(F.col("t"), F.col("w"))).collect()] == [False, True, True, False]


def test_positions(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([10**12, -5, 7, 7, 0])], "k long, i long")
    found = {(r.k, r.i): r.position for r in o.positions(rows, ["k", "i"]).collect()}
    assert found == {(-5, 1): 1, (0, 4): 2, (7, 2): 3, (7, 3): 4, (10**12, 0): 5}
    assert o.positions(rows.limit(0), ["k"]).count() == 0


def test_drift(spark):
    m = "map<string,int>"
    rows = [(True, "f", "f", {"a": 1, "b": 2}, {"a": 1, "c": 3}), (True, "f", "f", {"a": 1}, {"a": 2}), (True, "f", "g", {}, {}), (False, "f", None, {}, {}), (True, "f", "f", {"a": 1}, {"a": 1})]
    df = spark.createDataFrame(rows, f"ok boolean, a string, b string, old {m}, new {m}")
    c = df.select(drift.drift_type(df.ok, df.a, df.b, df.old, df.new), drift.subtype(df.old, df.new))
    assert [tuple(r) for r in c.collect()] == [("parameter_drift", "drop+add"), ("parameter_drift", "value"), ("function_flip", ""), ("format_drift", ""), ("none", "")]


def test_bootstrap(spark):
    rows = spark.createDataFrame([(d,) for d in [1] * 60 + [0] * 30 + [-1] * 10], "d int")
    means = [r.mean for r in bootstrap_means(rows, "d", 2000).collect()]
    assert len(means) == 2000 and abs(sum(means) / 2000 - 0.5) < 0.01
    spread = (sum((m - 0.5) ** 2 for m in means) / 2000) ** 0.5
    assert abs(spread - 0.067) < 0.01  # the sample's standard error
    many = spark.createDataFrame([(d / 7,) for d in range(100)], "d double")
    assert abs(sum(r.mean for r in bootstrap_means(many, "d", 500).collect()) / 500 - 49.5 / 7) < 0.5


def record(i, name, pool, params):
    return {
        "episode_id": f"e{i}",
        "failure_class": ["router_fail", "validator_fail"][i % 2],
        "function_pool": [{"name": n, "parameters": {"properties": {k: {"type": "string"} for k in params}}} for n in pool],
        "ground_truth_call": {"name": name, "accepted_arguments": {k: [{"deep": [1]}] for k in params}},
        "predicted_call": {"name": pool[0], "arguments": {k: 1 for k in params}},
        "trace": {"harness_layer": "validator", "error_label": "ParamError"},
    }


def test_decoupling(spark):
    failures = [record(0, "g", ["f", "g"], ["x"]), record(1, "f", ["f", "h"], ["x", "y"])]
    rows = spark.createDataFrame([(i, f["failure_class"], json.dumps(f)) for i, f in enumerate(failures)], "ord long, failure_class string, record string")
    made = decouple.decouple(rows, ("router", "validator"))
    codes = {(r.kind, r.name): r.code for r in made.mapping.collect()}
    assert [codes["function", n] for n in "gfh"] == ["fn_0001", "fn_0002", "fn_0003"]
    assert codes["field", "x"] == "field_0001" and codes["field", "deep"] == "field_0002" and codes["error", "ParamError"] == "err_03"
    assert all(made.invariants.values()) and len(made.invariants) == 6
    first, second = (json.loads(r.record) for r in made.failures.orderBy("ord").collect())
    assert first["ground_truth_call"] == {"name": "fn_0001", "accepted_arguments": {"field_0001": [{"field_0002": [1]}]}}
    assert first["trace"] == {"harness_layer": "layer_02", "error_label": "err_03"} and second["decoupled_failure_label"] == "err_02"
    assert first["function_pool"][1]["name"] == "fn_0001" and codes["field", "properties"] in first["function_pool"][0]["parameters"]


def test_relevant_counts_are_the_pairs(spark):
    schema = "patch_id string, target_function string, component string, selected_function string, parameter_names array<string>, token_count int"
    made = spark.createDataFrame([("p1", "f", "router", "g", [], 1), ("p2", "f", "router", "z", [], 1), ("p3", "f", "validator", "", ["a", "b"], 1), ("p4", "h", "validator", "", ["a"], 1)], schema)
    episodes = spark.createDataFrame([("e1", "f", "g", ["f"], ["b"]), ("e2", "f", "q", ["z", "g"], ["c"]), ("e3", "k", "", [], [])], "episode_id string, gt_name string, selected string, pool array<string>, params array<string>")
    pairs = {}
    for r in p.relevant(made, episodes).collect():
        pairs.setdefault(r.episode_id, set()).add(r.patch_id)
    assert pairs == {"e1": {"p1", "p3"}, "e2": {"p1", "p2"}}
    assert {r.episode_id: r.n_relevant for r in p.relevant_counts(made, episodes).collect()} == {"e1": 2, "e2": 2, "e3": 0}


def test_stream_keeps_the_least_row_of_a_key(spark, tmp_path):
    folder = f"file://{tmp_path}"
    run = lambda: resume.collect_stream(spark, f"{folder}/in", "k long, v long", "k", lambda rows: rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    spark.createDataFrame([(1, 9), (1, 3), (2, 5)], "k long, v long").coalesce(1).write.json(f"{folder}/in")
    run()
    spark.createDataFrame([(1, 0), (3, 1)], "k long, v long").coalesce(1).write.mode("append").json(f"{folder}/in")
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{folder}/out").collect()) == [(1, 3), (2, 5), (3, 1)]
