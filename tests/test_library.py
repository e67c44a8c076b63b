"""Ordering, lineage, loop, sources, sinks and streaming operators."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import lineage, loop, ordering as o
from loomspan.operators.skyline import skyline
from loomspan.operators.summaries import ci95, score_summary, upper_median
from loomspan.sources import records, sinks
from loomspan.streaming.resume import collect_stream, windowed_rates


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def test_split(spark):
    for n in (8, 278, 0, 1):
        rows = o.split_by_hash(ids(spark, range(n)), "id").collect()
        order = sorted(range(n), key=lambda i: (sha(o.SPLIT_SEED, i), i))
        a, b = int(n * 0.5), int(n * 0.25)
        want = {i: "train" if k < a else "validation" if k < a + b else "held_out" for k, i in enumerate(order)}
        assert {r.id: r.part for r in rows} == want


def test_split_does_not_depend_on_partitions(spark):
    found = set()
    for n in (1, 3, 9):
        found.add(tuple(sorted(map(tuple, o.split_by_hash(ids(spark, range(50)).repartition(n), "id").collect()))))
    assert len(found) == 1


def test_samples(spark):
    rows = ids(spark, range(30))
    assert {r.id for r in o.sample_by_hash(rows, 5, [1, F.col("id")], "id").collect()} == set(sorted(range(30), key=lambda i: sha(1, i))[:5])
    assert o.sample_by_hash(rows, 99, [1, F.col("id")], "id").count() == 30
    for n in (0, 7, 30, 31, 75):
        taken = o.take_with_repeats(rows, "id", n, 5, "x").collect()
        assert len(taken) == n and all(sum(r.round == k for r in taken) == min(30, max(0, n - 30 * k)) for k in range(3))
    shards = o.shard_items(ids(spark, range(11)), "id", 3).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in shards) == [3, 4, 4]
    groups = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(30)], "id long, g string, v long")
    picked = o.stratified_sample(groups, "g", ["v", "id"], 10, 20).groupBy("g").count().collect()
    assert sorted(r["count"] for r in picked) == [10, 10]


def test_first_and_names(spark):
    rows = spark.createDataFrame([(1, "b", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n")], "id long, k string, v string")
    assert {(r.k, r.id) for r in o.keep_first(rows, ["k"], "id").collect()} == {("b", 1), ("a", 2), (None, 4)}
    assert {r.k: r.code for r in o.number_by_first(rows.dropna(), "k", "id").collect()} == {"b": "fn_0001", "a": "fn_0002"}
    assert rows.select(o.stable_int(7, F.col("id")).alias("n")).first().n == int(sha(7, 1)[:16], 16)


def test_lineage(spark):
    a, b = ids(spark, [1, 2, 3]), ids(spark, [3, 4])
    assert lineage.overlap_counts(a, b, "id").first().asDict() == {"inter": 1, "only_a": 2, "only_b": 1, "jaccard": 0.25}
    with pytest.raises(ValueError, match="share 1 ids"):
        lineage.assert_disjoint(a, b, "id")
    lineage.assert_disjoint(a, ids(spark, [9]), "id")
    expected = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "id long, ord int")
    assert [r.id for r in lineage.merge_exact(a, expected, "id", "ord").collect()] == [3, 1, 2]
    for bad in ([1, 2], [1, 2, 3, 3], [1, 2, 3, 4]):
        with pytest.raises(ValueError):
            lineage.merge_exact(ids(spark, bad), expected, "id", "ord")
    assert {(r.id, r.direction) for r in lineage.two_sided(a, b, "id").collect()} == {(1, "only_a"), (2, "only_a"), (4, "only_b")}


def test_summaries(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 0.5, 0.5)], "v double")
    row = rows.agg(*ci95("v")).first()
    assert row["mean"] == 0.5 and row.ci95 > 0
    assert rows.limit(1).agg(*ci95("v")).first().ci95 == 0.0 and rows.limit(0).agg(*ci95("v")).first()["mean"] is None
    assert score_summary(rows, [], "v").first()["median"] == 0.5
    rng = random.Random(1)
    data = [("ab"[i % 2], rng.randrange(5)) for i in range(41)]
    got = {r.g: r.upper_median for r in upper_median(spark.createDataFrame(data, "g string, v int"), "g", "v").collect()}
    assert got == {g: sorted(v for h, v in data if h == g)[sum(h == g for h, _ in data) // 2] for g in "ab"}
    points = [(rng.randrange(8), rng.randrange(8)) for _ in range(60)]
    front = {(r.up, r.down) for r in skyline(spark.createDataFrame(points, "up int, down int"), ["up"], ["down"]).collect()}
    beats = lambda p, q: p != q and p[0] >= q[0] and p[1] <= q[1]
    assert front == {q for q in points if not any(beats(p, q) for p in points)}


def test_loop(spark):
    assert loop.accept({"v1": False, "v2": True}, {"v1": True, "v2": True}) == ({"v1": True, "v2": True}, True)
    assert loop.accept({"v1": False, "v2": True}, {"v1": True, "v2": False})[1] is False and loop.accept({"v1": True}, {"v1": True})[1] is False
    episodes = spark.createDataFrame([(1, "f"), (2, "g")], "id long, fn string")
    patches = spark.createDataFrame([("f",), ("f",)], "fn string")
    assert {r.id: (r.n_patches, r.success) for r in loop.evaluate(episodes, patches, "fn", F.lit(True)).collect()} == {1: (2, True), 2: (0, False)}
    trials = spark.createDataFrame([(1, i, i == 3) for i in range(5)] + [(2, i, False) for i in range(4)], "k long, i long, ok boolean")
    assert {r.k: (r.first, r.n_tried) for r in loop.first_success(trials, "k", "i", F.col("ok")).collect()} == {1: (3, 4), 2: (None, 4)}


def test_text(spark):
    rows = spark.createDataFrame([("Été, naïve_x 12!  getWeather.v2 it's",)], "t string")
    row = rows.select(
        text.token_count(F.col("t")).alias("n"), text.word_count(F.col("t")).alias("w"), text.identifier_terms(F.col("t")).alias("i"), text.repr_text(F.col("t")).alias("r")
    ).first()
    assert (row.n, row.w) == (11, 5) and "getweather.v2" in row.i and "getweather" in row.i and row.r == repr("Été, naïve_x 12!  getWeather.v2 it's")
    leaks = lambda s, *terms: rows.select(text.leaks_term(F.lit(s), F.array(*map(F.lit, terms)))).first()[0]
    assert leaks("Call get_weather now", "get_weather") and not leaks("forget_weather", "get_weather") and not leaks("plain", "a.b")


def test_sources(spark, tmp_path):
    question = [{"id": "a", "question": [[{"role": "user", "content": "hi"}, {"content": "yo"}]], "function": [{"name": "f"}]}, {"id": "b", "question": "plain", "function": []}]
    (tmp_path / "q").mkdir(), (tmp_path / "p").mkdir()
    (tmp_path / "q" / "DATA_v4_simple.json").write_text("\n\n".join(map(json.dumps, question)) + "\n")
    (tmp_path / "p" / "DATA_v4_simple.json").write_text("\n".join(json.dumps({"id": i, "ground_truth": [{"f": {"x": [1]}}]}) for i in "ab"))
    q, p = (records.jsonl(spark, f"file://{tmp_path}/{d}", name_pattern="DATA_*.json") for d in "qp")
    rows = {r.episode_id: r for r in records.episodes(q, p).select("episode_id", "query", "category").collect()}
    assert rows["a"].query == "hi\nyo" and rows["b"].query == "plain" and rows["a"].category == "simple"
    with pytest.raises(Exception, match="no answer for b"):
        records.episodes(q, p.filter("variant_get(record, '$.id', 'string') = 'a'")).select("ground_truth").collect()
    assert records.jsonl_or_empty(spark, f"file://{tmp_path}/none.jsonl", "id string").count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"records": [{"episode_id": "x", "value": 1}]}, indent=1))
    shard = records.records_of(spark, f"file://{tmp_path}/s.json", "records array<struct<episode_id:string,value:int>>")
    assert [tuple(r) for r in shard.collect()] == [("x", 1, "s.json")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (2, 1.0)], "id long, rate double")
    assert sinks.write_with_counts(rows, f"file://{tmp_path}/a", "id") == {"rows": 3, "unique": 2}
    assert sinks.markdown(rows.limit(2), "T").splitlines()[-2:] == ["| 1 | 0.5000 |", "| 2 | NA |"]
    assert json.loads(sinks.document(rows))[0] == {"id": 1, "rate": 0.5}
    path = f"file://{tmp_path}/b"
    sinks.append_unseen(rows, path, "id", None)
    sinks.append_unseen(ids(spark, [2, 3]).withColumn("rate", F.lit(1.0)), path, "id", spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 4


def test_stream(spark, tmp_path):
    source, sink = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()

    def run(name, values):
        (source / name).write_text("\n".join(json.dumps({"id": v, "x": v * 2}) for v in values))
        collect_stream(spark, f"file://{source}", "id long, x long", "id", lambda d: d.withColumn("y", F.col("x") + 1), sink, f"file://{tmp_path}/ck").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(sink).collect())

    assert run("1.json", [1, 2, 2]) == [1, 2]
    assert run("2.json", [2, 3]) == [1, 2, 3]
    table = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'click' AS event_type, 9.0D AS value")
    assert windowed_rates(table.withColumn("success", F.col("value") > 8)).first().rate == 1.0
