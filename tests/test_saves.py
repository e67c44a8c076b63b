"""Commit records, shard runs, collections and resumed streams: what is lost is done again, what stands is not."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan.operators import collection, lineage, probe
from loomspan.sources.commits import Saves, publish, published
from loomspan.sources.shards import ShardRun
from loomspan.streaming import resume


def items(spark, n=23):
    return spark.range(n).select((F.col("id") * 3).alias("k"), (100 - F.col("id")).alias("place"))


def work(rows):
    return rows.select("k", "shard", (F.col("k") * 2).alias("v"))


@pytest.fixture
def run(spark, tmp_path):
    made = ShardRun(spark, f"file://{tmp_path}/run", "k")
    made.prepare(items(spark), ["place"], 4)
    return made


def test_a_record_is_never_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/c/one.json"
    assert publish(spark, path, {"name": "a", "n": 1}) and not publish(spark, path, {"name": "b", "n": 2})
    assert [tuple(r) for r in published(spark, f"file://{tmp_path}/c", "name string, n long")] == [("a", 1)]
    assert not [f for f in (tmp_path / "c").iterdir() if "draft" in f.name]
    assert published(spark, f"file://{tmp_path}/none", "name string, n long") == []


def test_manifest(run):
    rows = {r.shard: r.n for r in run.manifest().collect()}
    assert rows == {0: 6, 1: 6, 2: 6, 3: 5} and run.missing() == [0, 1, 2, 3]
    first = run.items().orderBy("ord").first()
    assert (first.k, first.shard) == (66, 0)


def test_second_run_does_the_missing_shards_only(spark, run):
    asked = spark.sparkContext.accumulator(0)

    def counting(rows):
        def count(batches):
            for batch in batches:
                asked.add(batch.num_rows)
                yield batch

        return work(rows).mapInArrow(count, "k long, shard int, v long")

    assert run.run(counting, [0, 2]) == [0, 2] and asked.value == 12
    with pytest.raises(ValueError, match="without a commit"):
        run.merge()
    assert run.run(counting, at_once=1) == [1, 3] and asked.value == 23
    assert run.run(counting) == [] and asked.value == 23
    merged = run.merge().collect()
    assert [(r.k, r.v, r.ord) for r in merged] == [(3 * (22 - i), 6 * (22 - i), i + 1) for i in range(23)]


@pytest.mark.parametrize("fault", ["row lost", "row twice", "foreign row", "other id"])
def test_an_attempt_without_its_ids_is_refused(run, fault):
    def faulty(rows):
        good = work(rows)
        if fault == "row lost":
            return good.filter("k <> 66")
        if fault == "other id":
            return good.withColumn("k", F.when(F.col("k") == 66, 67).otherwise(F.col("k")))
        more = good.filter("k = 66") if fault == "row twice" else good.filter("k = 66").withColumn("k", F.lit(1).cast("long"))
        return good.unionByName(more)

    with pytest.raises(ValueError, match=r"\(0, "):
        run.run(faulty)
    assert run.missing() == [0]  # the other shards of the attempt stand
    assert run.run(work) == [0] and run.merge().count() == 23


def test_a_lost_attempt_leaves_nothing_behind(run):
    def fails(rows):
        return work(rows).withColumn("v", F.when(F.col("shard") == 3, F.raise_error(F.lit("executor lost")).cast("long")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="executor lost"):
        run.run(fails, at_once=4)
    assert run.missing() == [0, 1, 2, 3]
    run.run(work)
    assert run.merge().count() == 23


def test_second_of_two_attempts_is_told(spark, run):
    run.run(work, [1])
    work(run.items().filter("shard = 1")).write.partitionBy("shard").parquet(f"{run.folder}/attempts/late")
    assert run.commit("late", [1]) == []
    assert {c["attempt"] for c in run.commits()} != {"late"}


def test_more_shards_than_items_and_no_items(spark, tmp_path):
    few = ShardRun(spark, f"file://{tmp_path}/few", "k")
    few.prepare(items(spark, 2), ["place"], 5)
    few.run(work)
    assert few.merge().count() == 2
    none = ShardRun(spark, f"file://{tmp_path}/none", "k")
    none.prepare(items(spark, 0), ["place"], 3)
    assert {r.n for r in none.manifest().collect()} == {0}


def test_merge_needs_the_exact_ids(spark):
    ids = lambda *k: spark.createDataFrame([(x, i) for i, x in enumerate(k)], "k string, ord int")
    parts = ids("e1").unionByName(ids("e2")).drop("ord")
    assert [r.k for r in lineage.merge_exact(parts, ids("e2", "e1"), "k", "ord").collect()] == ["e2", "e1"]
    for bad, want, words in ((parts, ids("e1", "e3"), ("'missing': ['e3']", "'extra': ['e2']")), (parts.union(parts), ids("e2", "e1"), ("'duplicate': ['e1', 'e2']",))):
        with pytest.raises(ValueError) as error:
            lineage.merge_exact(bad, want, "k", "ord")
        assert all(w in str(error.value) for w in words)


RECORDS = "k long, ord long, hits int, teacher_success boolean, successful array<int>, failure_class string, function_name string"


def test_merged_outputs(spark, tmp_path):
    rows = [(1, 2, 0, True, [], "router_fail", "f"), (2, 1, 2, True, [0, 3], "validator_fail", None), (3, 3, 0, False, [], "router_fail", "g")]
    made = probe.merge_shards(spark.createDataFrame(rows, RECORDS), "k", {"held-out": spark.createDataFrame([(3,)], "k long")}, f"file://{tmp_path}/out", least=2)
    stats = made.partition.first()
    assert (stats.total_failures, stats.repaired_count, stats.sampling_rescuable, stats.scaffold_only, stats.neither, stats.scaffold_only_repaired_rate) == (3, 2, 1, 1, 1, 0.5)
    assert made.inventory.first().asDict() == {"repaired_count": 2, "gate": "GO", "by_function_name": {"": 1, "f": 1}, "by_failure_class": {"router_fail": 1, "validator_fail": 1}}
    assert [r.k for r in spark.read.json(f"file://{tmp_path}/out/repaired").orderBy("ord").collect()] == [2, 1]
    assert sorted(r.sample_index for r in spark.read.json(f"file://{tmp_path}/out/samples").collect()) == [0, 3]
    none = probe.merge_shards(spark.createDataFrame([], RECORDS), "k", {}).partition.first()
    assert (none.total_failures, none.scaffold_only_rate, none.scaffold_only_repaired_rate) == (0, 0.0, 0.0)


def test_merge_stops_before_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, True, [], "router_fail", "f")], RECORDS)
    with pytest.raises(ValueError, match="held-out share 1 ids"):
        probe.merge_shards(rows, "k", {"held-out": rows.select("k")}, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


# --- collection ------------------------------------------------------------


def episodes(spark, n=10):
    truth = json.dumps({"name": "f", "accepted_arguments": {"x": [1]}})
    rows = [(f"e{i}", "simple" if i % 2 else "multiple", "c", f"q{i}", "[]", truth) for i in range(n)]
    return spark.createDataFrame(rows, collection.EPISODE)


def runner_of(gone: bool, asked=None):
    """Makes a model that answers nothing, another function, the right call, and for every fourth question a wrong value, or is gone."""

    def make_runner():
        def run(query):
            kind = int(query[1:]) % 4
            if asked is not None:
                asked.add(1)
            if kind == 3 and gone:
                raise RuntimeError("the model is gone")
            return ["nothing", '{"name": "g", "arguments": {"x": 1}}', '{"name": "f", "arguments": {"x": 1}}', '{"name": "f", "arguments": {"x": 2}}'][kind]

        return run

    return make_runner


ORDER = ["split", "category", "episode_id"]


def test_collection_goes_on_behind_its_last_save(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/col", episodes(spark)
    with pytest.raises(Exception, match="the model is gone"):  # multiple: q0 q2 q4 q6 q8, then simple: q1 q3
        collection.collect(rows, ORDER, runner_of(True), folder, save_every=3)
    saved = {r.episode_id for r in Saves(spark, folder).read().collect()}
    assert saved == {"e0", "e2", "e4", "e6", "e8", "e1"}  # the third save, whose model was lost at e3, is not there
    asked = spark.sparkContext.accumulator(0)
    got = {r.episode_id: r for r in collection.collect(rows, ORDER, runner_of(False, asked), folder, save_every=3).collect()}
    assert len(got) == 10 and asked.value == 4 and len(Saves(spark, folder).names()) == 4
    assert collection.collect(rows, ORDER, runner_of(True), folder).count() == 10  # nobody is asked
    assert [got[f"e{i}"].failure_class for i in range(4)] == ["router_fail", "router_fail", "none", "validator_fail"]
    assert got["e0"].parse_error == "no call" and got["e0"].predicted_call is None and json.loads(got["e3"].predicted_call)["arguments"] == {"x": 2}
    assert [c for c in got["e1"].asDict()] == [c.split()[0] for c in collection.RECORD.split(", ")]


def test_collection_limit_and_checks(spark, tmp_path):
    some = collection.collect(episodes(spark), ORDER, runner_of(False), f"file://{tmp_path}/a", limit=4)
    assert {r.episode_id for r in some.collect()} == {"e0", "e2", "e4", "e6"}
    with pytest.raises(ValueError, match="simple"):  # q1 and q3 alone: all fail
        collection.assert_useful(collection.collect(episodes(spark, 4), ORDER, runner_of(False), f"file://{tmp_path}/b"))
    assert collection.collect(episodes(spark, 0), ORDER, runner_of(False), f"file://{tmp_path}/c").count() == 0


# --- streams ---------------------------------------------------------------


def test_stream_reads_its_batch_alone(spark, tmp_path):
    """Rows read do not grow with the sink: each run takes in its own rows, and state is looked up by key."""
    folder, read = f"file://{tmp_path}", []
    for turn in range(4):
        spark.range(turn * 50, turn * 50 + 60).selectExpr("id AS k", "id % 7 AS v").coalesce(1).write.mode("append").json(f"{folder}/in")
        query = resume.collect_stream(spark, f"{folder}/in", "k long, v long", "k", lambda rows: rows, f"{folder}/out", f"{folder}/state", save_every=25)
        query.awaitTermination()
        done = [p for p in query.recentProgress if p["numInputRows"]]
        read.append((sum(p["numInputRows"] for p in done), sum(s["numRowsUpdated"] for p in done for s in p["stateOperators"])))
    assert [r[0] for r in read] == [60] * 4
    assert [r[1] for r in read] == [60, 50, 50, 50]
    saves = Saves(spark, f"{folder}/out")
    assert saves.read().count() == 210 and saves.read().select("k").distinct().count() == 210
    assert len(saves.names()) == 3 + 2 + 2 + 2
    assert max(r["n"] for r in published(spark, f"{folder}/out/_commits", "name string, n long")) == 25


def test_a_batch_run_again_goes_on_behind_its_saves(spark, tmp_path):
    saves, rows = Saves(spark, f"file://{tmp_path}/out"), spark.range(10).selectExpr("id AS k", "id AS v")
    lost = lambda part: part.withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        resume.save_in_parts(saves, rows, "k", lost, "0", 4)
    assert sorted(r.k for r in saves.read().collect()) == [0, 1, 2, 3]
    judged = spark.sparkContext.accumulator(0)

    def judge(part):
        judged.add(1)
        return part

    assert resume.save_in_parts(saves, rows, "k", judge, "0", 4) == 3
    assert sorted(r.k for r in saves.read().collect()) == list(range(10))


def test_least_row_with_nested_columns_and_nulls(spark, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    lines = [{"k": "a", "v": 2, "s": {"x": [1]}}, {"k": "a", "v": None, "s": {"x": [2]}}, {"k": None, "v": 1}, {"k": "b", "v": 5, "s": None}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    resume.collect_stream(spark, f"{folder}/in", "k string, v long, s struct<x:array<long>>", "k", lambda rows: rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = {r.k: (r.v, r.s and r.s.x) for r in Saves(spark, f"{folder}/out").read().collect()}
    assert got == {"a": (None, [2]), None: (1, None), "b": (5, None)}
