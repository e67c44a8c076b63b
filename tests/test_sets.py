"""Bitmaps, target families, quotas, names of any number, table functions, components and self-checks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import calls, patches as p, tables
from loomspan.operators import arena, bitmaps, datasets, decouple, evolution, groups, ordering as o, pairs, splits, targets

def of_kind(kind):
    return F.startswith(F.col("source"), F.lit(f"{kind}:"))


def touched(spark, n=70_000, seed=1):
    """Ids over three buckets, four sources; sets in plain Python beside the table."""
    rng = random.Random(seed)
    ids = [f"e{i:06d}" for i in range(n)]
    sets = {s: set(rng.sample(ids, k)) for s, k in (("train:a", 900), ("train:b", 30_000), ("eval:c", 5_000), ("eval:d", 3))}
    rows = [(s, i) for s, own in sets.items() for i in own] + [("train:a", "foreign"), ("eval:c", None)]
    numbers = bitmaps.numbered(spark.createDataFrame([(i,) for i in ids + ids[:9]] + [(None,)], "k string"), "k")
    bits = bitmaps.bitmaps(spark.createDataFrame(rows + rows[:50], "s string, k string"), numbers, "s", "k")
    return ids, sets, numbers, bits


def test_bitmaps_against_sets(spark):
    ids, sets, numbers, bits = touched(spark)
    assert numbers.agg(F.min("number"), F.max("number"), F.count("*")).first() == (0, len(ids) - 1, len(ids))
    assert bits.groupBy("source").count().agg(F.max("count")).first()[0] == 3  # a row a bucket
    back = {}
    for r in bitmaps.members(bits, numbers, "k").collect():
        back.setdefault(r.source, set()).add(r.k)
    assert back == sets
    u = bitmaps.Unions(bits, {"t": of_kind("train"), "c": F.col("source") == "eval:c", "d": F.col("source") == "eval:d"})
    t = sets["train:a"] | sets["train:b"]
    row = u.sizes(t=u.union("t"), tc=u.both("t", "c"), c_t=u.without("c", "t"), tcd=u.union("t", "c", "d"), tc_d=u.within("t", "c", "d"), c_td=u.without("c", "t", "d")).first()
    c, d = sets["eval:c"], sets["eval:d"]
    assert tuple(row) == (len(t), len(t & c), len(c - t), len(t | c | d), len((t & c) - d), len(c - t - d))


def test_touch_table_and_decomposition(spark):
    ids, sets, numbers, bits = touched(spark)
    of = {i: f"c{n % 3}" if n >= 6 else "small" for n, i in enumerate(ids)}
    cells = bitmaps.bitmaps(spark.createDataFrame(list(of.items()), "k string, c string"), numbers, "c", "k")
    t, e = sets["train:a"] | sets["train:b"], sets["eval:c"] | sets["eval:d"]
    got = {r.category: tuple(r)[1:] for r in bitmaps.touch_table(bits, cells, of_kind("train"), of_kind("eval")).collect()}
    for c in set(of.values()):
        own = {i for i in ids if of[i] == c}
        status = "train_touched" if own & t else "eval_touched_only" if own & e else "never_touched"
        assert got[c] == (len(own), len(own & t), len((own & e) - t), len(own - t - e), status)
    row = bitmaps.decomposition(bits, "eval:c", of_kind("train"), "eval:d").first()
    c, d = sets["eval:c"], sets["eval:d"]
    assert tuple(row) == (len(c), len(c & t), len(c & d), len(c & t & d), len(c - t - d))
    empty = bitmaps.decomposition(bits.filter("false"), "eval:c", of_kind("train"), "eval:d").first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_target_families(spark):
    split = spark.createDataFrame([("a", "train"), ("b", "validation"), ("c", "held_out"), ("d", "train")], "episode_id string, part string")
    fixed = spark.createDataFrame([("a", "p", "x", "f"), ("a", "p", "x", "f"), ("a", "p", "y", "f"), ("b", None, "x", "g"), ("c", "p", "x", "f")], "episode_id string, partition string, target_output string, function_name string")
    samples = fixed.withColumn("sample_index", F.lit(1)).unionByName(fixed.filter("episode_id = 'a' AND target_output = 'x'").withColumn("sample_index", F.lit(0)))
    right = spark.createDataFrame([("r1", "ok", "f"), ("r2", "ok", "f"), ("r3", "ok", "f")], "episode_id string, target_output string, function_name string")
    runs = [("m1", "r1", False, "bad"), ("s1", "r1", False, None), ("m2", "r1", True, "ok"), ("m1", "r2", False, "bad"), ("s1", "r2", True, "ok"), ("m2", "r2", False, "worse"), ("m1", "r3", True, "ok")]
    outcomes = spark.createDataFrame(runs, "run string, episode_id string, success boolean, output string")
    rows = targets.families(fixed, samples, right, split, outcomes, ["m1", "s1"], ["m2"]).collect()
    by = lambda family: sorted((r.episode_id, r.target_output, r.partition) for r in rows if r.target_family == family)
    assert by("train_teacher_repaired") == [("a", "x", "p"), ("a", "y", "p")] and by("validation_teacher_repaired") == [("b", "x", "unknown")]
    assert by("train_base_pass16_success") == [("a", "x", "p"), ("a", "y", "p")]
    kept = {r.episode_id: (r.first_shared_fragile, r.united_fragile, r.flipped_outputs) for r in rows if r.target_family == "r_success_correct"}
    assert kept == {"r1": (True, False, {"m1": "bad"}), "r2": (False, True, {"m1": "bad", "m2": "worse"}), "r3": (False, False, {})}


def test_quotas(spark):
    rows = spark.createDataFrame([(i, 1 + (i > 2) + (i > 9)) for i in range(30)], "k long, tier int")
    filled = o.staged_fill(rows, "tier", "k", 12, 5, "x").collect()
    assert {r.k for r in filled} >= set(range(10)) and len(filled) == 12 == len({r.k for r in filled})
    rest = o.sample_by_hash(rows.filter("tier = 3"), 2, [5, "x", F.col("k")], "k").collect()
    assert {r.k for r in filled} - set(range(10)) == {r.k for r in rest}
    with pytest.raises(ValueError, match="30 rows for 31"):
        o.staged_fill(rows, "tier", "k", 31, 5, "x")
    again = o.staged_repeats(rows, "tier", "k", 8, 5, "x").collect()
    assert sorted(r.k for r in again if r.round < 2) == [0, 0, 1, 1, 2, 2] and len(again) == 8
    with pytest.raises(ValueError, match="no rows"):
        o.staged_repeats(rows.filter("false"), "tier", "k", 8, 5, "x")
    plan = o.staged_fill(rows, "tier", "k", 12, 5, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_targeted_and_capped_sets_refuse(spark):
    pool = spark.createDataFrame([(f"e{i}", f"fam{i % 3}_x", "replay") for i in range(12)], "episode_id string, function_name string, partition string")
    core = spark.createDataFrame([("t1", "fam0_y", "scaffold_only"), ("t2", "fam0_y", "replay")], pool.schema)
    failed = spark.createDataFrame([("fam0_y",)], "function_name string")
    held = pool.filter("episode_id IN ('e0', 'e1')").select("episode_id")
    made = datasets.targeted(core, pool, failed, {"held-out": held}, 5, 3).collect()
    assert sorted(r.episode_id for r in made if r.partition == "replay" and r.round == 0) == ["e3", "e6", "e9"]  # of the coarse family, without e0
    assert [r.episode_id for r in made if r.partition != "replay"] == ["t1"] and len(made) == 6
    with pytest.raises(ValueError, match="share 1 ids"):
        datasets.targeted(core, pool, failed, {"core": core.filter("episode_id = 't1'").select("episode_id")}, 5, 3)
    both = datasets.capped(pool, failed, {}, 4, 10, 3)
    arena = {r.episode_id for r in both.arena.collect()}
    drawn = [{r.episode_id for r in rows.collect()} for rows in (both.uniform, both.targeted)]
    assert len(arena) == 8 and not arena & drawn[0] and not arena & drawn[1] and both.uniform.count() == both.targeted.count() == 10
    with pytest.raises(ValueError, match="12 rows for 13"):
        datasets.capped(pool, failed, {}, 13, 10, 3)
    with pytest.raises(ValueError, match="arena and held-out"):
        datasets.capped(pool, failed, {"held-out": pool.select("episode_id")}, 4, 10, 3)


def failure(i, fn, params, router=False, chosen="other"):
    return {
        "episode_id": f"e{i:03d}",
        "failure_class": "router_fail" if router else "validator_fail",
        "query": f"question {i}",
        "function_pool": [{"name": fn, "parameters": {"properties": {k: {"type": "integer"} for k in params}}}, {"name": chosen}],
        "ground_truth_call": {"name": fn, "accepted_arguments": {k: [i % 5, ""] for k in params}},
        "predicted_call": {"name": chosen if router else fn, "arguments": {k: 9 for k in params}},
        "trace": {"harness_layer": "router", "error_label": "ParamError"},
    }


def test_names_by_join_are_names_by_map(spark, monkeypatch):
    rows = [(i, "x", json.dumps(failure(i, f"f{i % 9}", [f"p{i % 4}", f"p{i % 11}"], i % 3 == 0, f"g{i}"))) for i in range(60)]
    rows = spark.createDataFrame([(i, json.loads(r)["failure_class"], r) for i, _, r in rows], "ord long, failure_class string, record string")
    by_map = decouple.decouple(rows, ("router",))
    monkeypatch.setattr(decouple, "MOST_NAMES", 3)
    by_join = decouple.decouple(rows, ("router",))
    get = lambda made: {r.ord: json.loads(r.record) for r in made.failures.collect()}
    assert get(by_map) == get(by_join) and len(get(by_join)) == 60
    assert by_join.invariants == by_map.invariants and len(by_join.invariants) == 6 and all(by_join.invariants.values())
    assert get(by_join)[0]["ground_truth_call"]["name"] == "fn_0001" and get(by_join)[0]["trace"] == {"harness_layer": "layer_01", "error_label": get(by_map)[0]["trace"]["error_label"]}


def test_call_rows(spark):
    outputs = [(1, '[{"name": "f", "arguments": {"b": 1, "a": "é"}}, {"g": {}}]'), (2, "nothing"), (3, None), (4, "f(x=1)\ng(y='z')"), (5, '{"name": "h", "arguments": null}'), (6, "")]
    got = {}
    for r in tables.output_calls(spark.createDataFrame(outputs, "k int, output string"), "output").collect():
        got.setdefault(r.k, []).append((r.place, r.name, r.arguments, r.error))
    assert got[1] == [(1, "f", '{"a": "é", "b": 1}', None), (2, "g", "{}", None)]
    assert [x[:2] for x in got[4]] == [(1, "f"), (2, "g")] and [x[1] for x in got[5]] == ["h"]
    assert all(len(got[k]) == 1 and got[k][0][:3] == (0, None, None) and got[k][0][3] for k in (2, 3, 6))


def test_injected_tokenizers(spark):
    rows = spark.createDataFrame([("a bb a",), ("",), (None,)], "t string")
    words, letters = tables.token_count(lambda: str.split), tables.token_count(lambda: list)
    assert [tuple(r) for r in rows.select(words(F.col("t")), letters(F.col("t"))).collect()] == [(3, 6), (0, 0), (0, 0)]


def test_unit_rows(spark):
    records = spark.createDataFrame([("r", json.dumps(failure(1, "f", ["p"], True))), ("v", json.dumps(failure(2, "f", ["p"]))), ("n", None)], "k string, record string")
    got = {}
    for r in tables.information_units(records).collect():
        got.setdefault(r.k, []).append(r.iu_id)
    assert got == {"r": [u.id for u in p.units(failure(1, "f", ["p"], True))], "v": ["IU-param-p"]}


def test_bundles_of_both_classes():
    router, validator = p.bundle(failure(1, "f", ["p"], True)), p.bundle(failure(2, "f", ["p"]))
    assert router["gt_function"] == "f" and router["model_selected"] == "other" and [c["name"] for c in router["candidate_functions"]] == ["f", "other"]
    assert validator["function_name"] == "f" and validator["parameters"][0]["name"] == "p" and validator["predicted_arguments"] == {"p": 9}
    assert router["repair_rule"] != validator["repair_rule"] and router["iu_ids"] == [u["id"] for u in router["iu_set"]]
    assert p.bundle({"failure_class": "router_fail"})["model_selected"] == "<parse_error>"


def plain_groups(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_connected_groups(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)] + [(2000, 2001 + i) for i in range(80)]
    got = {r.node: r.root for r in groups.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_groups(links)
    assert groups.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def answers_by_text():
    def run(prompt, failure):
        truth = failure["ground_truth_call"]
        return json.dumps({"name": truth["name"], "arguments": calls.first_arguments(truth)}) if (len(prompt) + prompt.count("PATCH")) % 3 else "no call"

    return run


def test_one_function_folds_by_component(spark):
    """All failures want one function: as many groups as parameters that nothing shares, not one with all pairs."""
    rows = [failure(i, "f", [f"p{i % 6}"], i % 4 == 0, f"g{i % 6}") for i in range(72)]
    table = spark.createDataFrame([(r["episode_id"], r["failure_class"], json.dumps(r)) for r in rows], "episode_id string, failure_class string, record string")
    episodes = evolution.splits(evolution.with_keys(table), [1]).cache()
    train = episodes.filter("part = 'train'").select("seed", "rank", F.col("episode_id").alias("trigger_episode_id"))
    candidates = p.materialize(table).filter("family = 'NL'").join(train, "trigger_episode_id").cache()
    validation = episodes.filter("part = 'validation'")
    placed = evolution.in_components(candidates, validation)
    assert placed.select("piece").distinct().count() >= 6
    assert placed.count() <= candidates.count() + validation.count()  # no pairs

    run = answers_by_text()
    texts = {r.patch_id: r for r in candidates.collect()}
    scope = {}
    for r in evolution.concerns(candidates, validation).collect():
        scope.setdefault(r.patch_id, {})[r.episode_id] = r.record
    state, kept, want = {}, {}, {}
    for one in sorted((c for c in texts.values() if c.patch_id in scope), key=lambda c: c.rank):
        met = scope[one.patch_id]
        outcome = {e: evolution.judged(run, rec, [*kept.get(e, []), one.patch_text]) for e, rec in met.items()}
        fixed = [e for e, ok in outcome.items() if ok and not state.get(e)]
        broken = [e for e, ok in outcome.items() if not ok and state.get(e)]
        good = bool(fixed) and not broken
        want[one.patch_id] = (good, len(met), len(fixed), len(broken))
        if good:
            state.update(outcome)
            for e in met:
                kept.setdefault(e, []).append(one.patch_text)

    def make():
        def run(prompt, failure):
            truth = failure["ground_truth_call"]
            arguments = {k: next(v for v in vs if v != "") for k, vs in truth["accepted_arguments"].items()}
            return json.dumps({"name": truth["name"], "arguments": arguments}) if (len(prompt) + prompt.count("PATCH")) % 3 else "no call"

        return run

    got = {r.patch_id: (r.accepted, r.n_scope, r.fixed, r.regressed) for r in evolution.fold(candidates, validation, make).collect()}
    assert got == want and {g[0] for g in got.values()} == {True, False}


def test_self_check_and_unusable_splits(spark):
    truth = json.dumps({"name": "f", "accepted_arguments": {"x": [1]}})
    rows = [("simple", i, "c", 1, truth) for i in range(3)] + [("multiple", i, "c", 2, truth) for i in range(3)]
    table = lambda some: spark.createDataFrame(some, "split string, k int, category string, pool_size int, ground_truth string")
    assert {tuple(r) for r in splits.self_check(table(rows), "k").collect()} == {("simple", True, False), ("multiple", True, False)}
    bounds = ({"multiple": 2}, {"simple": 1})
    splits.assert_usable(table(rows), ["category"], "k", *bounds)
    for bad, words in (([("simple", 9, None, 1, truth)], "category filled in 3 of 4"), ([("multiple", 9, "c", 1, truth)], "pools of 1 to 2"), ([("simple", 9, "c", 2, truth)], "pools of 1 to 2")):
        with pytest.raises(ValueError, match=words):
            splits.assert_usable(table(rows + bad), ["category"], "k", *bounds)
    with pytest.raises(ValueError, match="no rows"):
        splits.assert_usable(table(rows[:3]), ["category"], "k", *bounds)


def test_arena(spark):
    rows = spark.createDataFrame([(i, f"c{i % 2}", i % 5 > 0) for i in range(40)], "k long, category string, ok boolean")
    touched = {"training": spark.createDataFrame([(i,) for i in range(0, 40, 3)] * 2, "k long"), "old": spark.createDataFrame([(1,), (999,)], "k long")}
    free = {i for i in range(40) if i % 5 and i % 3 and i != 1}
    made = arena.build(rows, "k", F.col("ok"), touched, 9, 10, 7)
    got = {r.k for r in made.rows.collect()}
    assert len(got) == 9 and got <= free and made.available == len(free) and made.status == "ready"
    assert {r.category: r.n for r in made.distribution("category").collect()} == {c: sum(i % 2 == int(c[1]) for i in got) for c in ("c0", "c1")}
    assert tuple(made.report(9).first()) == (9, len(free), 9, "ready")
    few = arena.build(rows, "k", F.col("ok"), touched, 900, 100, 7)
    assert few.rows.count() == len(free) and few.status == "insufficient"
    with pytest.raises(ValueError, match="arena and old share 1 ids"):
        arena.checked(rows.filter("k < 3"), "k", {"old": touched["old"]}, 3, 1)


def test_pairing_probe(spark):
    rows = [failure(i, f"f{i % 3}", ["p", "q"][: 1 + i % 2], i % 5 == 0, f"g{i}") for i in range(40)]
    table = spark.createDataFrame([(r["episode_id"], r["failure_class"], json.dumps(r)) for r in rows], "episode_id string, failure_class string, record string")
    chosen = {r.episode_id: r.failure_class for r in pairs.choose(table, 12, 4).collect()}
    router = sorted(r["episode_id"] for r in rows if r["failure_class"] == "router_fail")
    validator = sorted(r["episode_id"] for r in rows if r["failure_class"] == "validator_fail")
    assert set(chosen) == {*router[:4], *validator[:4], *router[4:8]}
    made = pairs.pairs(pairs.choose(table, 12, 4)).cache()
    pairs.assert_paired(made, 12, 4)
    assert all(r.padding_without_information and r.same_units and r.in_tolerance and r.struct_to_nl > 0 for r in made.collect())
    for bad, words in ((made.filter("failure_class = 'router_fail'"), "0 pairs of validator_fail"), (made.limit(11), "11 pairs for 12"), (made.withColumn("in_tolerance", F.col("episode_id") != router[0]), router[0])):
        with pytest.raises(ValueError, match=words):
            pairs.assert_paired(bad, 12, 4)
