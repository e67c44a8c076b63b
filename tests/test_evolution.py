"""Evolution against one plain loop over all candidates, and training datasets against their rules."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import calls, patches as p
from loomspan.operators import datasets, evolution
from loomspan.plans.repairs import stub_model


def failure(i, fn, params, router):
    pool = [{"name": n, "description": f"does {n}", "parameters": {"properties": {k: {"type": "integer"} for k in params}}} for n in (fn, "other", f"{fn}2")]
    accepted = {k: [i % 5, ""] for k in params}
    got = {"name": "other" if router else fn, "arguments": {k: i % 5 + (not router) for k in params}}
    return {
        "episode_id": f"e{i}",
        "failure_class": "router_fail" if router else "validator_fail",
        "query": f"Find the {fn} of number {i}",
        "function_pool": pool,
        "ground_truth_call": {"name": fn, "accepted_arguments": accepted},
        "predicted_call": got,
    }


FAILURES = [failure(i, f"fn{i % 3}", [["a"], ["b"], ["a", "b"]][i // 3 % 3], i % 4 == 0) for i in range(48)]


def plain_concerns(patch, episode):
    """Relevance in words: the same function, and a selected function in sight or a parameter in common."""
    if patch.target_function != episode["ground_truth_call"]["name"]:
        return False
    if patch.component == "router":
        return patch.selected_function in [episode["predicted_call"]["name"], *(f["name"] for f in episode["function_pool"])]
    return any(k in patch.parameter_names for k in episode["ground_truth_call"]["accepted_arguments"])


def plain(failures, seed):
    """All methods' success per held-out episode, by one loop per family over all candidates."""
    model = stub_model()
    order = sorted(failures, key=lambda f: hashlib.sha256(f"{seed}:{f['episode_id']}".encode()).hexdigest())
    a = len(order) // 2
    b = a + len(order) // 4
    train, validation, held = order[:a], order[a:b], order[b:]

    def right(episode, texts):
        try:
            got = calls.call_in_output(model(p.prompt_text(episode, texts), episode))
        except calls.NotACall:
            return False
        return got.name == episode["ground_truth_call"]["name"]

    made = {f["episode_id"]: p.patches(f) for f in failures}
    found = {"no-evolution": {e["episode_id"]: False for e in held}}
    for number, family in enumerate(p.FAMILIES):
        kept, state = [], {}
        for candidate in (made[f["episode_id"]][number] for f in train):
            scope = [e for e in validation if plain_concerns(candidate, e)]
            after = {e["episode_id"]: right(e, [x.patch_text for x in [*kept, candidate] if plain_concerns(x, e)]) for e in scope}
            before = {k: state.get(k, False) for k in after}
            if any(after[k] and not before[k] for k in after) and not any(before[k] and not after[k] for k in after):
                kept.append(candidate)
                state |= after
        texts = {e["episode_id"]: [x.patch_text for x in kept if plain_concerns(x, e)] for e in held}
        found[f"{family}-evo"] = {e["episode_id"]: bool(texts[e["episode_id"]]) and right(e, texts[e["episode_id"]]) for e in held}
    bank = [made[f["episode_id"]][n] for n in range(len(p.FAMILIES)) for f in train]
    found["oracle"] = {e["episode_id"]: any(right(e, [x.patch_text]) for x in bank if plain_concerns(x, e)) for e in held}
    return found


def test_evolution_is_one_loop(spark):
    rows = [(f["episode_id"], f["failure_class"], json.dumps(f)) for f in FAILURES]
    made = evolution.evolve(spark.createDataFrame(rows, "episode_id string, failure_class string, record string"), [1, 2], stub_model)
    got = {}
    for r in made.records.collect():
        got.setdefault((r.seed, r.method), {})[r.episode_id] = r.success
    for seed in (1, 2):
        for method, want in plain(FAILURES, seed).items():
            assert got[seed, method] == want
    rates = {(r.seed, r.method): r for r in made.seed_rows.collect()}
    assert len(rates) == 10 and all(r.overall_n == 12 for r in rates.values())
    assert rates[1, "oracle"].overall_pass == sum(plain(FAILURES, 1)["oracle"].values())
    assert any(r.accepted for r in made.verdicts.collect()) and not all(r.accepted for r in made.verdicts.collect())
    means = {r.method: r for r in evolution.summary(made.seed_rows).collect()}
    assert means["no-evolution"].overall_mean == 0 and means["oracle"].overall_seeds == 2
    assert {r.family for r in evolution.context(made.accepted).collect()} <= set(p.FAMILIES)


def records(spark, ids, samples=1):
    call = json.dumps({"name": "f", "arguments": {"b": 1, "a": 2}})
    rows = [(f"e{i}", "q", "[]", call, s) for i in ids for s in range(samples)]
    return spark.createDataFrame(rows, "episode_id string, query string, functions string, call string, sample_index long")


TEMPLATE = "Q {query} F {function_doc}"


def test_datasets(spark):
    rows = lambda ids, source, n=1: datasets.training_rows(records(spark, ids, n), TEMPLATE, source)
    teacher, star, replay = rows(range(20), "teacher_t0", 2), rows(range(5), "star_pass16", 3), rows(range(50, 80), "replay_base_success")
    ids = lambda some: spark.createDataFrame([(f"e{i}",) for i in some], "episode_id string")
    made = datasets.build(teacher, star, replay, {"held-out": ids(range(70, 90)), "validation": ids([99])}, datasets.Plan(replay_ratio=0.5))
    assert made.counts == {"teacher": 20, "star": 15, "replay": 20, "main_core": 16, "star_core": 15, "main_replay": 8, "star_replay": 8}
    main = made.main.collect()
    assert len(main) == 24 and {r.source for r in main} == {"teacher_t0", "replay_base_success"}
    assert main[0].output == '{"arguments": {"a": 2, "b": 1}, "name": "f"}' and main[0].input == "Q q F []"
    assert sum(r.n for r in made.distribution("source").filter("dataset = 'star'").collect()) == 23
    with pytest.raises(ValueError, match="share"):
        datasets.build(teacher, star, replay, {"held-out": ids([0, 1, 2, 3, 4])})
    assert datasets.Plan(min_total=100).core_size(80, 0) == 80 and datasets.Plan(min_total=100, max_core=40).core_size(80, 0) == 40
    assert datasets.Plan(min_total=100, max_core=60).core_size(40, 0) == 40


def test_training_row_defaults(spark):
    row = datasets.training_rows(records(spark, [1]), TEMPLATE, "replay_base_success", F.lit("replay")).first()
    assert (row.partition, row.failure_class, row.function_name) == ("replay", "none", "")
