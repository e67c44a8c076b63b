"""Evolution of patches: splits, greedy loops, held-out evaluation and oracle, for several seeds.

A loop is sequential over its candidates. But a candidate concerns only
validation episodes of its own target function that share a chosen function or
a parameter with it, and an outcome depends only on accepted patches that
concern the same episode. Loops of different components of that relation never
meet, so the fold runs per (seed, family, function, component) in parallel and
gives what one loop over all candidates gives. A task holds the candidates and
the episodes of its component, each once, never their pairs.

The model is a runner built once a task: prompt and failure record in, raw
output out. Episodes without a patch fail without asking it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.functions import calls, patches as p
from loomspan.operators import loop, ordering as o
from loomspan.operators.generation import generate, generate_where
from loomspan.operators.groups import connected
from loomspan.shared import cut

Runner = Callable[[str, dict], str]

RECORD_KEYS = "function_pool array<struct<name:string>>, ground_truth_call struct<name:string,accepted_arguments:map<string,string>>, predicted_call struct<name:string>"
VERDICT = "seed long, family string, target_function string, rank long, patch_id string, accepted boolean, n_scope long, fixed long, regressed long"


def with_keys(failures: DataFrame) -> DataFrame:
    """Add what relevance looks at to (episode_id, failure_class, record): gt_name, selected, pool, params."""
    r, none = F.from_json("record", RECORD_KEYS), F.array().cast("array<string>")
    rows = failures.select("episode_id", "failure_class", "record", r.alias("r"))
    return rows.select(
        "episode_id",
        "failure_class",
        "record",
        F.coalesce("r.ground_truth_call.name", F.lit("")).alias("gt_name"),
        F.coalesce("r.predicted_call.name", F.lit("")).alias("selected"),
        F.coalesce(F.col("r.function_pool.name"), none).alias("pool"),
        F.coalesce(F.map_keys("r.ground_truth_call.accepted_arguments"), none).alias("params"),
    )


def splits(episodes: DataFrame, seeds: list[int]) -> DataFrame:
    """The episodes of every seed, each with its part and its rank in the seed's hash order."""
    made = [o.split_by_hash(episodes, "episode_id", seed, keep_rank=True).withColumn("seed", F.lit(seed).cast("long")) for seed in seeds]
    out = made[0]
    for one in made[1:]:
        out = out.unionByName(one)
    return out


def concerns(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Pairs of a candidate and an episode of the same seed that it concerns."""
    c, e = candidates.alias("p"), episodes.alias("e")
    same = (F.col("p.seed") == F.col("e.seed")) & (F.col("p.target_function") == F.col("e.gt_name"))
    return c.join(e, same & p.relevance()).select(
        "p.seed", "p.family", "p.target_function", "p.rank", "p.patch_id", "p.patch_text", "e.episode_id", "e.record"
    )


def judged(run: Runner, record: str, texts: list[str]) -> bool:
    """Whether the model, given the patches, makes the right call."""
    failure = json.loads(record)
    try:
        got = calls.call_in_output(run(p.prompt_text(failure, texts), failure))
    except calls.NotACall:
        return False
    return calls.verdict({"name": got.name, "arguments": got.arguments}, failure["ground_truth_call"])[2]


def hubs(component: Column, selected: Column, parameters: Column) -> Column:
    """What a candidate meets episodes by: the function that was chosen in its place, or parameters."""
    return F.when(component == "router", F.array(F.concat(F.lit("s:"), selected))).otherwise(F.transform(parameters, lambda x: F.concat(F.lit("p:"), x)))


def episode_hubs() -> Column:
    """What an episode is met by: the chosen function, those of its pool, its parameters."""
    named = lambda kind, names: F.transform(names, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("s:"), F.col("selected"))), named("s:", F.col("pool")), named("p:", F.col("params"))))


KEYS = ["seed", "target_function"]
TAGGED = "rank long, patch_id string, patch_text string, component string, selected_function string, parameter_names array<string>, episode_id string, record string, selected string, pool array<string>, params array<string>"


def in_components(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Candidates and episodes of one seed and function as rows of one table, with the component (``piece``) in which they may meet.

    Rows that share a hub of some candidate are connected. Links run from a
    row's first hub to its others, so there are as many as hubs, not as pairs
    of rows. Episodes that no candidate concerns are left out.
    """
    left = candidates.withColumn("hubs", F.array_compact(hubs(F.col("component"), F.col("selected_function"), F.col("parameter_names")))).filter(F.size("hubs") > 0)
    known = left.select(*KEYS, F.explode("hubs").alias("hub")).distinct()
    right = episodes.select("seed", F.col("gt_name").alias("target_function"), "episode_id", F.explode(episode_hubs()).alias("hub"))
    right = cut(right.join(known, [*KEYS, "hub"]).groupBy(*KEYS, "episode_id").agg(F.array_sort(F.collect_set("hub")).alias("hubs")))  # an episode's own hubs
    node = lambda h: F.struct(*KEYS, h.alias("hub"))
    of = lambda rows: rows.select(node(F.col("hubs")[0]).alias("a"), F.explode("hubs").alias("h"), *KEYS).select("a", node(F.col("h")).alias("b"))
    roots = connected(of(left).unionByName(of(right)).distinct())
    place = cut(roots.select("node", F.xxhash64("root").alias("piece")))  # two pieces under one number are folded together, which changes nothing

    def placed(rows):
        return rows.withColumn("node", node(F.col("hubs")[0])).join(place, "node").drop("node", "hubs")

    met = placed(left).select("family", *KEYS, "piece", *(c.split()[0] for c in TAGGED.split(", ")[:6]))
    cells = met.select("family", *KEYS, "piece").distinct()
    own = episodes.select("seed", F.col("gt_name").alias("target_function"), "episode_id", "record", "selected", "pool", "params").join(placed(right), [*KEYS, "episode_id"])
    return met.unionByName(own.join(cells, [*KEYS, "piece"]), allowMissingColumns=True)


def fold(candidates: DataFrame, episodes: DataFrame, make_runner: Callable[[], Runner]) -> DataFrame:
    """Verdicts of all candidates that concern an episode, folded by rank per component of each (seed, family, function)."""

    def run_group(rows: pd.DataFrame) -> pd.DataFrame:
        run, state, kept, out = make_runner(), {}, {}, []
        tries = rows[rows["patch_id"].notna()].sort_values(["rank", "patch_id"])
        asked = rows[rows["episode_id"].notna()].drop_duplicates("episode_id").set_index("episode_id").sort_index()
        by_hub: dict[str, set] = {}
        for name, row in asked.iterrows():
            for hub in [f"s:{row['selected']}", *(f"s:{x}" for x in row["pool"]), *(f"p:{x}" for x in row["params"])]:
                by_hub.setdefault(hub, set()).add(name)
        for one in tries.to_dict("records"):
            keys = [f"s:{one['selected_function']}"] if one["component"] == "router" else [f"p:{x}" for x in one["parameter_names"]]
            names = sorted(set().union(*(by_hub.get(k, ()) for k in keys)))
            if not names:
                continue
            outcome = {e: judged(run, asked.at[e, "record"], [*kept.get(e, []), one["patch_text"]]) for e in names}
            gained, lost = loop.turned({e for e, ok in state.items() if ok}, outcome)
            state, good = loop.accept(state, outcome)
            for e in names if good else ():
                kept.setdefault(e, []).append(one["patch_text"])
            out.append((one["seed"], one["family"], one["target_function"], int(one["rank"]), one["patch_id"], good, len(names), len(gained), len(lost)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])

    rows = in_components(candidates, episodes)
    return rows.groupBy("seed", "family", "target_function", "piece").applyInPandas(run_group, VERDICT)


def _in_order(pairs: DataFrame, keys: list[str], *order) -> DataFrame:
    """Patch texts and ids of each episode, in order (as many as candidates concern it)."""
    row = F.struct(*order, "patch_id", "patch_text")
    sorted_rows = F.array_sort(F.collect_list(row))
    return pairs.groupBy(*keys).agg(sorted_rows.alias("r")).select(*keys, F.col("r.patch_text").alias("texts"))


def held_out_success(accepted: DataFrame, held_out: DataFrame, families, make_runner) -> DataFrame:
    """(seed, method, episode_id, failure_class, success, n_patches) under the accepted patches of each family."""
    grid = held_out.withColumn("family", F.explode(F.array(*map(F.lit, families))))
    texts = _in_order(concerns(accepted, held_out), ["seed", "family", "episode_id"], "rank")
    rows = grid.join(texts, ["seed", "family", "episode_id"], "left").select("seed", "family", "episode_id", "failure_class", "record", "texts")

    def build():
        run = make_runner()
        return lambda batch: batch.assign(success=[judged(run, r, list(t)) for r, t in zip(batch["record"], batch["texts"])])

    schema = rows.withColumn("success", F.lit(False)).schema
    out = generate_where(rows, F.col("texts").isNotNull(), build, schema, {"success": F.lit(False)})
    method, n = F.concat("family", F.lit("-evo")), F.coalesce(F.size("texts"), F.lit(0))
    return out.select("seed", method.alias("method"), "episode_id", "failure_class", "success", F.when(F.col("texts").isNull(), 0).otherwise(n).cast("long").alias("n_patches"))


def oracle_success(candidates: DataFrame, held_out: DataFrame, families, make_runner) -> DataFrame:
    """As ``held_out_success``: each candidate alone, by family and rank, up to the first success; n_patches are those tried."""
    place = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    pairs = concerns(candidates, held_out).withColumn("place", place)
    rows = _in_order(pairs, ["seed", "episode_id"], "place", "rank").join(held_out.select("seed", "episode_id", "failure_class", "record"), ["seed", "episode_id"])

    def build():
        run = make_runner()

        def tried(record, texts):
            for n, text in enumerate(texts, 1):
                if judged(run, record, [text]):
                    return True, n
            return False, len(texts)

        def batch_of(batch):
            found = [tried(r, t) for r, t in zip(batch["record"], batch["texts"])]
            return pd.DataFrame({"seed": batch["seed"], "episode_id": batch["episode_id"], "success": [a for a, _ in found], "n_patches": [b for _, b in found]})

        return batch_of

    out = generate(rows, build, "seed long, episode_id string, success boolean, n_patches long")
    whole = held_out.select("seed", "episode_id", "failure_class").join(out, ["seed", "episode_id"], "left")
    return whole.select("seed", F.lit("oracle").alias("method"), "episode_id", "failure_class", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("n_patches", F.lit(0)).cast("long").alias("n_patches"))


def seed_rows(records: DataFrame) -> DataFrame:
    """Rows, passes and pass rates of each (seed, method): overall and of either failure class (null without one)."""
    ok, columns = F.col("success").cast("long"), []
    for name, where in (("overall", F.lit(True)), ("router", F.col("failure_class") == "router_fail"), ("validator", F.col("failure_class") == "validator_fail")):
        n, passed = F.count_if(where), F.coalesce(F.sum(F.when(where, ok)), F.lit(0))
        columns += [n.alias(f"{name}_n"), passed.alias(f"{name}_pass"), F.try_divide(passed, n).alias(f"{name}_pass_rate")]
    return records.groupBy("seed", "method").agg(*columns)


def summary(rows: DataFrame) -> DataFrame:
    """Mean over the seeds and its 95 % interval, per method."""
    columns = []
    for name in ("overall", "router", "validator"):
        rate = F.col(f"{name}_pass_rate")
        half = 1.96 * F.stddev_samp(rate) / F.sqrt(F.count(rate))
        columns += [F.avg(rate).alias(f"{name}_mean"), F.when(F.count(rate) > 0, F.coalesce(half, F.lit(0.0))).alias(f"{name}_ci95"), F.count(rate).alias(f"{name}_seeds")]
    return rows.groupBy("method").agg(*columns)


def context(accepted: DataFrame) -> DataFrame:
    """Number and tokens of the accepted patches, per seed and family."""
    return accepted.groupBy("seed", "family").agg(F.count("*").alias("n_patches"), F.avg("token_count").alias("mean_tokens"), F.sum("token_count").alias("total_tokens"))


@dataclass
class Evolution:
    verdicts: DataFrame
    accepted: DataFrame
    records: DataFrame

    @property
    def seed_rows(self) -> DataFrame:
        return seed_rows(self.records)


def evolve(failures: DataFrame, seeds: list[int], make_runner: Callable[[], Runner], families=p.FAMILIES) -> Evolution:
    """Failures (episode_id, failure_class, record) through split, loops, held-out evaluation and oracle of every seed."""
    episodes = cut(splits(with_keys(failures), seeds))
    made = cut(p.materialize(failures))
    train = episodes.filter("part = 'train'").select("seed", "rank", F.col("episode_id").alias("trigger_episode_id"))
    candidates = made.filter(F.col("family").isin(list(families))).join(train, "trigger_episode_id")
    validation, held_out = (episodes.filter(F.col("part") == part) for part in ("validation", "held_out"))
    verdicts = cut(fold(candidates, validation, make_runner))
    good = verdicts.filter("accepted").select("seed", "patch_id")
    accepted = cut(candidates.join(good, ["seed", "patch_id"]))
    none = held_out.select("seed", F.lit("no-evolution").alias("method"), "episode_id", "failure_class", F.lit(False).alias("success"), F.lit(0).cast("long").alias("n_patches"))
    evolved = held_out_success(accepted, held_out, families, make_runner)
    records = cut(none.unionByName(evolved).unionByName(oracle_success(candidates, held_out, families, make_runner)))
    return Evolution(verdicts, accepted, records)
