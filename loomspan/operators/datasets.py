"""Training datasets from verified outputs: rows, balance, replay and leakage checks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.functions import calls
from loomspan.functions.numbers import replay_size
from loomspan.functions.text import coarse_family
from loomspan.operators import lineage, ordering as o
from loomspan.shared import cut

#: Columns of a training row.
ROW = ("episode_id", "source", "partition", "failure_class", "function_name", "sample_index", "input", "output")


def filled(template: str, **fields: Column) -> Column:
    """A ``{name}`` template with columns in place of the names."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        pieces += [F.lit(literal)] if literal else []
        pieces += [F.coalesce(fields[name], F.lit(""))] if name else []
    return F.concat(*pieces)


def canonical_output(call: Column) -> Column:
    """The canonical text of a call given as JSON."""
    return calls.text_udf(lambda s: calls.call_from(json.loads(s)).canonical(), "string", None)(call)


def training_rows(records: DataFrame, template: str, source: str, partition: Column | None = None) -> DataFrame:
    """Training rows of records with episode_id, query, functions (JSON) and call (JSON).

    failure_class, function_name, partition and sample_index have defaults
    where the records lack them.
    """
    has = set(records.columns)
    own = lambda name, default, kind: F.coalesce(F.col(name), default) if name in has else default.cast(kind)
    part = partition if partition is not None else own("partition", F.lit("unknown"), "string")
    return records.select(
        "episode_id",
        F.lit(source).alias("source"),
        part.alias("partition"),
        own("failure_class", F.lit("none"), "string").alias("failure_class"),
        own("function_name", F.lit(""), "string").alias("function_name"),
        own("sample_index", F.lit(None), "long").cast("long").alias("sample_index"),
        filled(template, query=F.col("query"), function_doc=F.col("functions")).alias("input"),
        canonical_output(F.col("call")).alias("output"),
    )


def distinct_rows(rows: DataFrame) -> DataFrame:
    """One row per (episode, source, output), the one of the least sample."""
    return o.keep_first(rows, ["episode_id", "source", "output"], F.coalesce("sample_index", F.lit(-1)))


@dataclass
class Plan:
    """Sizes of a dataset: the core's bound, replay rows a core row, STaR rows a main row."""

    seed: int = o.DATASET_SEED
    max_core: int = 1_000_000
    replay_ratio: float = 1.0
    star_ratio: float = 1.0
    min_total: int = 0
    #: Share of the main core that the STaR rows must reach, or the core shrinks.
    balance: float = 0.9

    def core_size(self, n_teacher: int, n_star: int) -> int:
        size = min(self.max_core, n_teacher, int(n_star / self.balance) if n_star else n_teacher)
        if not n_star and round(size * (1 + self.replay_ratio)) < self.min_total:
            size = min(n_teacher, self.max_core, -int(-self.min_total // (1 + self.replay_ratio)))
        return size

    def star_size(self, n_main: int, n_star: int) -> int:
        return min(n_star, max(1, round(n_main * self.star_ratio)))


def sampled(rows: DataFrame, count: int, seed: int, label: str) -> DataFrame:
    """``count`` rows of the least hash of seed, label, episode, source and output."""
    parts = [seed, label, F.col("episode_id"), F.col("source"), F.col("output")]
    return o.sample_by_hash(rows, count, parts, "sample_index").drop("hash")


@dataclass
class Datasets:
    main: DataFrame
    star: DataFrame
    counts: dict

    def distribution(self, column: str) -> DataFrame:
        both = self.main.withColumn("dataset", F.lit("main")).unionByName(self.star.withColumn("dataset", F.lit("star")))
        return both.groupBy("dataset", column).agg(F.count("*").alias("n"))


def build(teacher: DataFrame, star: DataFrame, replay: DataFrame, forbidden: dict[str, DataFrame], plan: Plan = Plan()) -> Datasets:
    """Balanced cores with replay rows; raises if either dataset meets a forbidden id set.

    ``teacher`` and ``replay`` rows are deduplicated; repeated STaR outputs
    stay. Replay rows of forbidden ids are left out beforehand.
    """
    teacher, star = cut(distinct_rows(teacher)), cut(star)  # counted, sampled and checked: rendered once
    for ids in forbidden.values():
        replay = replay.join(ids.select("episode_id").distinct(), "episode_id", "left_anti").select(*ROW)
    replay = cut(distinct_rows(replay))
    n_teacher, n_star, n_replay = teacher.count(), star.count(), replay.count()
    n_main = plan.core_size(n_teacher, n_star)
    n_star_core = plan.star_size(n_main, n_star)
    made, counts = {}, {"teacher": n_teacher, "star": n_star, "replay": n_replay, "main_core": n_main, "star_core": n_star_core}
    for name, rows, size in (("main", teacher, n_main), ("star", star, n_star_core)):
        core = sampled(rows, size, plan.seed, f"{name}_core")
        counts[f"{name}_replay"] = min(n_replay, replay_size(size, plan.replay_ratio))
        made[name] = cut(core.unionByName(sampled(replay, counts[f"{name}_replay"], plan.seed, f"{name}_replay")))
        for label, ids in forbidden.items():
            lineage.assert_disjoint(made[name], ids, "episode_id", f"{name} and {label}")
    return Datasets(made["main"], made["star"], counts)


def with_tiers(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Add ``tier``: 1 exact function of a training failure, 2 its coarse family, 3 any other."""
    names = failed.select("function_name").distinct()
    kinds = names.select(coarse_family(F.col("function_name")).alias("family")).distinct().withColumn("coarse", F.lit(True))
    placed = rows.withColumn("family", coarse_family(F.col("function_name"))).join(names.withColumn("exact", F.lit(True)), "function_name", "left").join(kinds, "family", "left")
    tier = F.when(F.col("exact"), 1).when(F.col("coarse"), 2).otherwise(3)
    return placed.select(*rows.columns, tier.alias("tier"))


def targeted(core: DataFrame, pool: DataFrame, failed: DataFrame, forbidden: dict[str, DataFrame], n: int, seed: int, label: str = "targeted") -> DataFrame:
    """A core (its own replay left out) with n replay rows of ``pool`` near to what failed in training, with repeats.

    Raises if the pool is empty, or if the set meets a forbidden id set.
    """
    for ids in forbidden.values():
        pool = pool.join(ids.select("episode_id").distinct(), "episode_id", "left_anti").select(*pool.columns)
    replay = o.staged_repeats(with_tiers(pool, failed), "tier", "episode_id", n, seed, label)
    made = core.filter("partition <> 'replay'").withColumn("round", F.lit(0)).unionByName(replay.select(*core.columns, "round"))
    for name, ids in forbidden.items():
        lineage.assert_disjoint(made, ids, "episode_id", f"{label} set and {name}")
    return made


@dataclass
class Capped:
    arena: DataFrame
    uniform: DataFrame
    targeted: DataFrame


def capped(pool: DataFrame, failed: DataFrame, forbidden: dict[str, DataFrame], unique: int, n: int, seed: int) -> Capped:
    """A pool cut in ``unique`` replay rows and an arena that nothing trains on; n replay rows drawn from the former, both ways.

    Raises if the pool is short, or if arena and replay, or the arena and a forbidden id set, meet.
    """
    size = pool.count()
    if size < unique:
        raise ValueError(f"{size} rows for {unique}")
    parts = cut(o.cut_by_hash(pool, unique, [seed, "capped_arena_split", F.col("episode_id")], "episode_id", "allowed", "arena"))
    arena, allowed = (parts.filter(F.col("part") == p).drop("part") for p in ("arena", "allowed"))
    lineage.assert_disjoint(arena, allowed, "episode_id", "arena and replay")
    for name, ids in forbidden.items():
        lineage.assert_disjoint(arena, ids, "episode_id", f"arena and {name}")
    uniform = o.take_with_repeats(allowed, "episode_id", n, seed, "capped_uniform")
    return Capped(arena, uniform, o.staged_repeats(with_tiers(allowed, failed), "tier", "episode_id", n, seed, "capped_targeted").drop("tier"))
