"""Lineage of many sources, target families, targeted and capped sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import bitmaps, datasets, ordering as o, targets
from loomspan.plans.registry import query
from loomspan.plans.samples import SPLIT

TOUCHES = """touch AS (SELECT 'train:main' AS source, doc_id FROM labels WHERE quality = 1 AND doc_id % 3 > 0 UNION ALL SELECT 'train:star', doc_id FROM labels WHERE toxic = 1
  UNION ALL SELECT 'eval:grid', doc_id FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'eval:arena', doc_id FROM documents WHERE doc_id % 11 = 3)"""


def _touches(t):
    """Four sources of touches, of both kinds."""
    named = lambda rows, name: rows.select(F.lit(name).alias("source"), "doc_id")
    return (
        named(t.labels.filter("quality = 1 AND doc_id % 3 > 0"), "train:main")
        .unionByName(named(t.labels.filter("toxic = 1"), "train:star"))
        .unionByName(named(t.documents.filter("doc_id % 7 = 0"), "eval:grid"))
        .unionByName(named(t.documents.filter("doc_id % 11 = 3"), "eval:arena"))
    )


def _bits(t):
    numbers = bitmaps.numbered(t.documents, "doc_id")
    return numbers, bitmaps.bitmaps(_touches(t), numbers, "source", "doc_id")


def of_kind(kind):
    return F.startswith(F.col("source"), F.lit(f"{kind}:"))


@query(f"""
WITH {TOUCHES}, d AS (SELECT lang || '/' || source AS category, doc_id, doc_id IN (SELECT doc_id FROM touch WHERE source LIKE 'train:%') AS t,
  doc_id IN (SELECT doc_id FROM touch WHERE source LIKE 'eval:%') AS e FROM documents)
SELECT category, count(*) AS n_ids, count(*) FILTER (t) AS n_trained, count(*) FILTER (e AND NOT t) AS n_eval_only, count(*) FILTER (NOT t AND NOT e) AS n_untouched,
  CASE WHEN bool_or(t) THEN 'train_touched' WHEN bool_or(e) THEN 'eval_touched_only' ELSE 'never_touched' END AS status FROM d GROUP BY category""")
def touch_table(t):
    """What training and evaluation touched of every category, from bitmaps of all sources."""
    numbers, bits = _bits(t)
    of = t.documents.select(F.concat_ws("/", "lang", "source").alias("category"), "doc_id")
    return bitmaps.touch_table(bits, bitmaps.bitmaps(of, numbers, "category", "doc_id"), of_kind("train"), of_kind("eval"))


@query(f"""
WITH {TOUCHES}, h AS (SELECT doc_id FROM labels WHERE quality = 0), f AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM touch WHERE source LIKE 'train:%') AS t,
  doc_id IN (SELECT doc_id FROM touch WHERE source = 'eval:grid') AS e FROM h)
SELECT count(*) AS n_total, count(*) FILTER (t) AS n_trained, count(*) FILTER (e) AS n_evaluated, count(*) FILTER (t AND e) AS n_both, count(*) FILTER (NOT t AND NOT e) AS n_residual FROM f""")
def heldout_decomposition(t):
    """Held-out successes by what touched them before: training, an old evaluation, both, neither."""
    numbers, bits = _bits(t)
    held = t.labels.filter("quality = 0").select(F.lit("held:success").alias("source"), "doc_id")
    both = bits.unionByName(bitmaps.bitmaps(held, numbers, "source", "doc_id"))
    return bitmaps.decomposition(both, "held:success", of_kind("train"), "eval:grid")


@query(f"WITH {TOUCHES} SELECT DISTINCT source, doc_id FROM touch")
def touch_members(t):
    """Bitmaps back to their ids."""
    numbers, bits = _bits(t)
    return bitmaps.members(bits, numbers, "doc_id")


RUNS = """o AS (SELECT doc_id, run, (doc_id * (run + 3)) % 7 > 1 AS success, CASE WHEN doc_id % 5 > 0 THEN 'out' || (doc_id + run) % 3 END AS output FROM labels, (SELECT unnest([0, 1, 2, 3]) AS run) WHERE quality = 1)"""


@query(f"""
WITH {SPLIT}, {RUNS},
rep AS (SELECT DISTINCT s.part AS split, s.doc_id, 't' || s.doc_id % 4 AS output, 'fn_' || s.doc_id % 9 AS fn FROM split s WHERE toxic = 1 AND part <> 'held_out'),
smp AS (SELECT s.doc_id, 'c' || x % 2 AS output, 'fn_' || s.doc_id % 9 AS fn FROM split s, (SELECT unnest(range(0, 4)) AS x) WHERE quality = 0 AND part = 'train' GROUP BY ALL),
fr AS (SELECT doc_id, count(*) FILTER (NOT success AND run < 2) = 2 AS shared, count(*) FILTER (NOT success AND run >= 2) > 0 AS united,
  coalesce(string_agg('r' || run || '=' || output, ',' ORDER BY run) FILTER (NOT success AND output IS NOT NULL), '') AS flips FROM o GROUP BY doc_id)
SELECT 'teacher:' || split || ':e' || doc_id AS target_id, split || '_teacher_repaired' AS target_family, split, output AS target_output, fn AS function_name, NULL::BOOLEAN AS first_shared_fragile, NULL::BOOLEAN AS united_fragile, NULL::VARCHAR AS flips FROM rep
UNION ALL SELECT 'base_pass16:train:e' || doc_id, 'train_base_pass16_success', 'train', output, fn, NULL, NULL, NULL FROM smp
UNION ALL SELECT 'r_success_correct:e' || l.doc_id, 'r_success_correct', 'r_success_eval', 'right', 'fn_' || l.doc_id % 9, shared, united, flips FROM labels l JOIN fr ON fr.doc_id = l.doc_id WHERE quality = 1""")
def target_families(t):
    """Repaired, sampled and right outputs to be scored, with the fragile ones and their flips in four runs."""
    split = o.split_by_hash(t.labels, "doc_id")
    episode, fn = F.concat(F.lit("e"), "doc_id").alias("episode_id"), F.concat(F.lit("fn_"), F.col("doc_id") % 9).alias("function_name")
    part = F.lit("scaffold_only").alias("partition")
    repaired = split.filter("toxic = 1").select(episode, part, F.concat(F.lit("t"), F.col("doc_id") % 4).alias("target_output"), fn)
    samples = split.filter("quality = 0").withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    samples = samples.select(episode, part, F.concat(F.lit("c"), F.col("sample_index") % 2).alias("target_output"), fn, "sample_index")
    right = t.labels.filter("quality = 1").select(episode, F.lit("right").alias("target_output"), fn)
    runs = t.labels.filter("quality = 1").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(3))))
    output = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("out"), (F.col("doc_id") + F.col("run")) % 3))
    outcomes = runs.select(F.concat(F.lit("r"), "run").alias("run"), episode, ((F.col("doc_id") * (F.col("run") + 3)) % 7 > 1).alias("success"), output.alias("output"))
    made = targets.families(repaired.unionByName(repaired), samples, right, split.select(episode, "part"), outcomes, ["r0", "r1"], ["r2", "r3"])
    flips = F.array_join(F.transform(F.map_entries("flipped_outputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return made.select("target_id", "target_family", "split", "target_output", "function_name", "first_shared_fragile", "united_fragile", flips.alias("flips"))


POOL = f"""{SPLIT}, f AS (SELECT doc_id, quality, part, 'fn' || doc_id % 40 || '_' || lang AS fn FROM split JOIN documents USING (doc_id)),
bad AS (SELECT DISTINCT fn FROM f WHERE part = 'train' AND quality = 0 AND doc_id % 40 < 20 AND fn LIKE '%_en'),
pool AS (SELECT doc_id, fn, CASE WHEN fn IN (SELECT fn FROM bad) THEN 1 WHEN split_part(fn, '_', 1) IN (SELECT split_part(fn, '_', 1) FROM bad) THEN 2 ELSE 3 END AS tier FROM f WHERE part <> 'validation' AND quality = 1)"""


def _pool(t):
    """(core, pool, failed, forbidden) of the labelled documents; functions of two words, so that they have families."""
    rows = o.split_by_hash(t.labels, "doc_id").join(t.documents.select("doc_id", "lang"), "doc_id")
    rows = rows.select(F.concat(F.lit("e"), "doc_id").alias("episode_id"), "doc_id", "quality", "part", F.concat(F.lit("fn"), F.col("doc_id") % 40, F.lit("_"), "lang").alias("function_name"))
    failed = rows.filter("part = 'train' AND quality = 0 AND doc_id % 40 < 20 AND function_name LIKE '%_en'")
    columns = ["episode_id", "function_name", F.lit("replay").alias("partition")]
    validation = rows.filter("part = 'validation'").select("episode_id")
    core = failed.select("episode_id", "function_name", F.lit("scaffold_only").alias("partition"))
    return core, rows.filter("quality = 1").select(*columns), failed, {"validation": validation}


@query(f"""
WITH {POOL}, first AS (SELECT *, count(*) OVER () AS n FROM pool WHERE tier = (SELECT min(tier) FROM pool)),
r AS (SELECT doc_id, fn, tier, n, unnest(range(0, ceil(90.0 / n)::BIGINT)) AS round FROM first),
k AS (SELECT *, row_number() OVER (ORDER BY round, sha256((20260702 + round) || ':targeted:' || tier || ':' || 'e' || doc_id), 'e' || doc_id) AS i FROM r)
SELECT 'e' || doc_id AS episode_id, fn AS function_name, 'replay' AS partition, round::INT AS round FROM k WHERE i <= 90
UNION ALL SELECT 'e' || doc_id, fn, 'scaffold_only', 0 FROM f WHERE part = 'train' AND quality = 0 AND doc_id % 40 < 20 AND fn LIKE '%_en'""")
def targeted_set(t):
    """A core and 90 replay rows near to its failures; none of them is a validation episode."""
    core, pool, failed, forbidden = _pool(t)
    made = datasets.targeted(core, pool, failed, forbidden, 90, o.DATASET_SEED)
    return made.select("episode_id", "function_name", "partition", F.col("round").cast("int").alias("round"))


@query(f"""
WITH {POOL}, c AS (SELECT *, row_number() OVER (ORDER BY sha256('20260702:capped_arena_split:' || 'e' || doc_id), 'e' || doc_id) AS i FROM pool),
allowed AS (SELECT * FROM c WHERE i <= 30), u AS (SELECT doc_id, unnest(range(0, 3)) AS round FROM allowed),
first AS (SELECT *, count(*) OVER () AS n FROM allowed WHERE tier = (SELECT min(tier) FROM allowed)), r AS (SELECT doc_id, tier, n, unnest(range(0, ceil(90.0 / n)::BIGINT)) AS round FROM first),
k AS (SELECT *, row_number() OVER (ORDER BY round, sha256((20260702 + round) || ':capped_targeted:' || tier || ':' || 'e' || doc_id), 'e' || doc_id) AS j FROM r)
SELECT 'arena' AS kind, 'e' || doc_id AS episode_id, 0 AS round FROM c WHERE i > 30 UNION ALL SELECT 'uniform', 'e' || doc_id, round::INT FROM u UNION ALL SELECT 'targeted', 'e' || doc_id, round::INT FROM k WHERE j <= 90""")
def capped_sets(t):
    """An arena, and two sets of 90 replay rows from 30 episodes that it leaves out."""
    _, pool, failed, forbidden = _pool(t)
    open_ = pool.join(forbidden["validation"], "episode_id", "left_anti").select(*pool.columns)
    made = datasets.capped(open_, failed, forbidden, 30, 90, o.DATASET_SEED)
    row = lambda rows, kind, turn: rows.select(F.lit(kind).alias("kind"), "episode_id", turn.cast("int").alias("round"))
    return row(made.arena, "arena", F.lit(0)).unionByName(row(made.uniform, "uniform", F.col("round"))).unionByName(row(made.targeted, "targeted", F.col("round")))
