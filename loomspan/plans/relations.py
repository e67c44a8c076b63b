"""Joins, set algebra and lineage queries."""

from __future__ import annotations

import json

from pyspark.sql import Window as W, functions as F

from loomspan.functions.calls import parseable, text_udf
from loomspan.operators import lineage, ordering as o
from loomspan.plans.registry import query
from loomspan.plans.samples import arg_k, SPLIT


@query("SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def join_inner(t):
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'unknown') AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_left_default(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_semi(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("""
SELECT event_id, user_id FROM events WHERE event_id NOT IN
  (SELECT event_id FROM events WHERE event_id < (SELECT floor(0.4 * (max(event_id) + 1)) FROM events))""")
def resume_antijoin(t):
    rows = t.events.select("event_id", "user_id")
    edge = rows.agg(F.floor(0.4 * (F.max("event_id") + 1))).first()[0] or 0
    return rows.join(rows.filter(F.col("event_id") < edge).select("event_id"), "event_id", "left_anti")


@query("""
SELECT lang, sum(quality)::BIGINT AS success_a, sum(toxic)::BIGINT AS success_b, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def pivot_success_map(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    arms = joined.groupBy("lang").agg(
        F.create_map(F.lit("a"), F.sum("quality"), F.lit("b"), F.sum("toxic")).alias("success"), F.count("*").alias("n")
    )
    return arms.select("lang", F.col("success")["a"].alias("success_a"), F.col("success")["b"].alias("success_b"), "n")


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('20260630:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM labels),
b AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('20260631:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM labels),
x AS (SELECT doc_id FROM a WHERE r > floor(n * 0.5) + floor(n * 0.25)), y AS (SELECT doc_id FROM b WHERE r > floor(n * 0.5) + floor(n * 0.25))
SELECT doc_id, 'only_a' AS direction FROM x WHERE doc_id NOT IN (SELECT doc_id FROM y)
UNION ALL SELECT doc_id, 'only_b' FROM y WHERE doc_id NOT IN (SELECT doc_id FROM x)""")
def two_sided_diff(t):
    held = lambda seed: o.split_by_hash(t.labels, "doc_id", seed).filter("part = 'held_out'")
    return lineage.two_sided(held(20260630), held(20260631), "doc_id")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def paired_2x2(t):
    a, b = t.labels.select("doc_id", "quality"), t.labels.select("doc_id", "toxic")
    return a.join(b, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""
SELECT source, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source""")
def arena_overlap_audit(t):
    met = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_semi")
    return met.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"))


def _a(t):
    return t.labels.filter("quality = 1").select("doc_id")


def _b(t):
    return t.labels.filter("toxic = 1").select("doc_id")


A, B = "SELECT doc_id FROM labels WHERE quality = 1", "SELECT doc_id FROM labels WHERE toxic = 1"


@query(f"{A} UNION ALL {B}")
def union_all(t):
    return _a(t).unionAll(_b(t))


@query(f"{A} UNION {B}")
def union_distinct(t):
    return _a(t).union(_b(t)).distinct()


@query(f"{A} INTERSECT {B}")
def set_intersect(t):
    return _a(t).intersect(_b(t))


@query(f"{A} EXCEPT {B}")
def set_except(t):
    return _a(t).subtract(_b(t))


@query(f"""
WITH {SPLIT}, parts AS (SELECT doc_id, part FROM split UNION ALL SELECT item_id, 'benchmark' FROM benchmark)
SELECT x.part AS a, y.part AS b, count(*) FILTER (q.hit) AS n_shared
FROM (SELECT DISTINCT part FROM parts) x JOIN (SELECT DISTINCT part FROM parts) y ON x.part < y.part
LEFT JOIN (SELECT u.part AS a, v.part AS b, true AS hit FROM parts u JOIN parts v ON u.doc_id = v.doc_id AND u.part < v.part) q ON q.a = x.part AND q.b = y.part
GROUP BY x.part, y.part""")
def leakage_check(t):
    parts = o.split_by_hash(t.labels, "doc_id").select("doc_id", "part")
    parts = parts.union(t.benchmark.select("item_id", F.lit("benchmark")))
    names = ["benchmark", "held_out", "train", "validation"]
    grid = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sets = parts.groupBy("doc_id").agg(F.collect_set("part").alias("in"))
    counts = sets.agg(*(F.count_if(F.array_contains("in", a) & F.array_contains("in", b)).alias(f"{a}|{b}") for a, b in grid))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("n_shared")) for a, b in grid))
    return counts.select(F.inline(rows))


HEAVY_SETS = """a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 8),
b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 8)"""


def _heavy(t, arm):
    return t.events.filter((F.col("event_type") == arm) & (F.col("value") > 8)).select("user_id").distinct()


@query(f"""
WITH {HEAVY_SETS}, c AS (SELECT count(*) FILTER (a.user_id = b.user_id) AS inter, count(*) FILTER (b.user_id IS NULL) AS only_a,
  count(*) FILTER (a.user_id IS NULL) AS only_b FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT inter, only_a, only_b, round(inter / (inter + only_a + only_b), 6) AS jaccard FROM c""")
def jaccard(t):
    return lineage.overlap_counts(_heavy(t, "error"), _heavy(t, "view"), "user_id")


@query(f"WITH {HEAVY_SETS} SELECT count(*) AS n_missing, count(*) = 0 AS is_subset FROM a WHERE user_id NOT IN (SELECT user_id FROM b)")
def subset_check(t):
    missing = _heavy(t, "error").join(_heavy(t, "view"), "user_id", "left_anti").agg(F.count("*").alias("n_missing"))
    return missing.withColumn("is_subset", F.col("n_missing") == 0)


@query(f"""
WITH {SPLIT} SELECT count(*) AS n_total, count(*) FILTER (toxic = 1) AS n_in_b, count(*) FILTER (part = 'held_out') AS n_held_out,
  count(*) FILTER (toxic <> 1 AND part <> 'held_out') AS n_residual FROM split WHERE quality = 1""")
def overlap_decomposition(t):
    rows = o.split_by_hash(t.labels, "doc_id").filter("quality = 1")
    in_b, held = F.col("toxic") == 1, F.col("part") == "held_out"
    return rows.agg(
        F.count("*").alias("n_total"), F.count_if(in_b).alias("n_in_b"), F.count_if(held).alias("n_held_out"), F.count_if(~in_b & ~held).alias("n_residual")
    )


@query(f"""
WITH {SPLIT}, touched AS (SELECT CASE WHEN part = 'train' THEN 'train' ELSE 'eval' END AS touch_class, source, doc_id FROM split JOIN documents USING (doc_id))
SELECT touch_class, source, count(DISTINCT doc_id) AS n_ids FROM touched GROUP BY touch_class, source""")
def touch_sets(t):
    rows = o.split_by_hash(t.labels, "doc_id").join(t.documents.select("doc_id", "source"), "doc_id")
    kind = F.when(F.col("part") == "train", "train").otherwise("eval")
    return rows.groupBy(kind.alias("touch_class"), "source").agg(F.countDistinct("doc_id").alias("n_ids"))


@query(f"""
WITH {SPLIT} SELECT source, CASE WHEN bool_or(coalesce(part = 'train', false)) THEN 'train_touched'
  WHEN bool_or(part IS NOT NULL) THEN 'eval_touched_only' ELSE 'never_touched' END AS status
FROM documents LEFT JOIN split USING (doc_id) GROUP BY source""")
def touch_status(t):
    rows = t.documents.select("doc_id", "source").join(o.split_by_hash(t.labels, "doc_id"), "doc_id", "left")
    rows = rows.select("source", (F.col("part") == "train").alias("trained"), F.col("part").isNotNull().alias("evaluated"))
    return lineage.touch_status(rows, "source", "trained", "evaluated")


@query("""
SELECT lang, count(*) AS n_rows, count(l.doc_id) AS n_touched, count(*) - count(l.doc_id) AS n_untouched, count(*) FILTER (quality = 1) AS n_success
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang""")
def touch_audit(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels.withColumn("seen", F.lit(1)), "doc_id", "left")
    seen = F.count("seen")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_rows"), seen.alias("n_touched"), (F.count("*") - seen).alias("n_untouched"), F.count_if(F.col("quality") == 1).alias("n_success")
    )


@query("""
WITH r AS (SELECT d.doc_id, lang, l.doc_id IS NOT NULL AS seen, d.doc_id % 5 = 0 AS many, d.doc_id % 11 <> 0 AND d.doc_id % 5 <> 0 AS readable FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang, count(*) AS n_questions, count(*) FILTER (doc_id % 13 <> 0) AS n_answers, CASE WHEN arg_min(many, doc_id) FILTER (doc_id % 13 <> 0) THEN 2 ELSE 1 END AS first_calls,
  count(*) FILTER (readable AND doc_id % 13 <> 0) AS n_parseable,
  NOT arg_min(many, doc_id) FILTER (doc_id % 13 <> 0) AND count(*) FILTER (readable AND doc_id % 13 <> 0) = count(*) FILTER (doc_id % 13 <> 0) AS single_call,
  count(*) FILTER (NOT seen) AS n_unrecorded, list_sort(list(doc_id) FILTER (NOT seen))[1:20]::VARCHAR AS first_unrecorded
FROM r GROUP BY lang""")
def category_inventory(t):
    """Per category: questions, answers, calls of the first answer, readable answers, whether it is a single-call one, and the first 20 unrecorded ids (the report's own limit).

    Documents are the questions; those of ids that 13 divides have no answer,
    5 gives two calls and 11 an answer that is no call.
    """
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.lit(1).alias("seen")), "doc_id", "left")
    one = F.concat(F.lit('{"read_'), "lang", F.lit('": {"k": ['), F.col("doc_id").cast("string"), F.lit("]}}"))
    truth = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))).when(F.col("doc_id") % 11 == 0, F.lit('["none"]')).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    rows = rows.withColumn("truth", F.when(F.col("doc_id") % 13 != 0, truth))
    readable = text_udf(lambda s: bool(s) and parseable(json.loads(s)), "boolean", False)
    rows = rows.withColumns({"readable": readable("truth"), "calls": F.json_array_length("truth")})
    answered = F.col("truth").isNotNull()
    counts = rows.groupBy("lang").agg(
        F.count("*").alias("n_questions"),
        F.count("truth").alias("n_answers"),
        F.min_by("calls", F.when(answered, F.col("doc_id"))).alias("first_calls"),
        F.count_if(answered & F.col("readable")).alias("n_parseable"),
        F.count_if(F.col("seen").isNull()).alias("n_unrecorded"),
    )
    counts = counts.withColumn("single_call", (F.col("first_calls") == 1) & (F.col("n_parseable") == F.col("n_answers")))
    free = rows.filter("seen is null").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    rank = F.row_number().over(W.partitionBy("lang", "bucket").orderBy("doc_id"))
    some = free.withColumn("n", rank).filter("n <= 20").groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, 20).alias("ids"))
    text = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]"))
    return counts.join(some, "lang", "left").withColumn("first_unrecorded", F.when(F.col("ids").isNotNull(), text)).drop("ids")


@query(f"""
WITH {SPLIT}, d AS (SELECT s.*, lang, source FROM split s JOIN documents USING (doc_id)),
f AS (SELECT DISTINCT lang, source FROM d WHERE quality = 0 AND part = 'train'),
w AS (SELECT * FROM d WHERE quality = 0 AND part <> 'train')
SELECT count(*) AS n_wrong, count(*) FILTER ((lang, source) IN (SELECT (lang, source) FROM f)) AS n_exact,
       count(*) FILTER (lang IN (SELECT lang FROM f)) AS n_family, count(*) FILTER (lang NOT IN (SELECT lang FROM f)) AS n_residual FROM w""")
def residual_coverage(t):
    rows = o.split_by_hash(t.labels, "doc_id").join(t.documents.select("doc_id", "lang", "source"), "doc_id").filter("quality = 0")
    known = rows.filter("part = 'train'").select("lang", "source").distinct()
    wrong = rows.filter("part <> 'train'").join(known.withColumn("exact", F.lit(1)), ["lang", "source"], "left")
    wrong = wrong.join(known.select("lang", F.lit(1).alias("family")).distinct(), "lang", "left")
    return wrong.agg(
        F.count("*").alias("n_wrong"), F.count("exact").alias("n_exact"), F.count("family").alias("n_family"), F.count_if(F.col("family").isNull()).alias("n_residual")
    )
