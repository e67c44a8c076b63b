"""Hash order, sampling, dedup and cover queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import lineage, ordering as o
from loomspan.plans.registry import query

SPLIT = """s AS (
  SELECT doc_id, quality, toxic, count(*) OVER () AS n,
         row_number() OVER (ORDER BY sha256('20260630:' || doc_id), doc_id) AS r FROM labels),
split AS (
  SELECT doc_id, quality, toxic, CASE WHEN r <= floor(n * 0.5) THEN 'train'
         WHEN r <= floor(n * 0.5) + floor(n * 0.25) THEN 'validation' ELSE 'held_out' END AS part FROM s)"""


@query(f"WITH {SPLIT} SELECT doc_id, part FROM split")
def hash_split(t):
    return o.split_by_hash(t.labels, "doc_id").select("doc_id", "part")


@query("""
SELECT doc_id, source, sha256('20260702:main_core:' || doc_id || ':' || source) AS hash
FROM documents ORDER BY hash, doc_id LIMIT 100""")
def hash_sample(t):
    docs = t.documents.select("doc_id", "source")
    return o.sample_by_hash(docs, 100, [o.DATASET_SEED, "main_core", F.col("doc_id"), F.col("source")], "doc_id")


@query("""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord FROM labels)
SELECT doc_id, ord, row_number() OVER (ORDER BY sha256('20260704:order:' || doc_id || ':' || ord), doc_id) AS rank FROM p""")
def hash_order(t):
    placed = o.ordinal(t.labels.select("doc_id"), "doc_id")
    return o.hash_ranked(placed, [o.ARENA_SEED, "order", F.col("doc_id"), F.col("ord")], "doc_id").select("doc_id", "ord", "rank")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('20260702:cap:' || doc_id), doc_id) <= 120 THEN 'allowed' ELSE 'arena' END AS part
FROM labels WHERE quality = 1""")
def capped_split(t):
    good = t.labels.filter("quality = 1")
    return o.cut_by_hash(good, 120, [o.DATASET_SEED, "cap", F.col("doc_id")], "doc_id", "allowed", "arena").select("doc_id", "part")


@query("""
WITH p AS (SELECT doc_id, count(*) OVER () AS n FROM labels WHERE quality = 1),
r AS (SELECT doc_id, n, unnest(range(0, ceil(296.0 / n)::BIGINT)) AS round FROM p),
k AS (SELECT doc_id, round, row_number() OVER (ORDER BY round, sha256((20260702 + round) || ':repeat:' || doc_id), doc_id) AS i FROM r)
SELECT doc_id, round::INT AS round FROM k WHERE i <= 296""")
def take_with_repeats(t):
    pool = t.labels.filter("quality = 1").select("doc_id")
    return o.take_with_repeats(pool, "doc_id", 296, o.DATASET_SEED, "repeat").select("doc_id", F.col("round").cast("int").alias("round"))


@query("""
WITH f AS (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
d AS (SELECT doc_id, CASE WHEN (lang, source) IN (SELECT (lang, source) FROM f) THEN 1 WHEN lang IN (SELECT lang FROM f) THEN 2 ELSE 3 END AS tier FROM documents),
k AS (SELECT *, row_number() OVER (ORDER BY tier, sha256('20260702:fill:' || doc_id), doc_id) AS i FROM d)
SELECT tier::INT AS tier, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM k WHERE i <= 150 GROUP BY tier""")
def staged_fill(t):
    docs = t.documents.select("doc_id", "lang", "source")
    failed = docs.join(t.labels.filter("quality = 0"), "doc_id").select("lang", "source").distinct()
    exact = failed.withColumn("exact", F.lit(True))
    coarse = failed.select("lang").distinct().withColumn("coarse", F.lit(True))
    tiers = docs.join(exact, ["lang", "source"], "left").join(coarse, "lang", "left")
    tiers = tiers.withColumn("tier", F.when(F.col("exact"), 1).when(F.col("coarse"), 2).otherwise(3))
    filled = o.staged_fill(tiers, "tier", "doc_id", 150, o.DATASET_SEED, "fill")
    return filled.groupBy("tier").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"))


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n FROM events),
l AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, value, event_id) AS i FROM k WHERE n > 10)
SELECT event_id, event_type FROM k WHERE n <= 10
UNION ALL SELECT event_id, event_type FROM l WHERE i <= 60 - (SELECT count(*) FROM k WHERE n <= 10)""")
def stratified_sample(t):
    return o.stratified_sample(t.events, "event_type", ["value", "event_id"], 10, 60).select("event_id", "event_type")


@query("SELECT user_id, ((row_number() OVER (ORDER BY user_id) - 1) % 3)::INT AS shard FROM (SELECT DISTINCT user_id FROM events)")
def shard_items(t):
    return o.shard_items(t.events.select("user_id").distinct(), "user_id", 3)


@query("SELECT doc_id, ('0x' || substr(sha256('20260630:' || doc_id), 1, 8))::BIGINT AS number FROM labels")
def stable_int(t):
    return t.labels.select("doc_id", o.stable_int(o.SPLIT_SEED, F.col("doc_id"), digits=8).alias("number"))


@query(f"""
WITH {SPLIT},
p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('20260701:regression:' || doc_id), doc_id) AS i FROM split WHERE quality = 1 AND part <> 'held_out')
SELECT doc_id, CASE WHEN i <= 100 THEN 'eval' ELSE 'rest' END AS part FROM p""")
def regression_sets(t):
    open_ = o.split_by_hash(t.labels, "doc_id").filter("quality = 1 and part <> 'held_out'").drop("part")
    return o.cut_by_hash(open_, 100, [o.REGRESSION_SEED, "regression", F.col("doc_id")], "doc_id", "eval", "rest").select("doc_id", "part")


@query("""
SELECT conv_id, turn, row_number() OVER (ORDER BY role, length(text), conv_id, turn) AS position FROM conversations""")
def multi_key_sort(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("size"))
    return o.positions(rows, ["role", "size", "conv_id", "turn"]).select("conv_id", "turn", "position")


@query("""
SELECT min(event_id) AS event_id, user_id, event_type, props FROM events GROUP BY user_id, event_type, props""")
def dedupe_first(t):
    rows = t.events.select("event_id", "user_id", "event_type", "props")
    return o.keep_first(rows, ["user_id", "event_type", "props"], "event_id")


@query("""
WITH p AS (SELECT event_id, count(*) AS n FROM (SELECT event_id FROM events WHERE event_id % 3 = 0 UNION ALL
  SELECT event_id FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 2) GROUP BY event_id)
SELECT count(*) FILTER (p.n > 1) AS n_duplicate, count(*) FILTER (p.n IS NULL) AS n_missing, count(*) FILTER (e.event_id IS NULL) AS n_extra
FROM p FULL JOIN (SELECT event_id FROM events) e ON e.event_id = p.event_id""")
def exact_cover_merge(t):
    rows = t.events.select("event_id")
    shards = [rows.filter(F.col("event_id") % 3 == i) for i in range(3)]
    return lineage.cover_counts(shards[0].unionAll(shards[1]).unionAll(shards[2]), rows, "event_id")


@query("""
WITH f AS (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source)
SELECT source, 'fn_' || lpad(row_number() OVER (ORDER BY first_id)::VARCHAR, 4, '0') AS code FROM f""")
def decouple_mapping(t):
    return o.number_by_first(t.documents, "source", "doc_id")


@query("""
SELECT 'number' AS mapping, count(DISTINCT source) AS n_keys, count(DISTINCT source) AS n_codes, true AS bijective FROM documents
UNION ALL SELECT 'short', count(DISTINCT source), count(DISTINCT substr(source, 1, 4)), count(DISTINCT source) = count(DISTINCT substr(source, 1, 4)) FROM documents""")
def bijection_check(t):
    """A mapping by numbers is one to one; one by the names' first letters is not."""
    codes = o.number_by_first(t.documents, "source", "doc_id")
    short = codes.select("source", F.substring("source", 1, 4).alias("code"))
    named = codes.withColumn("mapping", F.lit("number")).unionByName(short.withColumn("mapping", F.lit("short")))
    return lineage.bijections(named, "mapping", "source", "code")


def arg_k():
    """The argument k of an event."""
    return F.get_json_object("props", "$.k").cast("int")


@query("""
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT (props->>'k')::INT) AS n_k FROM events GROUP BY event_type""")
def distinct_counts(t):
    rows = t.events.withColumn("k", arg_k())
    return rows.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("k").alias("n_k"))


@query("""
SELECT n_props, count(*) AS n_users FROM (SELECT user_id, count(DISTINCT props) AS n_props FROM events WHERE event_type = 'click' GROUP BY user_id) GROUP BY n_props""")
def hist_of_counts(t):
    users = t.events.filter("event_type = 'click'").groupBy("user_id").agg(F.countDistinct("props").alias("n_props"))
    return users.groupBy("n_props").agg(F.count("*").alias("n_users"))


@query("""
SELECT event_type, count(*) AS n_all, count(*) FILTER (value > 8) AS n_heavy,
       count(DISTINCT (user_id, props)) FILTER (value > 8) AS n_deduped, count(DISTINCT user_id) FILTER (value > 8) AS n_users
FROM events GROUP BY event_type""")
def funnel(t):
    heavy = F.col("value") > 8
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n_all"),
        F.count_if(heavy).alias("n_heavy"),
        F.countDistinct(F.when(heavy, F.struct("user_id", "props"))).alias("n_deduped"),
        F.countDistinct(F.when(heavy, F.col("user_id"))).alias("n_users"),
    )


@query("""
WITH s AS (SELECT user_id, list_sort(list_distinct(list((props->>'k')::INT) FILTER (event_type = 'click'))) AS a,
  list_sort(list_distinct(list((props->>'k')::INT) FILTER (event_type = 'view'))) AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id)
SELECT user_id, CASE WHEN a = b THEN 'equal' WHEN len(list_intersect(a, b)) = 0 THEN 'different' ELSE 'ambiguous' END AS identity
FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def output_identity(t):
    rows = t.events.withColumn("k", arg_k())
    of = lambda arm: F.array_sort(F.collect_set(F.when(F.col("event_type") == arm, F.col("k"))))
    sets = rows.groupBy("user_id").agg(of("click").alias("a"), of("view").alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    label = F.when(F.col("a") == F.col("b"), "equal").when(~F.arrays_overlap("a", "b"), "different").otherwise("ambiguous")
    return sets.select("user_id", label.alias("identity"))
