"""Grouping, summary and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import drift, text
from loomspan.functions.text import stable_name as name_of

from loomspan.operators.summaries import ci95 as interval, r6, ratio, score_summary as scores, upper_median as upper
from loomspan.operators.generation import partition_of
from loomspan.operators.ranks import quantiles
from loomspan.plans.registry import query
from loomspan.plans.samples import arg_k

def heavy():
    return F.col("value") > 8


@query("""
SELECT coalesce(event_type, 'all') AS event_type, coalesce((user_id % 4)::VARCHAR, 'all') AS bucket, grouping(event_type) * 2 + grouping(user_id % 4) AS level, count(*) AS n_total,
  count(*) FILTER (value > 8) AS n_heavy, round(count(*) FILTER (value > 8) / count(*), 6) AS rate
FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())""")
def summary_grouping_sets(t):
    rows = t.events.withColumns({"bucket": (F.col("user_id") % 4).cast("string"), "heavy": heavy().cast("int")})
    out = rows.groupingSets([["event_type"], ["bucket"], []], "event_type", "bucket").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n_total"), F.sum("heavy").alias("n_heavy"), r6(F.avg("heavy")).alias("rate")
    )
    return out.fillna("all", ["event_type", "bucket"])


@query("""
SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def summary_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        (F.grouping("l_returnflag") + F.grouping("l_linestatus")).alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("SELECT coalesce(event_type, '') AS event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t):
    return t.events.groupBy(F.coalesce("event_type", F.lit("")).alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT (props->>'k')::INT AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 20")
def topk_counts(t):
    """The 20 commonest values (the report's own limit), ties by first appearance."""
    counts = t.events.groupBy(arg_k().alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(20).select("k", "n")


@query("SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def basic_stats(t):
    return t.events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), r6(F.avg("value")).alias("mean"))


@query("""
SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS std FROM events GROUP BY event_type""")
def stat_pop(t):
    std = F.coalesce(F.stddev_pop("value"), F.lit(0.0))
    return t.events.groupBy("event_type").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), r6(F.avg("value")).alias("mean"), r6(std).alias("std")
    )


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean,
  round(CASE WHEN count(value) = 1 THEN 0 ELSE 1.96 * stddev_samp(value) / sqrt(count(value)) END, 6) AS ci95 FROM events GROUP BY event_type""")
def ci95(t):
    return t.events.groupBy("event_type").agg(*interval("value"))


@query("""
WITH s AS (SELECT event_type, user_id % 5 AS seed, avg((value > 8)::INT) AS rate FROM events GROUP BY 1, 2)
SELECT event_type, count(rate) AS n, round(avg(rate), 6) AS mean,
  round(CASE WHEN count(rate) = 1 THEN 0 ELSE 1.96 * stddev_samp(rate) / sqrt(count(rate)) END, 6) AS ci95 FROM s GROUP BY event_type""")
def seed_summary(t):
    seeds = t.events.groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg(heavy().cast("int")).alias("rate"))
    return seeds.groupBy("event_type").agg(*interval("rate"))


@query("""
SELECT coalesce(round(avg((value > 8)::INT), 6), 0.0) AS overall, round(avg((value > 8)::INT) FILTER (event_type = 'click'), 6) AS router,
  round(avg((value > 8)::INT) FILTER (event_type = 'view'), 6) AS validator, round(avg((value > 8)::INT) FILTER (event_type = 'absent'), 6) AS absent FROM events""")
def pass_rates(t):
    passed = heavy().cast("int")
    given = lambda arm: r6(F.avg(F.when(F.col("event_type") == arm, passed)))
    return t.events.agg(
        F.coalesce(r6(F.avg(passed)), F.lit(0.0)).alias("overall"), given("click").alias("router"), given("view").alias("validator"), given("absent").alias("absent")
    )


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = n // 2) AS upper_median FROM r GROUP BY event_type""")
def upper_median(t):
    return upper(t.events, "event_type", "value")


@query("""
SELECT count(*) AS n_docs, count(*) FILTER (text <> '') AS n_text, count(*) FILTER (lang <> '') AS n_lang,
  (SELECT count(*) FILTER (url <> '') FROM pages) AS n_url, (SELECT count(*) FILTER (html <> '') FROM pages) AS n_html FROM documents""")
def field_coverage(t):
    filled = lambda c: F.count_if(F.coalesce(F.col(c) != "", F.lit(False)))
    docs = t.documents.agg(F.count("*").alias("n_docs"), filled("text").alias("n_text"), filled("lang").alias("n_lang"))
    pages = t.pages.agg(filled("url").alias("n_url"), filled("html").alias("n_html"))
    return docs.join(pages, F.lit(True))  # one row each


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY event_type""")
def score_summary(t):
    return scores(t.events, ["event_type"], "value")


@query("""
SELECT event_type, user_id % 4 AS bucket, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high
FROM events GROUP BY 1, 2""")
def score_by_group(t):
    return scores(t.events.withColumn("bucket", F.col("user_id") % 4), ["event_type", "bucket"], "value")


@query("""
SELECT user_id % 3 AS part, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY 1""")
def score_quantiles(t):
    """Interpolated quantiles of large groups, exact."""
    found = quantiles(t.events.withColumn("part", F.col("user_id") % 3), ["part"], "value", 0.1, 0.9, 0.99)
    return found.select("part", *(r6(F.col("quantiles")[i]).alias(name) for i, name in enumerate(("p10", "p90", "p99"))))


USERS = """p AS (SELECT user_id, CASE WHEN bool_or(event_type = 'click' AND value > 100) THEN 'sampling_rescuable'
  WHEN bool_or(event_type = 'error' AND value > 100) THEN 'scaffold_only' ELSE 'neither' END AS part FROM events GROUP BY user_id)"""


def partitions(t):
    """sampling_rescuable before scaffold_only before neither."""
    hit = lambda arm: F.bool_or((F.col("event_type") == arm) & (F.col("value") > 100))
    users = t.events.groupBy("user_id").agg(hit("click").cast("int").alias("hits"), hit("error").alias("scaffold"))
    return users.select("user_id", partition_of(F.col("hits"), F.col("scaffold")).alias("part"))


@query(f"WITH {USERS} SELECT user_id, part FROM p")
def partition_episode(t):
    return partitions(t)


@query(f"""
WITH {USERS} SELECT count(*) AS n, count(*) FILTER (part = 'sampling_rescuable') AS n_sampling, count(*) FILTER (part = 'scaffold_only') AS n_scaffold,
  count(*) FILTER (part = 'neither') AS n_neither, round(coalesce(count(*) FILTER (part = 'sampling_rescuable') / nullif(count(*) FILTER (part <> 'neither'), 0), 0), 6) AS rescued_share FROM p""")
def partition_stats(t):
    n = lambda part: F.count_if(F.col("part") == part)
    return partitions(t).agg(
        F.count("*").alias("n"),
        n("sampling_rescuable").alias("n_sampling"),
        n("scaffold_only").alias("n_scaffold"),
        n("neither").alias("n_neither"),
        r6(ratio(n("sampling_rescuable"), F.count_if(F.col("part") != "neither"))).alias("rescued_share"),
    )


@query("SELECT doc_id, CASE WHEN quality <> 1 THEN 'router_fail' WHEN toxic <> 1 THEN 'validator_fail' ELSE 'none' END AS failure_class FROM labels")
def classify_failure(t):
    return t.labels.select("doc_id", drift.failure_class(F.col("quality") == 1, F.col("toxic") == 1).alias("failure_class"))


@query("SELECT source, count(*) AS n, CASE WHEN count(*) >= 50 THEN 'GO' ELSE 'STOP_LT_50' END AS gate FROM documents GROUP BY source")
def gate_label(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).withColumn("gate", drift.gate(F.col("n")))


@query("SELECT source, lang, count(*) AS n, CASE WHEN count(*) < 30 THEN 'PROBE' ELSE '' END AS tag FROM documents GROUP BY source, lang")
def probe_tag(t):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("tag", drift.probe_tag(F.col("n")))


@query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_' || p_size || '_') WHEN 1 THEN replace(p_name, ' ', '.')
  WHEN 2 THEN replace(p_name, ' ', '_') ELSE p_type END AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '^[^_]+_[0-9]+_') THEN regexp_extract(name, '^([^_]+)_[0-9]+_', 1)
  WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE split_part(name, '_', 1) END AS family FROM n""")
def coarse_family(t):
    form = F.col("p_partkey") % 4
    spaced = lambda by: F.replace("p_name", F.lit(" "), by)
    name = (
        F.when(form == 0, spaced(F.concat(F.lit("_"), F.col("p_size").cast("string"), F.lit("_"))))
        .when(form == 1, spaced(F.lit(".")))
        .when(form == 2, spaced(F.lit("_")))
        .otherwise(F.col("p_type"))
    )
    rows = t.part.select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", text.coarse_family(F.col("name")).alias("family"))


@query("""
SELECT doc_id, coalesce(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'recorded' END, CASE WHEN lang || '_' || source LIKE 'en_src1%' THEN 'live'
  WHEN lang || '_' || source LIKE 'en%' THEN 'simple' END, lang) AS category FROM documents""")
def category_from_id(t):
    rows = t.documents.select("doc_id", F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string")).alias("id"))
    known = t.labels.select("doc_id", F.lit("recorded").alias("known"))
    joined = rows.join(known, "doc_id", "left")
    found = text.category_of_id(F.col("id"), F.col("known"), {"en_src1": "live", "en": "simple"})
    return joined.select("doc_id", found.alias("category"))


@query("""
SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unknown') AS suffix FROM pages""")
def safe_suffix(t):
    return t.pages.select("page_id", text.safe_suffix(F.col("url")).alias("suffix"))


@query(r"""
WITH p AS (SELECT page_id, 'runs/a.b/' || replace(replace(url, '/', '_'), '.', '_') || '_seed20260703.json' AS path FROM pages)
SELECT page_id, replace(regexp_extract(path, '([^/]*)\.json$', 1), '_seed20260703', '') AS name FROM p""")
def stable_name(t):
    """The name of a result's file without folder, suffix and seed."""
    flat = F.replace(F.replace("url", F.lit("/"), F.lit("_")), F.lit("."), F.lit("_"))
    path = F.concat(F.lit("runs/a.b/"), flat, F.lit("_seed20260703.json"))
    return t.pages.select("page_id", name_of(path).alias("name"))
