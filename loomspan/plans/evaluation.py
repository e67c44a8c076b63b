"""The metric dictionary: rates, drift, turnover, frontiers and resampling."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from loomspan.operators import ordering as o
from loomspan.operators.skyline import skyline
from loomspan.operators.summaries import bootstrap_means, r6, ratio, score_summary
from loomspan.plans.registry import query
from loomspan.functions.drift import drift_type, exit_label, retention_band, subtype
from loomspan.plans.samples import arg_k, SPLIT

def a_ok():
    return F.col("quality") == 1


def _parts(t):
    return o.split_by_hash(t.labels, "doc_id")


@query("SELECT round(avg(toxic), 6) AS repair, count(*) AS n FROM labels WHERE quality = 0")
def repair_rate(t):
    return t.labels.filter("quality = 0").agg(r6(F.avg("toxic")).alias("repair"), F.count("*").alias("n"))


@query(f"""
WITH {SPLIT} SELECT round(avg(quality), 6) AS repair_a, round(avg(toxic), 6) AS repair_b, round(avg(toxic) / nullif(avg(quality), 0), 6) AS retention,
  round(avg(quality) - avg(toxic), 6) AS wipe_gap FROM split WHERE part = 'held_out'""")
def retention(t):
    a, b = F.avg("quality"), F.avg("toxic")
    return _parts(t).filter("part = 'held_out'").agg(
        r6(a).alias("repair_a"), r6(b).alias("repair_b"), r6(F.try_divide(b, a)).alias("retention"), r6(a - b).alias("wipe_gap")
    )


@query("SELECT count(*) AS n, round(1 - avg(1 - toxic), 6) AS forget, 1 - avg(1 - toxic) <= 0.02 AS passes FROM labels WHERE quality = 1")
def forget_rate(t):
    forget = 1 - F.avg(1 - F.col("toxic"))
    return t.labels.filter("quality = 1").agg(F.count("*").alias("n"), r6(forget).alias("forget"), (forget <= 0.02).alias("passes"))


@query("SELECT round(avg(quality), 6) AS accuracy, count(*) AS n FROM labels")
def overall_accuracy(t):
    return t.labels.agg(r6(F.avg("quality")).alias("accuracy"), F.count("*").alias("n"))


@query(f"""
WITH {SPLIT}, d AS (SELECT s.*, lang, source FROM split s JOIN documents USING (doc_id)), k AS (SELECT * FROM d WHERE part = 'train' AND quality = 0),
h AS (SELECT CASE WHEN source IN (SELECT source FROM k) THEN 'S' ELSE 'N' END || CASE WHEN lang IN (SELECT lang FROM k) THEN 'S' ELSE 'N' END AS cell, quality FROM d WHERE part = 'held_out')
SELECT cell, count(*) AS n, round(avg(quality), 6) AS rate FROM h GROUP BY cell""")
def gen_2x2(t):
    rows = _parts(t).join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    known = rows.filter("part = 'train' and quality = 0")
    seen = lambda c: known.select(c, F.lit("S").alias(f"seen_{c}")).distinct()
    held = rows.filter("part = 'held_out'").join(seen("source"), "source", "left").join(seen("lang"), "lang", "left")
    cell = F.concat(F.coalesce("seen_source", F.lit("N")), F.coalesce("seen_lang", F.lit("N")))
    return held.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("rate"))


@query("SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agree FROM labels")
def teacher_agree(t):
    return t.labels.agg(F.count("*").alias("n"), r6(F.avg((F.col("quality") == F.col("toxic")).cast("int"))).alias("agree"))


@query("""
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, round(avg(quality), 6) AS rate
FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source)""")
def stratified_retention(t):
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    return rows.cube("lang", "source").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("rate")).fillna("all", ["lang", "source"])


@query("SELECT count(*) FILTER (quality = 1) AS n_given, coalesce(round(avg(toxic) FILTER (quality = 1), 6), 0) AS recovery FROM labels")
def conditional_recovery(t):
    return t.labels.agg(F.count_if(a_ok()).alias("n_given"), F.coalesce(r6(F.avg(F.when(a_ok(), F.col("toxic")))), F.lit(0.0)).alias("recovery"))


@query(f"""
WITH {SPLIT} SELECT coalesce(lang, 'all') AS lang, coalesce(part, 'all') AS part, count(*) AS n, round(avg(quality), 6) AS rate
FROM split JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, part), (lang), (part))""")
def strata_rates(t):
    rows = _parts(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    out = rows.groupingSets([["lang", "part"], ["lang"], ["part"]], "lang", "part").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("rate"))
    return out.fillna("all", ["lang", "part"])


def _calls(rows, group):
    """A call per group and day: the commonest event is its name, the counts of heavy events are its arguments.

    A day of 7 events or a multiple gave no call that could be read.
    """
    kinds = rows.groupBy(*group, F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("heavy"))
    entry = F.when(F.col("heavy") > 0, F.struct("event_type", "heavy"))
    name = F.min_by("event_type", F.struct(-F.col("n"), "event_type"))
    return kinds.groupBy(*group, "day").agg(name.alias("name"), F.map_from_entries(F.collect_list(entry)).alias("args"), (F.sum("n") % 7 != 0).alias("parsed"))


def _consecutive(rows, group):
    """Calls beside those of the day before."""
    order = W.partitionBy(*group).orderBy("day")
    return _calls(rows, group).withColumns({"old_name": F.lag("name").over(order), "old": F.lag("args").over(order)}).filter("old is not null")


def _drift(rows, group):
    """Type and subtype of the drift between a group's consecutive days."""
    both = _consecutive(rows, group)
    kind = drift_type(F.col("parsed"), F.col("old_name"), F.col("name"), F.col("old"), F.col("args"))
    sub = F.when(kind == "parameter_drift", subtype(F.col("old"), F.col("args"))).otherwise("")
    return both.select(*group, "day", kind.alias("drift"), sub.alias("subtype"))


def _drift_sql(name: str, where: str) -> str:
    return f"""{name}_k AS (SELECT user_id, ts::DATE AS day, event_type, count(*) AS n, count(*) FILTER (value > 60) AS heavy FROM events WHERE {where} GROUP BY 1, 2, 3),
{name}_d AS (SELECT user_id, day, first(event_type ORDER BY n DESC, event_type) AS name, coalesce(list({{'k': event_type, 'v': heavy}}) FILTER (heavy > 0), []) AS args, sum(n) % 7 <> 0 AS parsed FROM {name}_k GROUP BY 1, 2),
{name}_l AS (SELECT *, lag(args) OVER w AS old, lag(name) OVER w AS old_name FROM {name}_d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
{name}_s AS (SELECT *, concat_ws('+', CASE WHEN len(list_filter(old, lambda x: NOT list_contains(list_transform(args, lambda y: y.k), x.k))) > 0 THEN 'drop' END,
  CASE WHEN len(list_filter(args, lambda x: NOT list_contains(list_transform(old, lambda y: y.k), x.k))) > 0 THEN 'add' END,
  CASE WHEN len(list_filter(old, lambda x: list_contains(list_transform(args, lambda y: y.k), x.k) AND NOT list_contains(args, x))) > 0 THEN 'value' END) AS kinds FROM {name}_l WHERE old IS NOT NULL),
{name} AS (SELECT user_id, day, CASE WHEN NOT parsed THEN 'format_drift' WHEN name <> old_name THEN 'function_flip' WHEN kinds <> '' THEN 'parameter_drift' ELSE 'none' END AS drift,
  CASE WHEN parsed AND name = old_name THEN kinds ELSE '' END AS subtype FROM {name}_s)"""


_ALL = _drift_sql("c", "true")


@query(f"WITH {_ALL} SELECT drift, subtype, count(*) AS n FROM c GROUP BY drift, subtype")
def drift_class(t):
    return _drift(t.events, ["user_id"]).groupBy("drift", "subtype").agg(F.count("*").alias("n"))


@query(f"""
WITH {_ALL}, n AS (
  SELECT name, param, count(*) AS n_dropped FROM (
    SELECT name, unnest(list_filter(list_transform(old, lambda x: x.k), lambda k: NOT list_contains(list_transform(args, lambda y: y.k), k))) AS param
    FROM c_s WHERE parsed AND name = old_name) GROUP BY 1, 2)
SELECT n.name, n.param, any_value(n_dropped) AS n_dropped, count(*) AS n_rows, count(*) FILTER (list_contains(list_transform(args, lambda y: y.k), n.param)) AS n_present
FROM n JOIN c_d ON c_d.name = n.name GROUP BY n.name, n.param""")
def dropped_support(t):
    """Dropped (function, parameter) pairs, the rows of the same function, and those that have the parameter."""
    both = _consecutive(t.events, ["user_id"]).filter("parsed and name = old_name")
    dropped = both.select("name", F.explode(F.array_except(F.map_keys("old"), F.map_keys("args"))).alias("param"))
    dropped = dropped.groupBy("name", "param").agg(F.count("*").alias("n_dropped"))
    core = _calls(t.events, ["user_id"])
    rows = core.groupBy("name").agg(F.count("*").alias("n_rows"))
    present = core.select("name", F.explode(F.map_keys("args")).alias("param")).groupBy("name", "param").agg(F.count("*").alias("n_present"))
    joined = dropped.join(rows, "name").join(present, ["name", "param"], "left")
    return joined.withColumn("n_present", F.coalesce("n_present", F.lit(0)))


_LEFT, _RIGHT = _drift_sql("c", "event_id % 2 = 0"), _drift_sql("v", "event_id % 2 = 1")


@query(f"WITH {_LEFT}, {_RIGHT} SELECT c.drift AS left_drift, v.drift AS right_drift, count(*) AS n, count(*) FILTER (c.subtype = v.subtype) AS n_same FROM c JOIN v ON c.user_id = v.user_id AND c.day = v.day GROUP BY 1, 2")
def drift_pairs(t):
    """Drift types of two runs of the same users and days, and how often their subtypes agree."""
    of = lambda side, name: _drift(t.events.filter(F.col("event_id") % 2 == side), ["user_id"]).withColumnsRenamed({"drift": f"{name}_drift", "subtype": f"{name}_subtype"})
    both = of(0, "left").join(of(1, "right"), ["user_id", "day"])
    return both.groupBy("left_drift", "right_drift").agg(F.count("*").alias("n"), F.count_if(F.col("left_subtype") == F.col("right_subtype")).alias("n_same"))


@query("""
WITH u AS (SELECT user_id, round(avg((event_type = 'error')::INT), 4) / 10 AS forget, round(avg((value > 40)::INT), 4) AS kept FROM events GROUP BY user_id)
SELECT CASE WHEN forget > 0.02 THEN 'failure' WHEN kept >= 0.4 THEN 'success' ELSE 'partial' END AS exit, CASE WHEN kept >= 0.6 THEN 'strong' WHEN kept >= 0.4 THEN 'usable' ELSE 'retry' END AS band, count(*) AS n
FROM u GROUP BY 1, 2""")
def exit_criteria(t):
    """Points by exit criterion and retention band."""
    share = lambda test: F.round(F.avg(test.cast("int")), 4)
    rows = t.events.groupBy("user_id").agg((share(F.col("event_type") == "error") / 10).alias("forget"), share(F.col("value") > 40).alias("kept"))
    return rows.groupBy(exit_label(F.col("forget"), F.col("kept")).alias("exit"), retention_band(F.col("kept")).alias("band")).agg(F.count("*").alias("n"))


DAYS = """d AS (SELECT user_id, max((ts::DATE = DATE '2024-01-05' AND value > 60)::INT) AS a, max((ts::DATE = DATE '2024-01-06' AND value > 60)::INT) AS b
  FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' GROUP BY user_id)"""


def _days(t):
    rows = t.events.filter("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
    on = lambda day: F.max(((F.to_date("ts") == F.lit(day).cast("date")) & (F.col("value") > 60)).cast("int"))
    return rows.groupBy("user_id").agg(on("2024-01-05").alias("a"), on("2024-01-06").alias("b"))


@query(f"WITH {DAYS} SELECT CASE WHEN a = 1 AND b = 1 THEN 'kept' WHEN a = 1 THEN 'lost' WHEN b = 1 THEN 'gained' ELSE 'neither' END AS change, count(*) AS n FROM d GROUP BY 1")
def turnover(t):
    change = F.when((F.col("a") == 1) & (F.col("b") == 1), "kept").when(F.col("a") == 1, "lost").when(F.col("b") == 1, "gained").otherwise("neither")
    return _days(t).groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query(f"""
WITH {DAYS}, k AS (SELECT user_id, CASE WHEN a = 1 THEN 'ep1' WHEN b = 1 THEN 'ep2' ELSE 'never' END AS dose FROM d)
SELECT dose, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM k JOIN events USING (user_id) GROUP BY dose""")
def dose_order(t):
    dose = F.when(F.col("a") == 1, "ep1").when(F.col("b") == 1, "ep2").otherwise("never")
    return _days(t).select("user_id", dose.alias("dose")).join(t.events.select("user_id", "value"), "user_id").transform(score_summary, ["dose"], "value")


DAILY = """d AS (SELECT ts::DATE AS day, avg((event_type = 'purchase')::INT) AS repair, avg((event_type = 'error')::INT) AS forget FROM events GROUP BY 1)"""


def _daily(t):
    share = lambda arm: F.avg((F.col("event_type") == arm).cast("int"))
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(share("purchase").alias("repair"), share("error").alias("forget"))


@query(f"""
WITH {DAILY} SELECT day::VARCHAR AS day, round((repair - lag(repair) OVER (ORDER BY day)) / nullif(forget - lag(forget) OVER (ORDER BY day), 0), 4) AS exchange FROM d""")
def dose_exchange(t):
    order = W.orderBy("day")  # one row a day
    delta = lambda c: F.col(c) - F.lag(c).over(order)
    return _daily(t).select(F.col("day").cast("string").alias("day"), F.round(F.try_divide(delta("repair"), F.nullif(delta("forget"), F.lit(0.0))), 4).alias("exchange"))


@query("""
SELECT event_type, value > 8 AS heavy, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high
FROM events GROUP BY 1, 2""")
def transfer_contrast(t):
    return score_summary(t.events.withColumn("heavy", F.col("value") > 8), ["event_type", "heavy"], "value")


@query("""
WITH m AS (SELECT event_type, value - avg(value) OVER (PARTITION BY user_id) AS margin FROM events)
SELECT event_type, count(margin) AS n, round(avg(margin), 6) AS mean, round(median(margin), 6) AS median, round(min(margin), 6) AS low, round(max(margin), 6) AS high FROM m GROUP BY event_type""")
def margin_summary(t):
    means = t.events.groupBy("user_id").agg(F.avg("value").alias("own"))
    rows = t.events.join(means, "user_id").select("event_type", (F.col("value") - F.col("own")).alias("margin"))
    return score_summary(rows, ["event_type"], "margin").withColumns({"low": r6(F.col("low")), "high": r6(F.col("high"))})


@query("""
WITH u AS (SELECT user_id, bool_or(event_type = 'error' AND value > 150) AS a, bool_or(event_type = 'view' AND value > 150) AS b FROM events GROUP BY user_id)
SELECT user_id, a AND b AS in_both, a OR b AS in_any FROM u WHERE a OR b""")
def fragile_sets(t):
    fails = lambda arm: F.bool_or((F.col("event_type") == arm) & (F.col("value") > 150))
    rows = t.events.groupBy("user_id").agg(fails("error").alias("a"), fails("view").alias("b"))
    return rows.select("user_id", (F.col("a") & F.col("b")).alias("in_both"), (F.col("a") | F.col("b")).alias("in_any")).filter("in_any")


@query("""
WITH u AS (SELECT user_id % 10 AS config, count(*) FILTER (event_type = 'click' AND value > 50) AS a, count(*) FILTER (event_type = 'view' AND value > 50) AS b FROM events GROUP BY 1)
SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses FROM u""")
def win_tally(t):
    n = lambda arm: F.count_if((F.col("event_type") == arm) & (F.col("value") > 50))
    rows = t.events.groupBy(F.col("user_id") % 10).agg(n("click").alias("a"), n("view").alias("b"))
    sign = F.signum(F.col("a") - F.col("b"))
    return rows.agg(F.count_if(sign > 0).alias("wins"), F.count_if(sign == 0).alias("ties"), F.count_if(sign < 0).alias("losses"))


POINTS = "p AS (SELECT user_id, round(avg(value), 4) AS repair, round(avg((event_type = 'error')::INT), 4) AS forget FROM events GROUP BY user_id)"


def _points(t):
    return t.events.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("repair"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 4).alias("forget"))


@query(f"""
WITH {POINTS} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE (q.repair > p.repair AND q.forget <= p.forget) OR (q.repair >= p.repair AND q.forget < p.forget))""")
def pareto_frontier(t):
    return skyline(_points(t), ["repair"], ["forget"])


@query("""
WITH p AS (SELECT user_id, round(avg(value), 4) AS repair, round(avg((event_type = 'error')::INT), 4) AS forget, count(DISTINCT props) AS cost FROM events GROUP BY user_id)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.repair >= p.repair AND q.forget <= p.forget AND q.cost <= p.cost AND (q.repair > p.repair OR q.forget < p.forget OR q.cost < p.cost))""")
def skyline_three(t):
    """The frontier of three measures: repair, forgetting and cost."""
    costs = t.events.groupBy("user_id").agg(F.countDistinct("props").alias("cost"))
    return skyline(_points(t).join(costs, "user_id"), ["repair"], ["forget", "cost"])


@query(f"WITH {POINTS} SELECT user_id, repair, forget FROM p ORDER BY (forget <= 0.1) DESC, repair DESC, user_id LIMIT 1")
def select_point(t):
    """The best point within the constraint, else the best of all (the procedure asks for one)."""
    return _points(t).orderBy((F.col("forget") <= 0.1).desc(), F.desc("repair"), "user_id").limit(1).select("user_id", "repair", "forget")


@query("""
WITH d AS (SELECT ts::DATE AS day, avg(value) AS mean, 1.96 * stddev_samp(value) / sqrt(count(*)) AS half FROM events GROUP BY 1),
l AS (SELECT day, mean, half, lag(mean) OVER (ORDER BY day) AS old, lag(half) OVER (ORDER BY day) AS old_half FROM d)
SELECT day::VARCHAR AS day, CASE WHEN mean - half > old + old_half THEN 'compound' WHEN mean + half < old - old_half THEN 'collapse' ELSE 'convergence' END AS dynamics FROM l WHERE old IS NOT NULL""")
def dynamics_class(t):
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"), half.alias("half"))
    order = W.orderBy("day")  # one row a day
    rows = days.withColumns({"old": F.lag("mean").over(order), "old_half": F.lag("half").over(order)}).filter("old is not null")
    label = (
        F.when(F.col("mean") - F.col("half") > F.col("old") + F.col("old_half"), "compound")
        .when(F.col("mean") + F.col("half") < F.col("old") - F.col("old_half"), "collapse")
        .otherwise("convergence")
    )
    return rows.select(F.col("day").cast("string").alias("day"), label.alias("dynamics"))


DRAWS = 10_000


@query(f"""
WITH p AS (SELECT quality - toxic AS d, row_number() OVER (ORDER BY quality - toxic) - 1 AS i, count(*) OVER () AS n FROM labels),
a AS (SELECT b, i, n, ((b + 1) * 48271) % 2147483647 AS s FROM (SELECT i, n FROM p), (SELECT unnest(range(0, {DRAWS})) AS b)),
c AS (SELECT b, i, n, s, (s + i * 7919) % 2147483647 AS x FROM a),
e AS (SELECT b, n, (((x * x) % 2147483647) * 48271 + s) % 2147483647 AS y FROM c),
g AS (SELECT b, n, ((y * y) % 2147483647) % n AS pick FROM e),
r AS (SELECT b, sum(p.d) / any_value(g.n) AS mean FROM g JOIN p ON p.i = g.pick GROUP BY b)
SELECT count(*) AS n_resamples, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high,
  quantile_cont(mean, 0.025) > 0 OR quantile_cont(mean, 0.975) < 0 AS significant FROM r""")
def paired_bootstrap(t):
    """Mean paired difference over 10,000 resamples, its 95 % interval, and whether that leaves out zero."""
    means = bootstrap_means(t.labels.select((F.col("quality") - F.col("toxic")).alias("d")), "d", DRAWS)
    low, high = F.percentile("mean", 0.025), F.percentile("mean", 0.975)
    return means.agg(F.count("*").alias("n_resamples"), r6(F.avg("mean")).alias("mean"), r6(low).alias("low"), r6(high).alias("high"), ((low > 0) | (high < 0)).alias("significant"))


@query("""
WITH u AS (SELECT user_id, count(DISTINCT (props->>'k')::INT) AS n_k, avg(((props->>'k')::INT >= 50)::INT) AS share FROM events GROUP BY user_id)
SELECT round(avg(n_k), 6) AS mean_args, round(avg(share), 6) AS optional_share FROM u""")
def arg_density(t):
    users = t.events.withColumn("k", arg_k()).groupBy("user_id").agg(F.countDistinct("k").alias("n_k"), F.avg((F.col("k") >= 50).cast("int")).alias("share"))
    return users.agg(r6(F.avg("n_k")).alias("mean_args"), r6(F.avg("share")).alias("optional_share"))
