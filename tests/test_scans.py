"""Ranks, running totals and frontiers: whole tables, hot groups, ties and nulls, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomspan.functions.numbers import BUDGET_TIERS, in_budget_tiers
from loomspan.operators import ordering, ranks, skyline, summaries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_scores(values):
    values = [v for v in values if v is not None]
    if not values:
        return (0, None, None, None, None)
    return (len(values), round(statistics.fmean(values), 6), round(statistics.median(values), 6), min(values), max(values))


def test_medians_of_one_group_with_all_rows(spark):
    """One group, all values distinct: counts lie in several ranges, and no window or buffer holds the group."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (20_000, 20_001):
            rows = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
            counted = ranks.Counted(rows, ["g"], "v")
            sizes = [r["count"] for r in counted.placed.groupBy("_part").count().collect()]
            assert len(sizes) > 2 and max(sizes) < n / 2
            assert tuple(summaries.score_summary(rows, ["g"], "v").first()) == ("g", n, (n - 1) / 2, (n - 1) / 2, 0.0, n - 1)
            assert summaries.upper_median(rows, "g", "v").first()["upper_median"] == n // 2
            plan = plan_of(summaries.score_summary(rows, ["g"], "v"))
            assert "percentile" not in plan and "median" not in plan.replace("median#", "")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_medians_against_plain(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([None, rng.randrange(5) / 4, float(rng.randrange(900))])) for _ in range(3_000)]
    data += [("empty", "x", None), ("one", "x", 3.5), ("two", "x", 1.0), ("two", "x", 4.0)] + [("hot", "x", 2.0)] * 2_000
    rows = spark.createDataFrame(data, "g string, h string, v double")
    got = {(r.g, r.h): tuple(r)[2:] for r in summaries.score_summary(rows, ["g", "h"], "v").collect()}
    keys = {(g, h) for g, h, _ in data}
    assert got == {k: plain_scores([v for g, h, v in data if (g, h) == k]) for k in keys}
    upper = {r.g: r.upper_median for r in summaries.upper_median(rows, "g", "v").collect()}
    for g in {g for g, _, _ in data} - {"empty"}:
        own = sorted(v for k, _, v in data if k == g and v is not None)
        assert upper[g] == own[len(own) // 2]
    empty = rows.filter("false")
    assert summaries.score_summary(empty, ["g"], "v").count() == 0


def test_quantiles_against_plain(spark):
    rng = random.Random(5)
    data = [(rng.randrange(3), rng.random()) for _ in range(999)] + [(7, 1.5)]
    found = {r.g: r.quantiles for r in ranks.quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], "v", 0.0, 0.025, 0.5, 1.0).collect()}
    for g, got in found.items():
        own = sorted(v for k, v in data if k == g)
        for s, x in zip((0.0, 0.025, 0.5, 1.0), got):
            at = s * (len(own) - 1)
            low = own[int(at)]
            assert x == pytest.approx(low + (own[min(int(at) + 1, len(own) - 1)] - low) * (at - int(at)))
    near = ranks.at_ranks(spark.createDataFrame(data, "g int, v double"), ["g"], "v", ranks.nearest(0.9)).filter("g = 7").first()
    assert near["values"] == [1.5]


def test_running_totals_over_everything(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([None, rng.randrange(10**12)]), rng.randrange(3)) for i in rng.sample(range(10**6), 4_000)]
    got = ordering.running_totals(spark.createDataFrame(data, "k long, a long, b int").repartition(7), ["k"], ["a", "b"]).collect()
    want, a, b = {}, 0, 0
    for k, x, y in sorted(data):
        a, b = a + (x or 0), b + y
        want[k] = (a, b)
    assert {r.k: (r.a_upto, r.b_upto) for r in got} == want
    assert ordering.running_totals(spark.createDataFrame([], "k long, a long"), ["k"], ["a"]).count() == 0


def test_running_totals_take_no_window_over_everything(spark):
    plan = plan_of(ordering.running_totals(spark.range(1_000).withColumn("a", F.col("id")), ["id"], ["a"]))
    assert "SinglePartition" not in plan


def test_budget_tiers(spark):
    """Reaching a cap is allowed, going over it is not; each of the three caps counts, and what is spent stays spent."""
    calls, ms, tokens = BUDGET_TIERS["small"]
    data = [(1, calls, ms, tokens), (2, 0, 0, 0), (3, 0, 0, 1), (4, 0, 0, 0)]
    over = lambda rows: [r.over_small for r in in_budget_tiers(spark.createDataFrame(rows, "i int, calls int, ms int, tokens int"), ["i"], "calls", "ms", "tokens").orderBy("i").collect()]
    assert over(data) == [False, False, True, True]
    assert over([(1, calls + 1, 0, 0)]) == [True] and over([(1, 0, ms + 1, 0)]) == [True]
    rows = in_budget_tiers(spark.createDataFrame([(1, 1, 25, 20), (2, 2, 80, 40)], "i int, calls int, ms int, tokens int"), ["i"], "calls", "ms", "tokens")
    assert [tuple(r)[4:7] for r in rows.orderBy("i").collect()] == [(1, 25, 20), (3, 105, 60)]
    assert set(BUDGET_TIERS) == {"large", "middle", "small"}


def plain_frontier(rows, up, down):
    def beats(q, p):
        return all(q[i] >= p[i] for i in up) and all(q[i] <= p[i] for i in down) and any(q[i] != p[i] for i in (*up, *down))

    rows = [r for r in rows if None not in r]
    return sorted(p for p in rows if not any(beats(q, p) for q in rows))


@pytest.mark.parametrize("few, block", [(100_000, 20_000), (0, 30)])
def test_skyline_of_three_measures(spark, monkeypatch, few, block):
    monkeypatch.setattr(skyline, "FEW", few)
    monkeypatch.setattr(skyline, "BLOCK", block)
    rng = random.Random(8)
    data = [(rng.randrange(25), rng.randrange(25), rng.randrange(25)) for _ in range(500)]
    data += [(i, 40 - i, 5) for i in range(40)] + [(3, 3, 3), (3, 3, 3), (24, 24, 0), (24, 24, 0), (None, 90, 0), (90, None, 0)]
    rows = spark.createDataFrame(data, "m0 int, b int, c int").repartition(5)
    got = sorted(map(tuple, skyline.skyline(rows, ["m0", "b"], ["c"]).collect()))
    assert got == plain_frontier(data, (0, 1), (2,)) and got.count((24, 24, 0)) == 2
    assert skyline.skyline(rows.filter("false"), ["b"], ["c"]).count() == 0


def test_bootstrap_by_counts(spark, monkeypatch):
    """Means and spread of the resamples are those of the sample; the same whatever the partitions; blocks change nothing but the draws."""
    rng = random.Random(9)
    data = [rng.choice([-1.0, 0.0, 0.0, 1.0, 1.0, 2.5]) for _ in range(4_000)]
    rows = spark.createDataFrame([(v,) for v in data] + [(None,)], "d double")
    mean, std = statistics.fmean(data), statistics.pstdev(data)
    for block in (100_000, 2):
        monkeypatch.setattr(summaries, "BLOCK", block)
        found = {r.replicate: r.mean for r in summaries.bootstrap_by_counts(rows, "d", 600).collect()}
        again = {r.replicate: r.mean for r in summaries.bootstrap_by_counts(rows.repartition(7), "d", 600).collect()}
        assert found == again and set(found) == set(range(600)) and len(set(found.values())) > 300
        assert abs(statistics.fmean(found.values()) - mean) < 5 * std / 4_000**0.5 / 600**0.5
        assert 0.9 < statistics.stdev(found.values()) / (std / 4_000**0.5) < 1.1
    assert summaries.bootstrap_by_counts(rows.filter("false"), "d", 5).count() == 0


def test_bootstrap_of_many_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(summaries, "BLOCK", 3_000)
    means = [r.mean for r in summaries.bootstrap_means(spark.range(12_000).selectExpr("id / 12000 AS d"), "d", 40).collect()]
    assert len(means) == 40 and all(abs(m - 0.5) < 0.02 for m in means) and len(set(means)) == 40
