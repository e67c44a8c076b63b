"""Sets of ids: touches, overlaps, leakage and exact covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """inter, only_a, only_b and jaccard of two id sets, in one aggregate."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1)))
    flags = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = flags.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("inter"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"),
    )
    union = F.col("inter") + F.col("only_a") + F.col("only_b")
    return out.withColumn("jaccard", F.round(F.coalesce(F.try_divide("inter", union), F.lit(0.0)), 6))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str, what: str = "sets") -> None:
    """Raise with the count and at most 20 examples if the id sets meet."""
    met = a.select(key).join(b.select(key), key, "left_semi").distinct()
    if n := met.count():
        shown = sorted(r[0] for r in met.orderBy(key).limit(20).collect())
        raise ValueError(f"{what} share {n} ids, for instance {shown}")


def cover_counts(parts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """n_duplicate, n_missing and n_extra of merged shards against the expected ids."""
    seen = parts.groupBy(key).agg(F.count("*").alias("n"))
    joined = seen.join(expected.select(key, F.lit(True).alias("wanted")), key, "full_outer")
    return joined.agg(
        F.count_if(F.col("n") > 1).alias("n_duplicate"),
        F.count_if(F.col("n").isNull()).alias("n_missing"),
        F.count_if(F.col("wanted").isNull()).alias("n_extra"),
    )


def merge_exact(parts: DataFrame, expected: DataFrame, key: str, order: str) -> DataFrame:
    """The shards' rows in the expected order; raises unless they cover it exactly, with counts and at most 20 examples of each fault."""
    found = cover_counts(parts, expected, key).first()
    if any(found):
        seen = parts.groupBy(key).agg(F.count("*").alias("n"))
        some = lambda rows: [r[0] for r in rows.select(key).orderBy(key).limit(20).collect()]
        examples = {
            "duplicate": some(seen.filter("n > 1")),
            "missing": some(expected.join(seen, key, "left_anti")),
            "extra": some(seen.join(expected.select(key), key, "left_anti")),
        }
        raise ValueError(f"shards do not cover the ids: {found.asDict() | examples}")
    return parts.join(expected.select(key, order), key).orderBy(order)


def two_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids of one side alone, with the side."""
    left = a.select(key).join(b.select(key), key, "left_anti").withColumn("direction", F.lit("only_a"))
    return left.union(b.select(key).join(a.select(key), key, "left_anti").withColumn("direction", F.lit("only_b")))


def bijections(pairs: DataFrame, mapping: str, key: str, code: str) -> DataFrame:
    """Per mapping (pairs of key and code) the numbers of keys and codes, and whether it is one to one."""
    counts = pairs.select(mapping, key, code).distinct().groupBy(mapping).agg(F.count("*").alias("_n"), F.countDistinct(key).alias("n_keys"), F.countDistinct(code).alias("n_codes"))
    return counts.select(mapping, "n_keys", "n_codes", ((F.col("n_keys") == F.col("n_codes")) & (F.col("_n") == F.col("n_keys"))).alias("bijective"))


def touch_status(rows: DataFrame, group: str, trained: str, evaluated: str) -> DataFrame:
    """train_touched > eval_touched_only > never_touched, per group."""
    out = rows.groupBy(group).agg(F.bool_or(F.coalesce(trained, F.lit(False))).alias("t"), F.bool_or(F.coalesce(evaluated, F.lit(False))).alias("e"))
    status = F.when(F.col("t"), "train_touched").when(F.col("e"), "eval_touched_only").otherwise("never_touched")
    return out.select(group, status.alias("status"))
