"""Lineage over many sources: sets of ids as bitmaps, a row for each source and bucket.

Ids get dense numbers once; a source's ids in a bucket of 32,768 numbers are
one bitmap of 4 KB. Unions are bitwise, sizes are bit counts, and every other
size follows from sizes of unions, so any number of set questions over any
number of sources is one aggregate over bitmaps, not a join a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.operators.ordering import positions
from loomspan.shared import cut


def numbered(ids: DataFrame, key: str) -> DataFrame:
    """(key, number): dense numbers from 0 in the order of the distinct keys."""
    return cut(positions(ids.select(key).filter(F.col(key).isNotNull()).distinct(), [key], "number").select(key, F.col("number") - 1).toDF(key, "number"))


def bitmaps(touches: DataFrame, numbers: DataFrame, source: str, key: str) -> DataFrame:
    """(source, bucket, bits) of touches (source, key); keys without a number are left out."""
    at = F.col("number") + 1  # the built-in buckets count from 1
    rows = touches.select(F.col(source).alias("source"), key).join(numbers, key)
    return rows.groupBy("source", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def members(bits: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """(source, key): the ids of bitmaps again."""
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = numbers.select(key, F.bitmap_bucket_number(F.col("number") + 1).alias("bucket"), F.bitmap_bit_position(F.col("number") + 1).alias("bit"))
    is_set = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 1
    return bits.join(placed, "bucket").filter(is_set).select("source", key)


class Unions:
    """Names for sets of sources, and the sizes that follow from sizes of their unions."""

    def __init__(self, bits: DataFrame, sets: dict[str, Column]):
        """``sets``: a condition on ``source`` for each name."""
        self.bits, self.sets, self.asked = bits, sets, {}

    def union(self, *names: str) -> Column:
        """The size of the union of named sets."""
        column = "+".join(sorted(names))
        self.asked[column] = names
        return F.col(f"`{column}`")

    def both(self, a: str, b: str) -> Column:
        return self.union(a) + self.union(b) - self.union(a, b)

    def without(self, a: str, *others: str) -> Column:
        """The size of ``a`` less all others."""
        return self.union(a, *others) - self.union(*others)

    def within(self, a: str, b: str, *others: str) -> Column:
        """The size of what ``a`` and ``b`` share, less all others."""
        return self.without(a, *others) + self.without(b, *others) - (self.union(a, b, *others) - self.union(*others))

    def sizes(self, **columns: Column) -> DataFrame:
        """One row of the columns made by the methods above, in one aggregate."""
        def bits_of(names):
            of = self.sets[names[0]]
            for n in names[1:]:
                of = of | self.sets[n]
            return F.bitmap_or_agg(F.when(of, F.col("bits")))

        per_bucket = self.bits.groupBy("bucket").agg(*(F.bitmap_count(bits_of(names)).alias(c) for c, names in self.asked.items()))
        totals = per_bucket.agg(*(F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in self.asked))
        return totals.select(*(v.alias(k) for k, v in columns.items()))


def touch_table(bits: DataFrame, categories: DataFrame, trained: Column, evaluated: Column) -> DataFrame:
    """Per category (bitmaps with ``source`` the category): ids, those trained on, those only evaluated, untouched ones, and the status."""
    touched = bits.groupBy("bucket").agg(F.bitmap_or_agg(F.when(trained, F.col("bits"))).alias("t"), F.bitmap_or_agg(F.when(trained | evaluated, F.col("bits"))).alias("any"))
    none = F.unhex(F.lit("00" * 4096))
    rows = categories.join(touched, "bucket", "left").withColumns({"t": F.coalesce("t", none), "any": F.coalesce("any", none)})
    # a pair of bitmaps is united by the aggregate, as two rows of its cell
    pair = lambda other: F.explode(F.array(F.col("bits"), F.col(other)))
    united = {}
    for name in ("t", "any"):
        united[name] = rows.select("source", "bucket", pair(name).alias("b")).groupBy("source", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("b")).alias(f"or_{name}"))
    sized = rows.select("source", "bucket", F.bitmap_count("bits").alias("own"), F.bitmap_count("t").alias("n_t"), F.bitmap_count("any").alias("n_any"))
    joined = sized.join(united["t"], ["source", "bucket"]).join(united["any"], ["source", "bucket"])
    out = joined.groupBy("source").agg(
        F.sum("own").alias("n_ids"),
        F.sum(F.col("own") + F.col("n_t") - F.col("or_t")).alias("n_trained"),
        F.sum(F.col("own") + F.col("n_any") - F.col("or_any")).alias("n_touched"),
    )
    status = F.when(F.col("n_trained") > 0, "train_touched").when(F.col("n_touched") > 0, "eval_touched_only").otherwise("never_touched")
    return out.select(
        F.col("source").alias("category"), "n_ids", "n_trained", (F.col("n_touched") - F.col("n_trained")).alias("n_eval_only"), (F.col("n_ids") - F.col("n_touched")).alias("n_untouched"), status.alias("status")
    )


def decomposition(bits: DataFrame, total: str, trained: Column, evaluated: str) -> DataFrame:
    """One row: the ids of source ``total``, those trained on, those in source ``evaluated``, both, and what is left."""
    u = Unions(bits, {"total": F.col("source") == total, "trained": trained, "evaluated": F.col("source") == evaluated})
    in_trained, in_evaluated, left = u.both("total", "trained"), u.both("total", "evaluated"), u.without("total", "trained", "evaluated")
    return u.sizes(n_total=u.union("total"), n_trained=in_trained, n_evaluated=in_evaluated, n_both=u.union("total") - left - (u.without("total", "trained") - left) - (u.without("total", "evaluated") - left), n_residual=left)
