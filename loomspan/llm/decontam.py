"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is a set of five-word shingles; a document leaks it if at
least 0.8 of that set occurs in the document. An item of one to four words is
one shingle of its own length, so it is found inside long documents too.

Items fall into partitions by the size of their sets (powers of two; short
items by their length). Of an item with n shingles the sketch holds the
m = n - ceil(0.8 n) + 1 smallest shingle hashes: a document with 0.8 of the set
misses at most m - 1 shingles, so it must hold a sketch hash, and the search
loses no leak whatever the document's length. Each partition has its own
threshold, the largest sketch hash, and the least document it is open to. A
document probes every partition that is open to it with its hashes below that
partition's threshold; the rest never leave their row. Candidate pairs are
verified on the shingles themselves; where there are too many items to
broadcast, the item's few shingles travel to the document, not the document's
shingles to the item.

Defined results: null, empty and blank texts have no words and match nothing;
repeated items and documents are each reported; rows with a null key are
reported under the null key; with an empty table on either side the result is
empty; extra columns, whatever their names, do not matter. Words are
lower-cased runs of letters and digits, so case and punctuation do not hide a
leak. Texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loomspan.llm.common import content_key, cut, documents, sized, whole_row

SHINGLE = 5
LEAST = 0.8
#: Rows of the sketch table, and of the candidate table, up to which they are broadcast.
BROADCAST_ROWS = 500_000


def plain_words(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def _shingles(words: Column, of, size: int) -> Column:
    """``of(list of word columns)`` at every shingle start of a materialised array; none in shorter texts."""
    n = F.size(words)
    return F.transform(F.slice(words, 1, F.greatest(n - (size - 1), F.lit(0))), lambda x, i: of([x] + [words[i + k] for k in range(1, size)]))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    return _shingles(words, lambda w: F.xxhash64(*w), size)


def shingle_texts(words: Column, size: int = SHINGLE) -> Column:
    return _shingles(words, lambda w: F.concat_ws(" ", *w), size)


def sketches(items: DataFrame, key: str = "item_id", text: str = "text", least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """Columns item, shingles, n, width (words of a shingle), part (the size partition) and sketch (the smallest hashes)."""
    words = items.select(F.col(key).alias("item"), plain_words(F.col(text)).alias("words"))
    words = words.withColumn("width", F.least(F.size("words"), F.lit(size))).filter("width > 0")

    def by_width(make):
        return F.coalesce(*(F.when(F.col("width") == w, make(F.col("words"), w)) for w in range(size, 0, -1)))

    sets = words.select(
        "item", "width", F.array_distinct(by_width(shingle_texts)).alias("shingles"), F.array_sort(F.array_distinct(by_width(shingle_hashes))).alias("hashes")
    )
    part = F.when(F.col("width") < size, F.col("width") - size).otherwise(F.floor(F.log2(F.size("shingles"))).cast("int"))
    count = F.size("hashes") - F.ceil(F.lit(least) * F.size("hashes")).cast("int") + 1
    sketch = F.slice("hashes", 1, F.greatest(count, F.lit(1)))
    return sets.select("item", "shingles", F.size("shingles").alias("n"), "width", part.alias("part"), sketch.alias("sketch"))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    least: float = LEAST,
    size: int = SHINGLE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs (doc, item, n_shingles, n_shared) with n_shared >= least * n_shingles."""
    held = cut(sketches(items, item_key, least=least, size=size))
    # one row per size partition, so its number is at most the bits of an array length and the short widths
    parts = held.groupBy("part", "width").agg(
        F.max(F.element_at("sketch", -1)).alias("top"), F.min("n").alias("least_n"), F.sum(F.size("sketch")).alias("rows"), F.sum("n").alias("shingles")
    ).collect()
    probe = held.select("part", F.explode("sketch").alias("hash"), "item")
    if sum(p["rows"] for p in parts) <= broadcast_rows:
        probe = F.broadcast(probe)
    widths = sorted({p["width"] for p in parts}) or [size]
    rows = docs.select(F.col(doc_key).alias("doc"), "text")
    words = rows.select("doc", plain_words(F.col("text")).alias("words"))
    hashes = words.select("doc", *(shingle_hashes(F.col("words"), w).alias(f"h{w}") for w in widths))
    # a partition is open to a document with enough shingles; a hash above all its open thresholds can't meet a sketch
    is_open = lambda p: F.size(f"h{p['width']}") >= math.ceil(least * p["least_n"])
    top = lambda w: F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.when(is_open(p), F.lit(p["top"])) for p in parts if p["width"] == w))
    low = hashes.select("doc", *(top(w).alias(f"top{w}") for w in widths), *(f"h{w}" for w in widths))
    low = low.select("doc", *(F.size(f"h{w}").alias(f"n{w}") for w in widths), *(F.filter(f"h{w}", _below(f"top{w}")).alias(f"h{w}") for w in widths))
    probes = [
        F.when(F.col(f"n{p['width']}") >= math.ceil(least * p["least_n"]), F.transform(F.filter(f"h{p['width']}", _below(p["top"])), _probe(p["part"])))
        for p in parts
    ]
    none = F.array().cast("array<struct<part:int,hash:long>>")
    asked = low.select("doc", F.explode(F.concat(none, *(F.coalesce(p, none) for p in probes))).alias("p")).select("doc", "p.part", "p.hash")
    candidates = cut(asked.join(probe, ["part", "hash"]).select("doc", "item").distinct())
    few = held.select(F.col("item").alias("_item"), "shingles", "n")
    same_item = F.col("item").eqNullSafe(F.col("_item"))
    small = sum(p["shingles"] for p in parts) <= broadcast_rows
    pairs = candidates.withColumnRenamed("doc", "_doc")
    pairs = sized(pairs, broadcast_rows) if small else pairs.join(few, same_item)
    met = rows.join(pairs, F.col("doc").eqNullSafe(F.col("_doc"))).drop("_doc").withColumn("words", plain_words(F.col("text"))).drop("text")
    met = met.join(F.broadcast(few), same_item) if small else met
    found = F.concat(*(shingle_texts(F.col("words"), w) for w in widths))
    checked = met.select("doc", "item", F.col("n").cast("long").alias("n_shingles"), "shingles", found.alias("found")).select(
        "doc", "item", "n_shingles", F.size(F.array_intersect("shingles", "found")).cast("long").alias("n_shared")
    )
    return checked.filter(F.col("n_shared") >= F.lit(least) * F.col("n_shingles")).distinct()


def _below(top):
    return lambda h: h <= (F.col(top) if isinstance(top, str) else F.lit(top))


def _probe(part: int):
    return lambda h: F.struct(F.lit(part).alias("part"), h.alias("hash"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks(documents(spark, sf_dir), items)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go.

    Each row is judged by its own text: a row stays though another of its key,
    or another without a key, leaks.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(whole_row(docs).alias("row"), content_key().alias("doc"), "text")
    found = sized(cut(leaks(rows.select("doc", "text"), items, "doc").select("doc").distinct()), BROADCAST_ROWS)
    return rows.join(found, "doc", "left_anti").select("row.*")


def _sql_words(table: str, key: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"SELECT {key}, w FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0"


_SHINGLES = "unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' ')))"
OP9_SQL = f"""
WITH b AS (SELECT *, least({SHINGLE}, len(w)) AS k FROM ({_sql_words("benchmark", "item_id")})),
i AS (SELECT DISTINCT item_id, {_SHINGLES} AS s FROM b),
d AS (SELECT DISTINCT doc_id, {_SHINGLES} AS s FROM ({_sql_words("documents", "doc_id")}), (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, any_value(n.n_shingles)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared
FROM d JOIN i ON i.s = d.s JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(n.n_shingles)
"""
