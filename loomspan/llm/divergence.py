"""Source divergence audit: every source of a language against its peers and against the whole language.

Terms are runs of letters, A-Z lower-cased. A language keeps the terms that
stand in at least ``LEAST_DOCS`` of its documents. A group (language, source)
gives each kept term the share p = 1 + floor(10^9 (count + 5) / (N + 5 V)); all
values are whole numbers. Two groups differ by the sum of |p - q| over the kept
terms; a group's own terms are those it favours most over its language.

Systolic rotation. The kept terms of a language are cut into blocks of about
``BLOCK`` terms by hash, and a group's shares in a block are one compressed
vector: numbers and shares of the terms it has, one default for all others. Per
block the vectors of a language hold a round-robin tournament: in round r the
groups at places i and j meet if i + j = r modulo the (odd) number of places,
and who would meet itself meets the odd one out. Of each meeting one group is
at home: its vector stays in its partition, the peer's comes by, and both
directions are written. Peers come by in the order of their rounds, one at a
time, so a task holds two vectors of a block. ``WAVE`` rounds travel in one
shuffle, so what is on disk does not grow with the number of peers.

Terms are counted in the tasks (sorted runs of numbers, not a row per word)
and meet in one shuffle by (language, term), which also gives the kept terms.
Each task keeps a heap of its best terms per group; heaps are merged.

Defined results: null text, language and source are read as ''; an empty text
still makes its group occur; a language without kept terms has V = 0, its
groups differ by 0 and have no terms; a language with one source has no pairs;
repeated rows count each; ties rank by the item's UTF-8 bytes; texts of any
length are read whole; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspan.llm.common import BATCH_ROWS, cut, documents, map_batches, sized

LEAST_DOCS, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a block, in expectation; rounds that travel in one shuffle.
BLOCK, WAVE = 2_048, 64
#: Words that a task counts before it hands the counts on.
HELD = 2_000_000
#: Groups and blocks up to which their small tables are broadcast.
BROADCAST_ROWS = 200_000

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), a few rows for each term of a task; (lang, source, '', 0, 0) for every group."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def handed(groups, terms, group, term, doc):
        """Counts of the held words as one batch: sorted (group, term) and (group, term, document) numbers."""
        width = max(1, len(terms))
        own, of = np.concatenate(group or [np.zeros(0, np.int64)]), np.concatenate(term or [np.zeros(0, np.int64)])
        key, n = np.unique(own * width + of, return_counts=True)
        seen = np.bincount(np.searchsorted(key, np.concatenate(doc or [np.zeros(0, np.int64)])), minlength=len(key))
        names = pa.array(list(terms), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        alone = np.arange(len(groups))  # a row for the group itself
        at = pa.array(np.concatenate([key // width, alone]))
        texts = pa.concat_arrays([names.take(pa.array(key % width)), pa.array([""] * len(groups), pa.string())])
        zero = np.zeros(len(groups), np.int64)
        columns = [langs.take(at), sources.take(at), texts, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([seen, zero]))]
        made = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        for k in range(0, made.num_rows, 50_000):
            yield made.slice(k, 50_000)

    def run(batches):
        fresh = lambda: (defaultdict(count().__next__), defaultdict(count().__next__), [], [], [])
        groups, terms, group, term, doc = fresh()
        held = 0
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            split = [t.translate(_TERMS).split() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            sizes = [len(words) for words in split]
            of = np.fromiter((terms[w] for words in split for w in words), np.int64, sum(sizes))
            own = np.fromiter((groups[g] for g in names), np.int64, len(sizes))
            group.append(np.repeat(own, sizes))
            term.append(of)
            # distinct (document, term), as pairs (group, term): the width is known when all terms are
            both = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (len(terms) or 1) + of)
            doc.append((own[both // (len(terms) or 1)], both % (len(terms) or 1)))
            held += sum(sizes)
            if held >= HELD:
                yield from handed(groups, terms, group, term, [g * len(terms) + t for g, t in doc])
                groups, terms, group, term, doc = fresh()
                held = 0
        if groups:
            yield from handed(groups, terms, group, term, [g * max(1, len(terms)) + t for g, t in doc])

    return map_batches(rows, run, "lang string, source string, term string, n long, docs long", BATCH_ROWS)


def _share(n, total, kept) -> Column:
    """1 + floor(UNIT (n + ADDED) / (total + ADDED kept)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.greatest(wide(F.col(total) + ADDED * F.col(kept)), wide(F.lit(1)))
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + F.lit(ADDED)), below)


def _packed(rows: DataFrame) -> DataFrame:
    """One compressed vector for each (lang, slot, block) of rows with ``shares``, an array of (number, share)."""

    def run(batches):
        for batch in batches:
            made = []
            for shares in batch.column("shares"):
                number, share = (shares.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(number)
                number = number[order].astype("<i4")
                made.append(zlib.compress(np.diff(number, prepend=0).astype("<i4").tobytes() + share[order].astype("<i8").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["lang", "slot", "block", "vector"])

    return map_batches(rows.select("lang", "slot", "block", "shares"), run, "lang string, slot int, block int, vector binary")


def _unpacked(vector: bytes | None, size: int, default: int) -> np.ndarray:
    dense = np.full(size, default, np.int64)
    if vector:
        raw = zlib.decompress(vector)
        n = len(raw) // 12
        dense[np.cumsum(np.frombuffer(raw, "<i4", n))] = np.frombuffer(raw, "<i8", n, 4 * n)
    return dense


def _best(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, term, value): the best terms per group of each task."""

    def run(batches):
        heaps = defaultdict(list)
        for batch in batches:
            for lang, source, term, value in zip(*(c.to_pylist() for c in batch.columns)):
                heap, entry = heaps[lang, source], _Entry(value, term)
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif heap[0] < entry:
                    heapq.heapreplace(heap, entry)
        found = [(lang, source, e.term, e.value) for (lang, source), heap in heaps.items() for e in heap]
        if found:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["lang", "source", "term", "value"])

    return map_batches(rows.select("lang", "source", "term", "value"), run, "lang string, source string, term string, value long")


class _Entry:
    """A term with its value; the worst one is the least (small value, then late term)."""

    __slots__ = ("value", "term", "key")

    def __init__(self, value: int, term: str):
        self.value, self.term, self.key = value, term, term.encode()

    def __lt__(self, other: _Entry) -> bool:
        return self.value < other.value if self.value != other.value else self.key > other.key


def _tournament(grid: DataFrame, first: int, rounds: int) -> DataFrame:
    """(lang, a, b, value): what the blocks of a wave of rounds say of each meeting, in both directions."""
    ring = F.col("places") - 1 + F.col("places") % 2  # the odd number of places on the ring; an even last one sits beside it
    at = F.col("slot")
    partner = lambda r: F.when(at == ring, F.pmod(r * (ring + 1) / 2, ring).cast("int")).otherwise(
        F.when(F.pmod(2 * at - r, ring) == 0, ring).otherwise(F.pmod(r - at, ring))
    )
    turn = lambda r: F.struct(r.alias("round"), partner(r).cast("int").alias("home"))
    last = F.least(ring - 1, F.lit(first + rounds - 1)).cast("int")
    all_turns = F.when(last >= first, F.transform(F.sequence(F.lit(first), F.greatest(last, F.lit(first))), turn))
    # of two groups the lower place is at home where their sum is odd, else the higher one
    away = lambda t: (t["home"] < F.col("places")) & (t["home"] != at) & ((t["home"] < at) == (F.pmod(t["home"] + at, F.lit(2)) == 1))
    columns = ("round", "peer", "base", "size", "vector")
    guests = grid.withColumn("t", F.explode(F.filter(all_turns, away)))
    guests = guests.select("lang", F.col("t.home").alias("home"), "block", F.col("t.round").alias("round"), at.alias("peer"), *columns[2:])
    hosts = grid.select("lang", at.alias("home"), "block", F.lit(-1).alias("round"), at.alias("peer"), *columns[2:])
    met = hosts.unionByName(guests).repartition("lang", "home", "block").sortWithinPartitions("lang", "home", "block", "round")

    def run(batches):
        own, host, sums = None, None, defaultdict(int)
        for batch in batches:
            for lang, home, block, turn, peer, base, size, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if turn < 0:
                    own, host = (lang, home, block), _unpacked(vector, size, base)
                    continue
                assert own == (lang, home, block)
                apart = int(np.abs(host - _unpacked(vector, size, base)).sum())
                sums[lang, home, peer] += apart
                sums[lang, peer, home] += apart
            found = [(*k, v) for k, v in sums.items()]
            sums.clear()
            if found:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["lang", "a", "b", "value"])

    return map_batches(met, run, "lang string, a int, b int, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """Columns lang, source, part ('pair' or 'term'), item, value and rank."""
    # one shuffle by (lang, term) serves the groups' counts and the language's
    by_term = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    every = by_term.withColumn("lang_n", F.sum("n").over(over)).withColumn("lang_docs", F.sum("docs").over(over))
    kept = cut(every.filter((F.col("term") == "") | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n"))

    terms = kept.filter("term <> ''")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy("source" if not by else "term")) - 1
    once = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.count("*").cast("int").alias("places"))
    langs = langs.join(once.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0)
    langs = langs.withColumn("blocks", F.greatest(F.ceil(F.col("v") / block), F.lit(1)).cast("int"))
    groups = cut(groups.withColumn("slot", number()).join(langs, "lang"))
    groups = groups.withColumn("base", _share(F.lit(0), "total", "v").cast("long"))
    small = sized(groups, BROADCAST_ROWS)

    placed = once.join(sized(groups.select("lang", "blocks").distinct(), BROADCAST_ROWS), "lang")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    placed = cut(placed.select("lang", "term", "block", number("block").alias("number")))
    sizes = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size"))

    shared = terms.join(small.select("lang", "source", "slot", "total", "v", "lang_total"), ["lang", "source"])
    shared = shared.withColumn("p", _share(F.col("n"), "total", "v")).withColumn("q", _share(F.col("lang_n"), "lang_total", "v"))
    favoured = shared.filter("n > 0 AND p > q").withColumn("value", F.col("p") - F.col("q"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    best = _best(favoured, top).withColumn("rank", ranked).filter(F.col("rank") <= top)
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    entries = shared.filter("n > 0").join(placed, ["lang", "term"]).groupBy("lang", "slot", "block").agg(F.collect_list(F.struct("number", "p")).alias("shares"))
    vectors = _packed(entries)
    cells = groups.select("lang", "slot", "places", "base", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    grid = cells.join(sizes, ["lang", "block"], "left").join(vectors, ["lang", "slot", "block"], "left").na.fill(0, ["size"])
    most = groups.agg(F.max("places")).first()[0] or 0
    grid = cut(grid) if most > wave else grid
    met = None
    for first in range(0, max(most - 1 + most % 2, 1), wave):
        now = _tournament(grid, first, wave).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        now = cut(now) if most > wave else now
        met = now if met is None else met.unionByName(now)
    named = small.select("lang", "slot", "source")
    pairs = met.join(named.withColumnRenamed("slot", "a"), ["lang", "a"]).join(named.select("lang", F.col("slot").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    return pairs.unionByName(best)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir, "lang", "source", "text"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS m FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(m)::HUGEINT AS total FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + {ADDED}) // (coalesce(t.total, 0) + {ADDED} * v.v) AS p,
  1 + {UNIT}::HUGEINT * (k.m + {ADDED}) // (v.total + {ADDED} * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= {TOP}
"""
