"""Runs of repeated words in a text: Kolpakov and Kucherov's algorithm over words.

A run is a stretch of words with smallest period q, at least ``max(LEAST,
TIMES * q)`` words long, that no neighbouring word extends. Per text:

* a suffix automaton of the word numbers gives the LZ factorisation (a factor
  is the longest prefix of what is left that also starts earlier, or a new
  word) with each factor's earlier occurrence;
* Main's algorithm finds, at every factor border, the leftmost runs that cross
  or touch it: extension lengths to the left and right for every period come
  from two Z-functions over a window of the two factors beside the border. A
  run of three periods cannot reach further back than one period before the
  left factor, or that factor would have been longer;
* every other run lies strictly inside one factor, so it is a copy, and is
  taken over from the factor's earlier occurrence, from left to right.

Before that, whole batches are searched for eight-word windows that occur again
in the same text. In a run of three periods and 24 words every such window
occurs again one period away, so runs lie wholly inside stretches of repeated
windows, and only those stretches are factorised. Windows are compared by 64
bits of hash; two that agree by chance only make a stretch longer.

There is no shuffle: a text is one row, and a task holds one batch of texts and
one automaton. Work is linear in the words, whatever repeats.

Defined results: null, empty and blank texts have no words and no runs; a text
of one word over and over is one run of period 1; texts of any length are read
whole; repeated rows are each reported; a null key stays null; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspan.llm.common import BATCH_ROWS, documents, map_batches, words_of

#: Words of the shortest run, and its least number of periods.
LEAST, TIMES = 24, 3
#: Words of a window that must occur again: at most LEAST - 2 * (LEAST // TIMES).
WINDOW = 8

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def factors(w: list[int]) -> list[tuple[int, int]]:
    """LZ factors as (start, start of an earlier occurrence; -1 for a new word)."""
    # states of the suffix automaton: suffix link, longest length, moves, end of the first occurrence
    link, longest, moves, ends, last = [-1], [0], [{}], [-1], 0
    for i, c in enumerate(w):
        new = len(link)
        link.append(0)
        longest.append(i + 1)
        moves.append({})
        ends.append(i)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            old = moves[at][c]
            if longest[old] > longest[at] + 1:
                part = len(link)
                link.append(link[old])
                longest.append(longest[at] + 1)
                moves.append(dict(moves[old]))
                ends.append(ends[old])
                link[old] = part
                while at >= 0 and moves[at].get(c) == old:
                    moves[at][c] = part
                    at = link[at]
                old = part
            link[new] = old
        last = new
    made, start, j, n = [], 0, 0, len(w)
    while start < n:
        state = 0
        while j < n and ends[to := moves[state][w[j]]] < j:
            state = to
            j += 1
        if j == start:
            made.append((start, -1))
            j += 1
        else:
            made.append((start, ends[state] - (j - start) + 1))
        start = j
    return made


def matches(s: list[int]) -> list[int]:
    """For each place of ``s``, how far the rest agrees with ``s`` itself (the Z-function)."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(w: list[int], a: int, b: int, e: int, found: dict[int, dict[int, int]]) -> None:
    """Add the runs that cross or touch ``b``, between the factors [a, b) and [b, e)."""
    n, most = len(w), (e - a - 1) // 2  # three periods fit only below half of both factors
    lo = max(0, a - most)
    if most < 1 or e - lo < LEAST:
        return
    size = b - lo
    back = matches(w[lo:b][::-1] + [-1] + w[lo:e][::-1])
    ahead = matches(w[b:e] + [-1] + w[lo:e])

    def add(s: int, t: int, p: int) -> None:
        if t - s < max(LEAST, TIMES * p):
            return
        if s == lo and lo and w[lo - 1] == w[lo - 1 + p] or t == e and e < n and w[e] == w[e - p]:
            return  # goes on: found at another border
        ends = found.setdefault(s, {})
        ends[t] = min(p, ends.get(t, p))

    for p in range(1, min(e - b, most) + 1):  # the period stands right of the border
        add(b - back[size + 1 + e - b - p], b + p + (ahead[p] if p < e - b else 0), p)
    for p in range(1, min(size, most) + 1):  # left of it
        add(b - p - (back[p] if p < size else 0), b + ahead[e - b + 1 + size - p], p)


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``w``, by start, then period."""
    if len(w) < LEAST:
        return []
    parts = factors(w)
    borders = [start for start, _ in parts] + [len(w)]
    found: dict[int, dict[int, int]] = {}
    for k in range(1, len(borders)):
        _at_border(w, borders[k - 1], borders[k], borders[min(k + 1, len(borders) - 1)], found)
    for k, (start, earlier) in enumerate(parts):
        end = borders[k + 1]
        if earlier < 0 or not found or end - start < LEAST + 2:
            continue
        by = start - earlier
        for s in range(start + 1, end - LEAST):
            if s - by in found:
                inner = {t + by: p for t, p in found[s - by].items() if t + by < end}
                if inner:
                    found[s] = inner | found.get(s, {})
    return sorted((s, t - s, p) for s, ends in found.items() for t, p in ends.items())


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def stretches(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of maximal stretches covered by windows that occur again in their text, LEAST words or longer."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return []
    mixed, key = _spread(ids.astype(np.uint64) + np.uint64(1)), _spread(doc[:n].astype(np.uint64) + np.uint64(7))
    for k in range(WINDOW):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    inside = doc[:n] == doc[WINDOW - 1 :]
    order = np.argsort(_spread(key)[inside], kind="stable")
    places = np.flatnonzero(inside)[order]
    same = key[places[1:]] == key[places[:-1]]
    again = np.zeros(n, bool)
    again[places[1:][same]] = again[places[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    # a stretch ends with its text, too
    change = np.flatnonzero(np.diff(np.concatenate(([0], np.where(covered, doc + 1, 0), [0]))))
    return [(a, b) for a, b in zip(change[:-1].tolist(), change[1:].tolist()) if covered[a] and b - a >= LEAST]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, runs (all, by start, then period), best (most periods; ties: first start, then period) and kept.

    ``kept`` is the text with every run cut down to its first period, words joined by one space.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    shown = lambda r: dict(zip(("start", "length", "period"), r))

    def work(batches):
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            numbers = defaultdict(count().__next__)
            ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64)
            starts = np.concatenate(([0], np.cumsum([len(words) for words in texts])))
            doc = np.repeat(np.arange(len(texts)), np.diff(starts))
            found = [[] for _ in texts]
            for a, b in stretches(ids, doc):
                k = int(doc[a])
                at = a - int(starts[k])
                found[k] += [(at + s, size, p) for s, size, p in runs(ids[a:b].tolist())]
            best, kept = [], []
            for words, own in zip(texts, found):
                best.append(shown(max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))) if own else None)
                if own:
                    gone = np.zeros(len(words), bool)
                    for s, size, p in own:
                        gone[s + p : s + size] = True
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array([list(map(shown, own)) for own in found], pa.list_(run)), pa.array(best, run), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "runs", "best", "kept"])

    return map_batches(rows, work, f"key {kind}, runs array<{RUN}>, best {RUN}, kept string", BATCH_ROWS)


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: every tenth document, by the CRC of its key, goes on periodically from some word."""
    h, n, g = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("words").cast("long"), F.col("g")
    # a column of its own: the lambda below must not split the text for every word
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("a", F.pmod(g, F.greatest(n, F.lit(1)))).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    moved = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    marked = find(planted(documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return marked.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
