"""Frontiers of two or more measures: the points that no other point beats.

A point beats another if it is as good in every measure and better in one.
Every partition keeps its own frontier, batch by batch, and the survivors meet
in rounds: dealt anew by ranges of another measure each round, so that points
meet those that may beat them, as long as a round still thins them. What is
left is compared in full: each point with all others, broadcast while they are
few, else in blocks, so that no task holds them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspan.shared import cut

#: Candidates up to which all of them go to every task; points of a block beyond it.
FEW, BLOCK = 100_000, 20_000


def beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points (rows, more is better) some row of ``by`` beats."""
    gone = np.zeros(len(points), bool)
    for k in range(0, len(by), 256):
        left = np.flatnonzero(~gone)
        if not len(left):
            break
        some, own = by[k : k + 256, None, :], points[left][None, :, :]
        gone[left] = ((some >= own).all(2) & (some > own).any(2)).any(0)
    return gone


def frontier(points: np.ndarray) -> np.ndarray:
    """The rows that no other row beats; the best in sum come first, so most rows meet few others."""
    points = points[np.argsort(-points.sum(1), kind="stable")]
    kept = points[:0]
    for k in range(0, len(points), 512):
        some = points[k : k + 512]
        some = some[~beaten(some, kept)]
        kept = np.concatenate([kept, some[~beaten(some, some)]])  # a later row has no greater sum, so it beats none of those kept
    return kept


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)


def _batch(points: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(points[:, i])) for i in range(points.shape[1])], names=names)


def _local(points: DataFrame, names: list[str]) -> DataFrame:
    def run(batches):
        kept = None
        for batch in batches:
            found = _matrix(batch)
            kept = frontier(found if kept is None else np.concatenate([kept, found]))
        if kept is not None:
            yield _batch(kept, names)

    return points.mapInArrow(run, points.schema)


def _against_all(points: DataFrame, names: list[str], n: int) -> DataFrame:
    """Points that none of all ``n`` beats."""
    if n <= FEW:
        rivals = frontier(np.array(points.collect(), float).reshape(-1, len(names)))  # at most FEW rows
        held = points.sparkSession.sparkContext.broadcast(rivals)

        def run(batches):
            for batch in batches:
                own = _matrix(batch)
                yield _batch(own[~beaten(own, held.value)], names)

        return points.mapInArrow(run, points.schema)
    blocks = -(-n // BLOCK)
    own = points.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")).withColumn("rival", F.lit(0))
    all_blocks = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("rival", F.lit(1))
    met = own.unionByName(all_blocks).repartition(blocks, "block").sortWithinPartitions("block", "rival")

    def pairs(batches):
        block, held = None, []

        def done():
            found = np.concatenate(held) if held else np.zeros((0, len(names)))
            return _batch(found, names)

        for batch in batches:
            table = _matrix(batch)
            for number in np.unique(table[:, -2]):
                part = table[table[:, -2] == number]
                if number != block:
                    if block is not None:
                        yield done()
                    block, held = number, []
                held += [part[part[:, -1] == 0][:, :-2]]
                rivals = part[part[:, -1] == 1][:, :-2]
                if len(rivals):
                    mine = np.concatenate(held)
                    held = [mine[~beaten(mine, rivals)]]
        if block is not None:
            yield done()

    return met.mapInArrow(pairs, points.schema)


def skyline(df: DataFrame, up: list[str] = (), down: list[str] = ()) -> DataFrame:
    """The rows of ``df`` whose measures no other row's beat: higher in ``up``, lower in ``down``.

    Tied rows all stay; a row without one of the measures (null or NaN) is no
    point. Measures are compared as doubles.
    """
    measures = [*up, *down]
    names = [f"m{i}" for i in range(len(measures))]
    value = [(F.col(f"_row.{c}") if c in up else -F.col(f"_row.{c}")).cast("double") for c in measures]
    df = df.alias("_row")
    points = df.select(*(v.alias(n) for v, n in zip(value, names)))
    for n in names:
        points = points.filter(F.col(n).isNotNull() & ~F.isnan(n))
    left = cut(_local(points, names).distinct())
    n, turn = left.count(), 0
    while n > FEW // 10:  # a round by the next measure; stop when it no longer thins
        thinned = cut(_local(left.repartitionByRange(names[turn % len(names)]), names))
        before, n, left, turn = n, thinned.count(), thinned, turn + 1
        if n > 0.9 * before and turn >= len(names):
            break
    best = _against_all(left, names, n)
    on = [v.eqNullSafe(F.col(f"_best.{m}")) for v, m in zip(value, names)]
    return df.join(best.distinct().alias("_best"), on, "left_semi")
