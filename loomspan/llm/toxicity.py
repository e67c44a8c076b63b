"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashed words, pairs of neighbouring words
and skip-grams (pairs with one word between) of the whole text; words are runs
of letters, lower-cased. The learner keeps z and n per feature (per-coordinate
rates) and has an L1 term, so a feature has weight 0 until its gradients say
otherwise; what is left is a short table of weights that is broadcast.

The learner reads a bounded sample of labelled rows (``SAMPLE`` expected, by
hash of the key, over the whole table), one row at a time in hash order and
``EPOCHS`` times: features are made where the texts lie, and the one learning
task holds its tables and one row. Scoring is a map over all documents with
vectorised hashing; nothing is shuffled.

Defined results: a null, empty or blank text has no features and scores the
learnt base rate; repeated rows are learnt from and scored each; rows with a
null label are not learnt from; a label without its document teaches nothing,
and without any labels every score is 0.5; a null key stays null, is never
held out and teaches nothing; texts of any length are read whole; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomspan.llm.common import BATCH_ROWS, documents, map_batches

#: Hashed features are numbers below 2^BITS.
BITS = 20
#: Labelled rows in the sample, in expectation, and how often each is read.
SAMPLE, EPOCHS = 8_000, 3
#: FTRL-proximal: rate (alpha, beta), L1 and L2 terms.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 1.0
#: Scores from here on are called toxic.
CUT = 0.3

#: ASCII letters in lower case, other ASCII characters as blanks, all else as it is.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _bucket(mixed: np.ndarray) -> np.ndarray:
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, feature) of all words, pairs and skip-grams, repeats included."""
    split = [(t or b"").translate(_LETTERS).split() for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(words) for words in split])
    word = np.fromiter((crc32(w) for words in split for w in words), np.uint64, len(doc))
    docs, found = [doc], [_bucket(word + np.uint64(1))]
    for gap in (1, 2):
        inside = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
        docs.append(doc[inside])
        found.append(_bucket((word[inside] << np.uint64(32)) + word[inside + gap] + np.uint64(gap << 33)))
    return np.concatenate(docs), np.concatenate(found)


class Learner:
    """FTRL-proximal over features present or absent; the base rate is feature 2^BITS, without L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        least = np.where(np.asarray(at) == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= least, 0.0, (np.sign(z) * least - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, present: np.ndarray, label: int) -> None:
        at = np.append(present, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def remainder(key: Column) -> Column:
    """The contract's fold: CRC of the key as text, modulo 4."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """The weights (feature, weight) that are not zero, learnt from labelled rows; at most 2^BITS + 1 rows."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    share = min(1.0, sample / max(1, known.count()))
    few = known.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < round(share * (1 << 30)))
    # the sample's bound holds in expectation and its rows are two numbers
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key").select("key", "label", "text")
    kind = rows.schema["key"].dataType.simpleString()

    def shape(batches):
        for batch in batches:
            doc, found = features(batch.column(2).cast(pa.binary()).to_pylist())
            both = np.unique(doc.astype(np.int64) << BITS | found.astype(np.int64))
            ends = np.searchsorted(both >> BITS, np.arange(batch.num_rows + 1))
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(both & ((1 << BITS) - 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], names=["key", "label", "features"])

    def learn(batches):
        learner = Learner()
        for batch in batches:
            for present, y in zip(batch.column("features"), batch.column("label").to_pylist()):
                learner.learn(present.values.to_numpy(), int(y > 0))
        every = np.arange((1 << BITS) + 1)
        w = learner.weights(every)
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(w[kept])], names=["feature", "weight"])

    shaped = map_batches(rows, shape, f"key {kind}, label int, features array<int>", BATCH_ROWS)
    turns = shaped.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("place", F.xxhash64("key", "turn"))
    ordered = turns.repartition(1).sortWithinPartitions("turn", "place", "key", "label").select("label", "features")
    return map_batches(ordered, learn, "feature int, weight double")


def score(docs: DataFrame, weights: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key and score (0 to 1) of every row."""
    table = np.array([(r["feature"], r["weight"]) for r in weights.collect()]).reshape(-1, 2)  # bounded: 2^BITS + 1 rows
    held = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        dense = np.zeros((1 << BITS) + 1)
        dense[held.value[:, 0].astype(np.int64)] = held.value[:, 1]
        for batch in batches:
            doc, found = features(batch.column(1).cast(pa.binary()).to_pylist())
            found = found.astype(np.int64)
            told = np.flatnonzero(dense[found])
            both = np.unique(doc[told].astype(np.int64) << BITS | found[told])
            sums = np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], batch.num_rows) + dense[1 << BITS]
            made = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["key", "score"])

    return map_batches(rows, run, f"key {kind}, score double", BATCH_ROWS)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(F.col("doc_id")) != 2)
    scored = score(docs, train(docs, labels))
    return scored.select(
        F.col("key").alias("doc_id"),
        F.coalesce(remainder(F.col("key")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
