"""Samples by hash that are too large for one task."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators import ordering as o


def sha(key):
    return hashlib.sha256(f"7:{key}".encode()).hexdigest()


@pytest.mark.parametrize("k", [8_000, 19_999, 20_000, 30_000])
def test_large_sample(spark, k):
    """The rows of the k least hashes, and no limit in the plan that grows with k."""
    sample = o.sample_by_hash(spark.range(20_000), k, [7, F.col("id")], "id")
    assert sorted(r.id for r in sample.collect()) == sorted(sorted(range(20_000), key=sha)[:k])
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert all(int(n) <= 1_000 for n in re.findall(r"(?:limit=|Limit )(\d+)", plan))


def test_large_sample_of_one_hash(spark):
    """Rows of one hash are told apart by the tie alone."""
    sample = o.sample_by_hash(spark.range(5_000), 3_000, ["same"], "id")
    assert sorted(r.id for r in sample.collect()) == list(range(3_000))
