import hashlib

import pandas as pd
from pyspark.sql import functions as F

from loomspan.operators import generation as g


def test_requests_and_records(spark):
    rows = g.requests(spark.createDataFrame([("e1",), ("e2",)], "id string"), "id", 7, "base", samples=10, batch=4)
    found = rows.filter("id = 'e1'").orderBy("offset").collect()
    assert [(r.offset, r["size"]) for r in found] == [(0, 4), (4, 4), (8, 2)]
    assert int(found[1].seed) == int(hashlib.sha256(b"7:e1:base:4").hexdigest()[:16], 16)

    def make():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            made = [(r.id, r.offset + i, r.id == "e1" and (r.offset + i) % 5 == 0) for r in batch.itertuples() for i in range(r.size_)]
            return pd.DataFrame(made, columns=["id", "sample_index", "success"])

        return run

    samples = g.generate(rows.withColumnRenamed("size", "size_"), make, "id string, sample_index long, success boolean")
    records = {r.id: r for r in g.pass_records(samples, "id").collect()}
    assert records["e1"].hits == 2 and records["e1"].successful == [0, 5] and records["e2"].hits == 0 and records["e2"].sample_count == 10


def test_rows_without_need_see_no_model(spark):
    def make():
        def run(batch):
            assert (batch.n > 0).all()
            return batch.assign(success=True)

        return run

    rows = spark.createDataFrame([(1, 0), (2, 3), (3, None)], "id long, n long")
    out = g.generate_where(rows, F.col("n") > 0, make, "id long, n long, success boolean", {"success": F.lit(False)})
    assert {r.id: r.success for r in out.collect()} == {1: False, 2: True, 3: False}


def test_partition(spark):
    cases = spark.createDataFrame([(1, False), (2, True), (0, True), (0, False)], "h int, s boolean")
    found = [r[0] for r in cases.select(g.partition_of(F.col("h"), F.col("s"))).collect()]
    assert found == ["sampling_rescuable", "sampling_rescuable", "scaffold_only", "neither"]
