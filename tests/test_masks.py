"""Masked labels against their SQL where single and double precision, or nulls, part ways."""

import duckdb

import __spark_entry__ as driver

# 0.3195, -0.1335, 0.1925 and -0.1475 are below the half in double precision and on it in single precision
VECTORS = [
    [9.0, 9.0, 9.0, 9.0, 0.3195, -0.1335, 0.1925, -0.1475, -0.0004, 0.0005, 2.5005],
    [1.0, 2.0, None, None, None, 0.25, None],
    [1.0, None],
    [],
    None,
]


def test_mask_prefix(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(VECTORS)), "vec_id long, embedding array<float>").coalesce(1)
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = driver.queries()["mask_prefix"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("vec_id", "labels").collect())) == sorted(duck.execute(driver.oracle_sql()["mask_prefix"]).fetchall())
