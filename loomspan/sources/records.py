"""Sources: JSON lines, JSON documents and families of files as DataFrames.

Values of unknown shape are VARIANT; a caller that knows its schema gives it.
Paths go through Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomspan.operators.ordering import split_by_hash


def jsonl(spark: SparkSession, path, schema=None, name_pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """One object a line, blank lines dropped: columns of the schema, or ``record`` as VARIANT."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    lines = reader.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file_name"))
    if schema is not None:
        return lines.select(F.from_json("value", schema).alias("r"), "file_name").select("r.*", "file_name")
    return lines.select(F.parse_json("value").alias("record"), "file_name")


def named_jsonl(spark: SparkSession, path: str, schema=None, name_pattern: str = "*") -> DataFrame:
    """As ``jsonl`` over a folder of ``name=<file name>`` folders, each written by many tasks; the folder's name is the file's."""
    lines = spark.read.option("basePath", path).text(f"{path}/name={name_pattern}").filter(F.trim("value") != "").select("value", F.col("name").alias("file_name"))
    if schema is not None:
        return lines.select(F.from_json("value", schema).alias("r"), "file_name").select("r.*", "file_name")
    return lines.select(F.parse_json("value").alias("record"), "file_name")


def jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An optional source: no file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("file_name", F.lit(""))
    return jsonl(spark, path, schema)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return found is not None and len(found) > 0


def json_document(spark: SparkSession, path, schema=None) -> DataFrame:
    """Whole-file JSON documents, one row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def records_of(spark: SparkSession, path, schema, field: str = "records") -> DataFrame:
    """The exploded records of shard documents, with their file as the source label."""
    docs = json_document(spark, path, schema)
    return docs.select(F.explode(field).alias("r"), F.col("_metadata.file_name").alias("file_name")).select("r.*", "file_name")


def category(file_name: Column | str = "file_name", prefix: str = "[A-Za-z]+_v[0-9]+_") -> Column:
    """The category in a data file's name."""
    return F.regexp_extract(file_name, rf"{prefix}(.*)\.jsonl?$", 1)


def query_text(question: Column) -> Column:
    """The text of a question held as VARIANT: text, messages, or turns of messages (the first turn counts)."""
    kind = F.schema_of_variant(question)
    messages = lambda path: F.array_join(
        F.transform(F.try_variant_get(question, path, "array<variant>"), lambda m: F.coalesce(F.try_variant_get(m, "$.content", "string"), F.lit(""))), "\n"
    )
    nested = kind.startswith("ARRAY<ARRAY")
    return (
        F.when(kind == "STRING", F.try_variant_get(question, "$", "string"))
        .when(nested, messages("$[0]"))
        .when(kind.startswith("ARRAY"), messages("$"))
        .otherwise(F.lit(""))
    )


def episodes(questions: DataFrame, answers: DataFrame, id_field: str = "$.id") -> DataFrame:
    """Questions joined with their answers; a question without an answer is an error.

    Both sides have ``record`` (VARIANT) and ``file_name``.
    """
    left = questions.select(
        F.variant_get("record", id_field, "string").alias("episode_id"),
        query_text(F.try_variant_get("record", "$.question", "variant")).alias("query"),
        F.try_variant_get("record", "$.function", "variant").alias("function_pool"),
        category().alias("category"),
    )
    right = answers.select(
        F.variant_get("record", id_field, "string").alias("episode_id"), F.try_variant_get("record", "$.ground_truth", "variant").alias("ground_truth"), F.lit(True).alias("_found")
    )
    joined = left.join(right, "episode_id", "left")
    checked = F.when(F.col("_found"), F.col("ground_truth")).otherwise(F.raise_error(F.concat(F.lit("no answer for "), "episode_id")).cast("variant"))
    return joined.withColumn("ground_truth", checked).drop("_found")


def without_recorded(rows: DataFrame, recorded: DataFrame, key: str = "episode_id") -> DataFrame:
    """Rows that no earlier output holds."""
    return rows.join(recorded.select(key), key, "left_anti")


def in_order(rows: DataFrame) -> DataFrame:
    """Loaded episodes in their reading order: by category, then id."""
    return rows.orderBy("category", "episode_id")


def failures_of(rows: DataFrame, split: str, seed: int) -> DataFrame:
    """The failed records of a split with their part of the hash split."""
    failed = rows.filter((F.col("split") == split) & (~F.col("call_success")))
    return split_by_hash(failed, "episode_id", seed)


def seed_row(rows: DataFrame, seed: int) -> DataFrame:
    """The rows of one seed; an error if there is none."""
    found = rows.filter(F.col("seed") == seed)
    if found.isEmpty():
        raise ValueError(f"no row for seed {seed}")
    return found
