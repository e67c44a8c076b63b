"""The corpus pipeline over ``documents``: five stages, each judged on its own input.

quality rules -> SimHash near-dedup -> benchmark decontamination -> PII -> BPE.
Every stage's rows are written as Parquet to the folder that the executors
share and read again as the next stage's input, so a lost executor costs one
stage at most.
"""

from __future__ import annotations

from loomspan.llm import bpe, decontam, pii, quality, simhash
from loomspan.llm.common import drop_folder, fresh_folder

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("pii", pii.stage),
    ("bpe", bpe.stage),
]

#: Near-duplicate groups, bootstrapped extraction and BPE are not SQL; tests/llm/test_values.py holds each stage and the whole run against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = f"{fresh_folder(spark, 'pipeline')}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:  # its output stands, so nobody reads the stage's input again
            drop_folder(spark, before)
        before = folder
    return docs
