"""Spark-first analytics over evaluation records and training corpora."""
