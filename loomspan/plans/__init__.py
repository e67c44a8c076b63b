"""Queries of the evaluation-data operators on the driver's tables."""
