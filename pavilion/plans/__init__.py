"""Pipelines, and the queries that run the operators on the given tables."""
