"""Whole pipelines and the registry of queries."""
