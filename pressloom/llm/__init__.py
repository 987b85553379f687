"""Corpus operators for training-data pipelines and their registered queries."""

from __future__ import annotations

from pressloom.llm import registry


def queries() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return registry.queries()


def oracle_sql() -> dict:
    """Query name -> DuckDB SQL, where SQL can express the operator."""
    return registry.oracle_sql()
