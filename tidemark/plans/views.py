"""Operators for users of SQL: their results as temporary views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import catalogue


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Makes a temporary view of each query, by its name; lazily, so nothing runs until a view is read."""
    chosen = names if names is not None else sorted(catalogue.QUERIES)
    for name in chosen:
        catalogue.QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
    return chosen
