"""Catalog scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """All columns of a catalog table or view."""
    return spark.table(name).select("*")


def scan_sql(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """A query with named parameters: ``:name`` for values, ``IDENTIFIER(:name)`` for names."""
    return spark.sql(query, args=args or {})
