"""Entries from files: a JSON array of entries in a file, by their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import TRAIL, ddl


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """What an entry doesn't have is null; damaged files fail."""
    columns = ", ".join(f"`{name}` {ddl(spec)}" for name, spec in TRAIL.fields.items())
    return spark.read.schema(columns).option("multiLine", True).option("mode", "FAILFAST").json(path)
