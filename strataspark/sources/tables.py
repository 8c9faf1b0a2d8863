"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root``; columns are pruned and filters pushed by the reader."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def language_map(spark: SparkSession, root: str) -> dict[str, str]:
    """The alias table as a dict. It is a fixed dimension (a few dozen rows); more than 10,000 raise."""
    rows = load(spark, root, "language_aliases").select("alias", "language").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("language_aliases is no longer a small dimension")
    return {r.alias.strip().lower(): r.language for r in rows if r.alias is not None}
