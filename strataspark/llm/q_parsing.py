"""Queries of problem 3: files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import language_map, load
from . import parsing


def _checked(spark: SparkSession, root: str, report: bool = False) -> DataFrame:
    return parsing.check_files(load(spark, root, "source_files"), language_map(spark, root), report)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _checked(spark, root).where(~F.col("parses")).select("file_id").distinct()


def p3_failures(spark: SparkSession, root: str) -> DataFrame:
    """Each invalid file with the furthest position reached and the cause there."""
    return _checked(spark, root, report=True).where(~F.col("parses")).drop("parses").dropDuplicates(["file_id"])


def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    return parsing.rates(_checked(spark, root))


QUERIES = {"p3_found": p3_found, "p3_failures": p3_failures, "p3_rates": p3_rates}
ORACLES: dict[str, str] = {}
