"""Queries of problem 4: credentials in source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import language_map, load
from . import credentials


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return credentials.find(load(spark, root, "source_files"), language_map(spark, root)).select("file_id", "start_pos", "end_pos")


def p4_places(spark: SparkSession, root: str) -> DataFrame:
    """Every occurrence with its key path, kind, and span in code points and in bytes."""
    return credentials.find(load(spark, root, "source_files"), language_map(spark, root))


def p4_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every file row with its credentials masked, and what was masked."""
    return credentials.redact(load(spark, root, "source_files"), language_map(spark, root))


def p4_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Occurrences and files by kind of find."""
    found = credentials.find(load(spark, root, "source_files"), language_map(spark, root))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


QUERIES = {"p4_found": p4_found, "p4_places": p4_places, "p4_redacted": p4_redacted, "p4_kinds": p4_kinds}
ORACLES: dict[str, str] = {}
