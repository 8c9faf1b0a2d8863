"""Queries of problem 8: sentence units of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept
from ..sources.tables import load
from . import sentences


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.split(load(spark, root, "documents"))


def p8_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Learned abbreviations, starters and collocations by language."""
    return sentences.learn(kept(sentences.count_types(load(spark, root, "documents"))))


def p8_units_by_language(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents")
    found = sentences.split(docs.select(F.struct("doc_id", "lang").alias("doc"), "lang", "text"), key="doc")
    return found.groupBy(sentences.language(F.col("doc.lang")).alias("language")).agg(
        F.count("*").alias("n_units"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_chars")
    )


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics, "p8_units_by_language": p8_units_by_language}
ORACLES: dict[str, str] = {}
