"""Queries of problem 5: hand-written source and the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import provenance


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return provenance.found(load(spark, root, "documentation_requests"), load(spark, root, "source_files")).select("request_id", "file_id")


def p5_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Every file with its signs and verdict."""
    return provenance.verdicts(provenance.judge_files(load(spark, root, "source_files")))


def p5_asked(spark: SparkSession, root: str) -> DataFrame:
    """Files that requests name and do not skip."""
    return provenance.asked(load(spark, root, "documentation_requests"), load(spark, root, "source_files"))


def p5_reasons(spark: SparkSession, root: str) -> DataFrame:
    return p5_verdicts(spark, root).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_verdicts": p5_verdicts, "p5_asked": p5_asked, "p5_reasons": p5_reasons}

ORACLES = {
    "p5_asked": r"""
        WITH r AS (SELECT DISTINCT request_id, project_id, file_paths, skip_types FROM documentation_requests),
        n AS (SELECT request_id, project_id, [ltrim(lower(trim(t)), '.') FOR t IN coalesce(skip_types, []::VARCHAR[]) IF t IS NOT NULL] AS skip, unnest(file_paths) AS p FROM r),
        c AS (SELECT request_id, project_id, skip, regexp_replace(regexp_replace(regexp_replace(trim(p, E' \t\r\n'), '[\\/]+', '/', 'g'), '^(\./)+', ''), '/+$', '') AS path FROM n WHERE p IS NOT NULL),
        f AS (SELECT DISTINCT file_id, project_id, file_path FROM source_files)
        SELECT DISTINCT request_id, file_id FROM c JOIN f ON c.project_id = f.project_id AND c.path = f.file_path
        WHERE path <> '' AND NOT list_contains(skip, lower(regexp_extract(path, '\.([^./]*)$', 1)))
    """,
}
