"""Queries of problem 1: classes, methods and args as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..sources.shared import scratch
from ..sources.tables import load

PLACE = ["origin", "record_id", "class_pos", "method_pos", "arg_pos"]


def emitted(spark: SparkSession, root: str) -> DataFrame:
    typed = nested.emit_typed(load(spark, root, "documentation"), "record_id")
    return typed.unionByName(nested.emit_payloads(load(spark, root, "doc_responses"), "response_id"))


#: Where the tables of an application and a data folder have been written.
_WRITTEN: dict[tuple[str, str], str] = {}


def tables(spark: SparkSession, root: str, anew: bool = False) -> str:
    """The folder of the tables of ``root``: written by one walk of all records when first asked for, or ``anew``."""
    key = (spark.sparkContext.applicationId, root)
    if anew or key not in _WRITTEN:
        place = scratch(spark, "nested")
        nested.write_tables(emitted(spark, root), place)
        _WRITTEN[key] = place
    return _WRITTEN[key]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Places of all rows; walks and writes the records whenever it is asked."""
    return nested.read_rows(spark, tables(spark, root, anew=True)).select(*PLACE)


def _documentation(spark: SparkSession, root: str) -> DataFrame:
    return nested.read_rows(spark, tables(spark, root)).where("origin = 'documentation'")


def p1_documentation(spark: SparkSession, root: str) -> DataFrame:
    return _documentation(spark, root).select(*PLACE)


def _table(tag: str, origin: str | None = None):
    def query(spark: SparkSession, root: str) -> DataFrame:
        rows = nested.read_table(spark, tables(spark, root), tag)
        return rows if origin is None else rows.where(F.col("origin") == origin)

    return query


def p1_children(spark: SparkSession, root: str) -> DataFrame:
    """Rows, and rows without their parent (always 0), by table and origin."""
    rows = nested.read_rows(spark, tables(spark, root)).select("tag", "origin", "pk", "parent_pk")
    parents = rows.where("tag <> 'arg'").select(F.col("pk").alias("up"))
    linked = rows.join(parents, rows.parent_pk == F.col("up"), "left")
    orphan = (F.col("tag") != "class") & F.col("up").isNull()
    return linked.groupBy("tag", "origin").agg(F.count("*").alias("n"), F.sum(orphan.cast("bigint")).alias("orphans"))


QUERIES = {
    "p1_found": p1_found,
    "p1_documentation": p1_documentation,
    "p1_classes": _table("class"),
    "p1_methods": _table("method"),
    "p1_args": _table("arg"),
    "p1_documentation_classes": _table("class", "documentation"),
    "p1_documentation_methods": _table("method", "documentation"),
    "p1_documentation_args": _table("arg", "documentation"),
    "p1_children": p1_children,
}

_WALK = """
        WITH d AS (SELECT DISTINCT record_id, classes FROM documentation),
        c AS (SELECT record_id, i AS class_pos, classes[i + 1] AS cls FROM d, LATERAL (SELECT unnest(range(len(classes))) AS i)),
        m AS (SELECT record_id, class_pos, i AS method_pos, cls.methods[i + 1] AS method
              FROM c, LATERAL (SELECT unnest(range(len(cls.methods))) AS i) WHERE cls IS NOT NULL),
        a AS (SELECT record_id, class_pos, method_pos, i AS arg_pos, method.args[i + 1] AS arg
              FROM m, LATERAL (SELECT unnest(range(len(method.args))) AS i) WHERE method IS NOT NULL)
"""
ORACLES = {
    "p1_documentation": f"""{_WALK}
        SELECT 'documentation' AS origin, record_id, class_pos::INT AS class_pos, -1 AS method_pos, -1 AS arg_pos FROM c WHERE cls IS NOT NULL
        UNION ALL SELECT 'documentation', record_id, class_pos::INT, method_pos::INT, -1 FROM m WHERE method IS NOT NULL
        UNION ALL SELECT 'documentation', record_id, class_pos::INT, method_pos::INT, arg_pos::INT FROM a WHERE arg IS NOT NULL
    """,
    "p1_documentation_classes": f"""{_WALK}
        SELECT 'documentation:' || record_id || '/' || class_pos AS pk, 'documentation:' || record_id AS parent_pk, 'documentation' AS origin, record_id, class_pos::INT AS class_pos,
            cls.name AS name, cls.docstring AS docstring, cls.decorators AS decorators, cls.superclass AS superclass, cls.file_path AS file_path, cls.line_number::INT AS line_number
        FROM c WHERE cls IS NOT NULL
    """,
    "p1_documentation_methods": f"""{_WALK}
        SELECT 'documentation:' || record_id || '/' || class_pos || '/' || method_pos AS pk, 'documentation:' || record_id || '/' || class_pos AS parent_pk, 'documentation' AS origin, record_id,
            class_pos::INT AS class_pos, method_pos::INT AS method_pos, method.name AS name, method.docstring AS docstring, method.async AS async, method.complexity AS complexity, method.type AS type, method.decorators AS decorators
        FROM m WHERE method IS NOT NULL
    """,
    "p1_documentation_args": f"""{_WALK}
        SELECT 'documentation:' || record_id || '/' || class_pos || '/' || method_pos || '/' || arg_pos AS pk, 'documentation:' || record_id || '/' || class_pos || '/' || method_pos AS parent_pk, 'documentation' AS origin, record_id,
            class_pos::INT AS class_pos, method_pos::INT AS method_pos, arg_pos::INT AS arg_pos, trim(regexp_extract(arg, '^([^:=]*)', 1)) AS name,
            nullif(trim(regexp_extract(arg, '^[^:=]*:([^=]*)', 1)), '') AS type, nullif(trim(regexp_extract(arg, '=(.*)$', 1)), '') AS "default"
        FROM a WHERE arg IS NOT NULL
    """,
}
