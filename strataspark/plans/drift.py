"""Queries of problem 2: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift
from ..sources.tables import load


def _records(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "structure_records")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return drift.changes(_records(spark, root)).select("stream_id", "file_no", "change_kind", "field", "new_field")


def p2_measures(spark: SparkSession, root: str) -> DataFrame:
    """The consistent table of all measures; fields that no measure is known for are counted."""
    return drift.measures(_records(spark, root)).withColumn("n_other", F.size("other")).drop("other")


def p2_branches(spark: SparkSession, root: str) -> DataFrame:
    return drift.branches(_records(spark, root))


def p2_files(spark: SparkSession, root: str) -> DataFrame:
    return drift.files(_records(spark, root)).withColumn("prev_no", F.col("prev_no")).select("stream_id", "file_no", "prev_no", "next_no")


QUERIES = {"p2_found": p2_found, "p2_measures": p2_measures, "p2_branches": p2_branches, "p2_files": p2_files}

_LEAVES = """
        WITH r AS (SELECT stream_id, file_no, record_id, payload FROM structure_records WHERE stream_id IS NOT NULL AND file_no IS NOT NULL AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY record_id) = 1),
        t AS (SELECT stream_id, file_no, record_id, ltrim(replace(j.fullkey, '"', ''), '$.') AS path, j.type AS kind, j.value AS value
            FROM r, LATERAL (SELECT * FROM json_tree(r.payload)) j WHERE json_type(r.payload) = 'OBJECT' AND j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.path, '[') AND NOT contains(j.fullkey, '[')),
        b AS (SELECT stream_id, file_no, record_id, path, CASE WHEN kind IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN value::DOUBLE END AS number_value, CASE WHEN kind = 'VARCHAR' THEN value->>'$' END AS string_value,
            CASE WHEN kind = 'BOOLEAN' THEN value::BOOLEAN END AS boolean_value, CASE WHEN kind = 'ARRAY' THEN value::VARCHAR END AS array_value,
            CASE WHEN kind IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN value::DOUBLE WHEN kind = 'VARCHAR' THEN TRY_CAST(value->>'$' AS DOUBLE) WHEN kind = 'BOOLEAN' THEN value::BOOLEAN::INT::DOUBLE
                WHEN kind = 'ARRAY' AND json_array_length(value) = 1 AND json_type(value, '$[0]') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN TRY_CAST(value->>'$[0]' AS DOUBLE) END AS canonical FROM t)
"""
_MEASURES = {
    "volume": "'volume', 'vol', 'v'",
    "difficulty": "'difficulty', 'diff', 'd'",
    "effort": "'effort', 'e'",
    "bugs": "'bugs', 'b'",
    "time": "'time', 't'",
    "length": "'length', 'n'",
    "maintainability_index": "'maintainabilityindex', 'maintainability', 'mi'",
    "complexity": "'complexity', 'cyclomaticcomplexity', 'cyclomatic', 'cc'",
    "cognitive_complexity": "'cognitivecomplexity', 'cognitive'",
    "class_count": "'classcount'",
    "function_count": "'functioncount'",
}
_ALL = ", ".join(_MEASURES.values())
_COLUMNS = ", ".join(f"arg_min(canonical, path) FILTER (canonical IS NOT NULL AND name IN ({names})) AS {m}" for m, names in _MEASURES.items())
ORACLES = {
    "p2_found": """
        WITH k AS (SELECT stream_id, file_no, file_path || chr(0) || content_hash AS source, payload FROM structure_records WHERE stream_id IS NOT NULL AND file_no IS NOT NULL),
        t AS (SELECT stream_id, file_no, source, ltrim(replace(j.fullkey, '"', ''), '$.') AS path, CASE WHEN j.type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 1 WHEN j.type = 'VARCHAR' THEN 2 WHEN j.type = 'BOOLEAN' THEN 4 ELSE 8 END AS kind,
            CASE WHEN j.type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN j.value::DOUBLE::VARCHAR ELSE j.value::VARCHAR END AS content
            FROM (SELECT stream_id, file_no, source, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload ELSE '{}' END ELSE '{}' END AS payload FROM k) k, LATERAL (SELECT * FROM json_tree(k.payload)) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.path, '[') AND NOT contains(j.fullkey, '[')),
        f AS (SELECT *, lag(file_no) OVER w AS prev, lead(file_no) OVER w AS next FROM (SELECT DISTINCT stream_id, file_no FROM k) WINDOW w AS (PARTITION BY stream_id ORDER BY file_no)),
        s AS (SELECT stream_id, file_no, path, bit_or(kind) AS kinds, prev, next FROM t JOIN f USING (stream_id, file_no) GROUP BY ALL),
        come AS (SELECT stream_id, file_no, path, prev FROM s WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.stream_id = s.stream_id AND o.path = s.path AND o.file_no = s.prev)),
        gone AS (SELECT stream_id, next AS file_no, path, file_no AS prev FROM s WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.stream_id = s.stream_id AND o.path = s.path AND o.file_no = s.next)),
        v AS (SELECT stream_id, file_no, source, path, min({'k': kind, 'c': content}) AS v FROM t WHERE source IS NOT NULL GROUP BY ALL),
        pairs AS (SELECT g.stream_id, g.file_no, g.path AS old_path, c.path AS new_path, count(*) AS n, (string_split(g.path, '.')[-1] = string_split(c.path, '.')[-1])::INT AS alike
            FROM gone g JOIN come c ON c.stream_id = g.stream_id AND c.file_no = g.file_no JOIN v a ON a.stream_id = g.stream_id AND a.file_no = g.prev AND a.path = g.path
            JOIN v b ON b.stream_id = g.stream_id AND b.file_no = c.file_no AND b.path = c.path AND b.source = a.source GROUP BY ALL HAVING count(*) FILTER (a.v = b.v) = count(*)),
        moved AS (SELECT stream_id, file_no, old_path, new_path FROM pairs QUALIFY row_number() OVER (PARTITION BY stream_id, file_no, old_path ORDER BY n DESC, alike DESC, new_path) = 1
            AND row_number() OVER (PARTITION BY stream_id, file_no, new_path ORDER BY n DESC, alike DESC, old_path) = 1)
        SELECT stream_id, file_no, 'renamed' AS change_kind, old_path AS field, new_path AS new_field FROM moved
        UNION ALL SELECT stream_id, file_no, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.stream_id = g.stream_id AND m.file_no = g.file_no AND m.old_path = g.path)
        UNION ALL SELECT stream_id, file_no, 'added', path, '' FROM come c WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.stream_id = c.stream_id AND m.file_no = c.file_no AND m.new_path = c.path)
        UNION ALL SELECT s.stream_id, s.file_no, 'retyped', s.path, '' FROM s JOIN s o ON o.stream_id = s.stream_id AND o.path = s.path AND o.file_no = s.prev WHERE o.kinds <> s.kinds
    """,
    "p2_branches": f"{_LEAVES} SELECT * FROM b",
    "p2_measures": f"""{_LEAVES},
        n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(path, '[^A-Za-z]', '', 'g')), '^metrics', ''), '^halstead', ''), 'value$', '') AS name FROM b)
        SELECT stream_id, file_no, record_id, {_COLUMNS}, (count(DISTINCT path) FILTER (canonical IS NOT NULL AND name NOT IN ({_ALL})))::INT AS n_other FROM n GROUP BY ALL
    """,
    "p2_files": """
        SELECT stream_id, file_no, lag(file_no) OVER w AS prev_no, lead(file_no) OVER w AS next_no
        FROM (SELECT DISTINCT stream_id, file_no FROM structure_records WHERE stream_id IS NOT NULL AND file_no IS NOT NULL)
        WINDOW w AS (PARTITION BY stream_id ORDER BY file_no)
    """,
}
