"""Queries of docstrings, similarity, prompts, sinks and the smaller functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docstrings, metrics, similarity
from ..sources import files as trees
from ..sources.shared import scratch
from ..sources.tables import load
from ..streaming import windows
from .metrics import calls, records
from .store import files
from .text import docs


def _docstrings(spark, root):
    return docs(spark, root).where("source = 'docstring'").select("doc_id", "text")


def sf18_sections(spark, root):
    return docstrings.sections(_docstrings(spark, root), "doc_id", "text").groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


def sf19_parameters(spark, root):
    return docstrings.parameters(docstrings.sections(_docstrings(spark, root), "doc_id", "text"), "doc_id")


def va3_parameters(spark, root):
    return docstrings.checked(sf19_parameters(spark, root)).groupBy("type_ok", "description_ok").agg(F.count("*").alias("n"))


def sf12_nearest(spark, root):
    e = load(spark, root, "embeddings")
    return similarity.nearest(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), 5).select("query_id", "rank", "score")


def sf13_retry_delays(spark, root):
    """Delay before each failed call of a project is tried again, without jitter: doubled up to a minute, half more for rate limits."""
    failed = calls(spark, root).where("not coalesce(success, false) and project_id is not null")
    attempt = F.col("seq") % 8
    delay = F.least(F.pow(F.lit(2.0), attempt), F.lit(60.0)) * F.when(F.lower("error_type").contains("rate"), 1.5).otherwise(1.0)
    return failed.select("seq", F.least(F.greatest(delay, F.lit(0.1)), F.lit(60.0)).alias("delay"))


def fl15_retryable(spark, root):
    kind = F.coalesce(F.lower("error_type").rlike("network|timeout"), F.lit(False))
    return calls(spark, root).where("not coalesce(success, false)").groupBy("error_type").agg(F.max(kind).alias("retryable"), F.count("*").alias("n"))


def pj6_nested_path(spark, root):
    """The first name at a nested path, of whichever wrapping; empty where there is none."""
    r = load(spark, root, "doc_responses").dropDuplicates(["response_id"]).select("response_id", F.try_parse_json("payload").alias("v"))
    at = [F.try_variant_get("v", path, "string") for path in ("$.data.classes[0].name", "$.classes[0].name")]
    return r.select("response_id", F.coalesce(*at, F.lit("")).alias("name"))


def pj7_prompts(spark, root):
    """Messages of a prompt; parts without content are left out."""
    part = F.struct

    def message(role, content):
        return F.when(content.isNotNull() & (F.trim(content) != ""), part(F.lit(role).alias("role"), content.alias("content")))

    messages = F.filter(F.array(message("system", F.col("project_id")), message("context", F.col("provider")), message("user", F.col("text"))), lambda m: m.isNotNull())
    return load(spark, root, "documents").select("doc_id", F.array_join(F.transform(messages, lambda m: m["role"]), ",").alias("roles"))


def pj7_messages(spark, root):
    """The messages of a prompt with what they say; parts without content are left out, places stay in order."""
    parts = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("content")) for role, c in (("system", "project_id"), ("context", "provider"), ("user", "text"))])
    said = F.filter(parts, lambda m: m["content"].isNotNull() & (F.trim(m["content"]) != ""))
    return load(spark, root, "documents").select("doc_id", F.posexplode(said).alias("pos", "m")).select("doc_id", "pos", "m.role", F.md5("m.content").alias("content_md5"))


def tr1_rate_windows(spark, root):
    """Calls of each project in windows of 15 minutes, against a limit of 100."""
    c = calls(spark, root).where("project_id is not null and called_at is not null")
    return windows.rate_windows(c, "called_at", "project_id", 100).select(F.unix_seconds("start").alias("start"), "project_id", "n", "limited")


def tr2_debounced(spark, root):
    """Of every burst of a user's events with gaps under 300 ms the last one."""
    e = load(spark, root, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("string").alias("event"))
    return windows.debounced(e, "ts", "user_id", "event").select(F.unix_micros("start").alias("start"), "user_id", "event")


def pj8_class_methods(spark, root):
    c = records(spark, root).select("record_id", F.explode("classes").alias("c")).where("c is not null")
    return c.select("record_id", F.explode_outer("c.methods").alias("m")).groupBy("record_id").agg(F.count("m").alias("n_methods"))


def pj10_locations(spark, root):
    return files(spark, root).select("file_id", F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"))


def jn13_zipped(spark, root):
    """Positional zip of args and decorators, padded with nulls."""
    f = records(spark, root).select("record_id", F.posexplode("functions").alias("pos", "f")).where("f is not null")
    return f.select("record_id", "pos", F.posexplode(F.arrays_zip(F.coalesce("f.args", F.array().cast("array<string>")).alias("a"), F.coalesce("f.decorators", F.array().cast("array<string>")).alias("d"))).alias("at", "z")).select(
        "record_id", "pos", "at", F.col("z.a").alias("arg"), F.col("z.d").alias("decorator")
    )


def ag14_distinct(spark, root):
    return records(spark, root).groupBy("language").agg(F.countDistinct("project_id").alias("projects"), F.countDistinct("file_path").alias("paths"))


def so7_sorted_json(spark, root):
    return records(spark, root).select("record_id", F.to_json(F.struct("file_path", "language", "project_id", "version")).alias("json"))


def tr2_bursts(spark, root):
    """Last call of every burst of a project; bursts are parted by six quiet hours."""
    c = calls(spark, root).where("project_id is not null and called_at is not null").select("project_id", "seq", "called_at")
    return metrics.bursts(c, "project_id", "called_at", "seq", 6 * 3600).groupBy("project_id", "burst").agg(F.max_by("seq", F.struct("called_at", "seq")).alias("last_seq"), F.count("*").alias("n"))


def sk1_written_by_project(spark, root):
    """Records written to a folder for each project and read back."""
    place = scratch(spark, "records")
    trees.write_by_project(records(spark, root).where("project_id is not null").select("project_id", "record_id", "file_path"), place)
    return spark.read.schema("record_id bigint, file_path string, project_id string").json(place).select("project_id", "record_id", "file_path")


QUERIES = {
    f.__name__: f
    for f in (sf18_sections, sf19_parameters, va3_parameters, sf12_nearest, sf13_retry_delays, fl15_retryable, pj6_nested_path, pj7_messages, tr1_rate_windows, tr2_debounced, pj7_prompts, pj8_class_methods, pj10_locations, jn13_zipped, ag14_distinct, so7_sorted_json, tr2_bursts, sk1_written_by_project)
}

_C = "(SELECT DISTINCT * FROM api_calls)"
_D = "(SELECT * FROM documentation QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_S = "(SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id) = 1)"
_F = f"(SELECT record_id, i - 1 AS pos, functions[i] AS f FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i))"
_LINES = r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND source = 'docstring'),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
    h AS (SELECT *, CASE regexp_extract(trim(line), '^([A-Z][a-z]+):$', 1) WHEN 'Args' THEN 'parameters' WHEN 'Arguments' THEN 'parameters' WHEN 'Parameters' THEN 'parameters' WHEN 'Returns' THEN 'returns' WHEN 'Raises' THEN 'raises'
        WHEN 'Example' THEN 'examples' WHEN 'Examples' THEN 'examples' END AS head FROM l),
    s AS (SELECT doc_id, pos, line, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'summary') AS section, head FROM h),
    p AS (SELECT doc_id, pos, regexp_extract(line, '^\s+([A-Za-z_*][A-Za-z0-9_]*)\s*(?:\(([^()]*)\))?:\s*(.*)$', 1) AS name, nullif(regexp_extract(line, '^\s+([A-Za-z_*][A-Za-z0-9_]*)\s*(?:\(([^()]*)\))?:\s*(.*)$', 2), '') AS type,
        regexp_extract(line, '^\s+([A-Za-z_*][A-Za-z0-9_]*)\s*(?:\(([^()]*)\))?:\s*(.*)$', 3) AS description FROM s WHERE head IS NULL AND section = 'parameters' AND regexp_matches(line, '^\s+([A-Za-z_*][A-Za-z0-9_]*)\s*(?:\(([^()]*)\))?:\s*(.*)$'))"""
ORACLES = {
    "sf18_sections": f"{_LINES} SELECT doc_id, section, count(*) AS n_lines FROM s WHERE head IS NULL GROUP BY ALL",
    "sf19_parameters": f"{_LINES} SELECT doc_id, pos::INT AS pos, name, type, description FROM p",
    "va3_parameters": rf"{_LINES} SELECT type IS NULL OR regexp_matches(type, '^[A-Za-z_][A-Za-z0-9_.]*(\[.*\])?$') AS type_ok, length(trim(description)) >= 10 AS description_ok, count(*) AS n FROM p GROUP BY ALL",
    "sf12_nearest": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, rank::INT AS rank, score FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM s) WHERE rank <= 5""",
    "sf13_retry_delays": f"SELECT seq, least(greatest(least(pow(2.0, seq % 8), 60.0) * CASE WHEN contains(lower(error_type), 'rate') THEN 1.5 ELSE 1.0 END, 0.1), 60.0) AS delay FROM {_C} WHERE NOT coalesce(success, false) AND project_id IS NOT NULL",
    "fl15_retryable": f"SELECT error_type, bool_or(coalesce(regexp_matches(lower(error_type), 'network|timeout'), false)) AS retryable, count(*) AS n FROM {_C} WHERE NOT coalesce(success, false) GROUP BY error_type",
    "pj8_class_methods": f"""WITH c AS (SELECT record_id, unnest(classes) AS c FROM {_D}) SELECT record_id, sum(len([m FOR m IN coalesce(c.methods, []) IF m IS NOT NULL]))::BIGINT AS n_methods FROM c WHERE c IS NOT NULL GROUP BY record_id""",
    "pj7_prompts": """SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN trim(project_id) <> '' THEN 'system' END, CASE WHEN trim(provider) <> '' THEN 'context' END, CASE WHEN trim(text) <> '' THEN 'user' END] IF x IS NOT NULL], ',') AS roles FROM documents""",
    "so7_sorted_json": f"""SELECT record_id, '{{' || array_to_string([x FOR x IN ['"file_path":' || to_json(file_path), '"language":' || to_json(language), '"project_id":' || to_json(project_id), '"version":' || to_json(version)] IF x IS NOT NULL AND NOT ends_with(x, ':null')], ',') || '}}' AS json FROM {_D}""",
    "pj6_nested_path": """SELECT response_id, coalesce(CASE WHEN ok THEN payload->>'$.data.classes[0].name' END, CASE WHEN ok THEN payload->>'$.classes[0].name' END, '') AS name
        FROM (SELECT response_id, coalesce(json_valid(payload), false) AS ok, CASE WHEN json_valid(payload) THEN payload END AS payload FROM doc_responses QUALIFY row_number() OVER (PARTITION BY response_id) = 1)""",
    "pj7_messages": """WITH m AS (SELECT doc_id, [{'role': 'system', 'content': project_id}, {'role': 'context', 'content': provider}, {'role': 'user', 'content': text}] AS ms FROM documents), k AS (SELECT doc_id, [m FOR m IN ms IF trim(m.content) <> ''] AS ms FROM m)
        SELECT doc_id, unnest(range(len(ms)))::INT AS pos, unnest(ms).role AS role, md5(unnest(ms).content) AS content_md5 FROM k""",
    "tr1_rate_windows": f"SELECT (epoch_us(called_at) // 900000000 * 900)::BIGINT AS start, project_id, count(*) AS n, count(*) > 100 AS limited FROM {_C} WHERE project_id IS NOT NULL AND called_at IS NOT NULL GROUP BY ALL",
    "tr2_debounced": """WITH e AS (SELECT epoch_us(ts) AS us, user_id::VARCHAR AS user_id, event_id::VARCHAR AS event FROM events), g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e),
        b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM g)
        SELECT min(us) AS start, user_id, arg_max(event, us) AS event FROM b GROUP BY user_id, burst""",
    "pj10_locations": rf"SELECT file_id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(file_path, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM {_S}",
    "jn13_zipped": f"""WITH z AS (SELECT record_id, pos, coalesce(f.args, []::VARCHAR[]) AS a, coalesce(f.decorators, []::VARCHAR[]) AS d FROM {_F} WHERE f IS NOT NULL)
        SELECT record_id, pos::INT AS pos, i::INT AS at, a[i + 1] AS arg, d[i + 1] AS decorator FROM z, LATERAL (SELECT unnest(range(greatest(len(a), len(d)))) AS i)""",
    "ag14_distinct": f"SELECT language, count(DISTINCT project_id) AS projects, count(DISTINCT file_path) AS paths FROM {_D} GROUP BY language",
    "tr2_bursts": f"""WITH c AS (SELECT project_id, seq, called_at, epoch_us(called_at) - lag(epoch_us(called_at)) OVER (PARTITION BY project_id ORDER BY called_at, seq) AS gap FROM {_C} WHERE project_id IS NOT NULL AND called_at IS NOT NULL),
        b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY called_at, seq) AS burst FROM c)
        SELECT project_id, burst::BIGINT AS burst, arg_max(seq, {{'t': called_at, 's': seq}}) AS last_seq, count(*) AS n FROM b GROUP BY ALL""",
    "sk1_written_by_project": f"SELECT project_id, record_id, file_path FROM {_D} WHERE project_id IS NOT NULL",
}
