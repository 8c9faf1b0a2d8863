"""Queries of the text functions over documents, parts and documentation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics
from ..sources.tables import load
from .metrics import records


def docs(spark, root):
    return load(spark, root, "documents").where("text is not null")


def sf1_truncate(spark, root):
    return docs(spark, root).select("doc_id", F.md5(T.truncate(F.col("text"))).alias("cut_md5"))


def sf2_escape(spark, root):
    return docs(spark, root).select("doc_id", F.md5(T.escape_markdown(F.col("text"))).alias("escaped_md5"))


def sf3_table(spark, root):
    return load(spark, root, "nation").select("n_nationkey", T.table_row([F.col("n_name"), F.col("n_regionkey")]).alias("row"))


def sf4_toc(spark, root):
    lines = docs(spark, root).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").startswith("#"))
    title = F.trim(F.regexp_replace("line", r"^#+", ""))
    level = T.heading_level(F.col("line"))
    return lines.withColumns({"title": F.trim(F.replace(title, F.lit("\r"), F.lit(""))), "level": level}).where("title <> ''").select(
        "doc_id", "pos", "level", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), F.col("title"), F.lit("](#"), T.anchor(F.col("title")), F.lit(")")).alias("entry")
    )


def sf5_badges(spark, root):
    p = load(spark, root, "part")
    colour = T.badge_colour(F.col("p_size"), F.lit(10), F.lit(30))
    return p.select("p_partkey", colour.alias("colour"), T.badge(F.lit("unit_size"), F.col("p_size").cast("double"), colour).alias("badge"))


def sf8_estimate(spark, root):
    return docs(spark, root).groupBy("source").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"), F.floor(F.sum(F.length("text")) / 4).cast("bigint").alias("tokens_at_once"))


def sf15_status(spark, root):
    v = F.col("metrics.complexity")
    return records(spark, root).select("record_id", T.metric_status(v, F.lit(15.0)).alias("status"), T.fixed(v).alias("shown"))


def sf17_signatures(spark, root):
    f = records(spark, root).select("record_id", F.posexplode("functions").alias("pos", "f"))
    args = F.filter(F.coalesce("f.args", F.array().cast("array<string>")), lambda a: a.isNotNull())
    return f.where("f.name is not null").select("record_id", "pos", T.signature_key(F.col("f.name"), args).alias("key"))


def sf21_fix(spark, root):
    return records(spark, root).where("summary is not null").select("record_id", T.fix_docstring(F.col("summary")).alias("fixed"))


def sf22_google(spark, root):
    f = records(spark, root).select("record_id", F.posexplode("functions").alias("pos", "f")).where("f is not null")
    args = F.filter(F.col("f.args"), lambda a: a.isNotNull())
    return f.select("record_id", "pos", T.format_google(F.col("f.docstring"), args).alias("docstring"))


def sf23_json(spark, root):
    k = F.from_json("props", "k int")["k"]
    return load(spark, root, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def sf24_durations(spark, root):
    d = records(spark, root).where("project_id is not null").groupBy("project_id").agg(F.max("last_updated").alias("b"), F.min("last_updated").alias("a"))
    return d.select("project_id", ((F.unix_micros("b") - F.unix_micros("a")) / 1e6).alias("seconds"))


def sf28_suffix(spark, root):
    s = load(spark, root, "source_files").dropDuplicates(["file_id"])
    return s.groupBy(F.lower(F.element_at(F.split("file_path", r"\."), -1)).alias("suffix")).agg(F.count("*").alias("n"))


def ag11_prompt_tokens(spark, root):
    return docs(spark, root).groupBy("project_id", "provider").agg(F.floor(F.sum(F.length("text")) / 4).cast("bigint").alias("tokens"))


def ag12_ordered_concat(spark, root):
    """Whole summaries of each file's records, in order."""
    r = records(spark, root).where("project_id is not null and file_path is not null and summary is not null")
    return metrics.ordered_concat(r, ["project_id", "file_path"], "record_id", "summary", "\n\n").select("project_id", "file_path", F.trim("summary").alias("content"))


def ag16_special_counts(spark, root):
    return docs(spark, root).select("doc_id", T.occurrences(F.col("text"), "\n").cast("bigint").alias("newlines"), T.occurrences(F.col("text"), "```").cast("bigint").alias("fences"))


def ex8_html_tags(spark, root):
    s = load(spark, root, "source_files").dropDuplicates(["file_id"]).where(F.lower("file_path").rlike(r"\.html?$"))
    tags = s.select("file_id", F.explode(F.regexp_extract_all("code", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("file_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (sf1_truncate, sf2_escape, sf3_table, sf4_toc, sf5_badges, sf8_estimate, sf15_status, sf17_signatures, sf21_fix, sf22_google, sf23_json, sf24_durations, sf28_suffix, ag11_prompt_tokens, ag12_ordered_concat, ag16_special_counts, ex8_html_tags)
}

_T = "(SELECT * FROM documents WHERE text IS NOT NULL)"
_D = "(SELECT * FROM documentation QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_S = "(SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id) = 1)"
ORACLES = {
    "sf1_truncate": f"""SELECT doc_id, md5(CASE WHEN length(text) <= 100 THEN text ELSE (CASE WHEN regexp_matches(substr(text, 1, 100), '(?s)^[^ ].* ') OR regexp_matches(substr(text, 1, 100), '(?s)^ .* ')
        THEN regexp_extract(substr(text, 1, 100), '(?s)^(.+) [^ ]*$', 1) ELSE substr(text, 1, 100) END) || '...' END) AS cut_md5 FROM {_T}""",
    "sf2_escape": rf"""SELECT doc_id, md5(trim(regexp_replace(replace(regexp_replace(text, '([`*_{{}}\[$()#+\-.!|])', '\\\1', 'g'), chr(13), ''), '[ \t\n]+', ' ', 'g'))) AS escaped_md5 FROM {_T}""",
    "sf3_table": "SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' |' AS row FROM nation",
    "sf4_toc": rf"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM {_T}),
        t AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(replace(trim(regexp_replace(line, '^#+', '')), chr(13), '')) AS title FROM l WHERE line LIKE '#%')
        SELECT doc_id, pos::INT AS pos, level::INT AS level, repeat('  ', level::INT - 1) || '- [' || title || '](#' || replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\- ]', '', 'g'), ' ', '-') || ')' AS entry FROM t WHERE title <> ''""",
    "sf5_badges": """SELECT p_partkey, c AS colour, '![Unit%20Size](https://img.shields.io/badge/Unit%20Size-' || printf('%.2f', p_size::DOUBLE) || '-' || c || ')' AS badge
        FROM (SELECT *, CASE WHEN p_size <= 10 THEN 'success' WHEN p_size <= 30 THEN 'yellow' ELSE 'critical' END AS c FROM part)""",
    "sf8_estimate": f"SELECT source, sum(length(text) // 4)::BIGINT AS tokens, (sum(length(text)) // 4)::BIGINT AS tokens_at_once FROM {_T} GROUP BY source",
    "sf15_status": f"""SELECT record_id, CASE WHEN metrics.complexity IS NULL THEN 'grey' WHEN metrics.complexity >= 1.2 * 15.0 THEN 'red' WHEN metrics.complexity >= 15.0 THEN 'yellow' ELSE 'green' END AS status,
        CASE WHEN metrics.complexity IS NULL THEN 'N/A' ELSE printf('%.2f', metrics.complexity) END AS shown FROM {_D}""",
    "sf17_signatures": f"""WITH e AS (SELECT record_id, i - 1 AS pos, functions[i] AS f FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i))
        SELECT record_id, pos::INT AS pos, md5(f.name || '(' || coalesce(array_to_string([a FOR a IN f.args IF a IS NOT NULL], ', '), '') || ')') AS key FROM e WHERE f.name IS NOT NULL""",
    "sf21_fix": rf"""WITH t AS (SELECT record_id, trim(regexp_replace(regexp_replace(summary, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS s FROM {_D} WHERE summary IS NOT NULL), c AS (SELECT record_id, upper(substr(s, 1, 1)) || substr(s, 2) AS s FROM t)
        SELECT record_id, CASE WHEN regexp_matches(s, '[.!?:`)]\s*$') OR s = '' THEN s ELSE s || '.' END AS fixed FROM c""",
    "sf22_google": f"""WITH e AS (SELECT record_id, i - 1 AS pos, functions[i] AS f FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i)),
        a AS (SELECT record_id, pos, f.docstring AS d, ['    ' || x FOR x IN coalesce(f.args, []::VARCHAR[]) IF x IS NOT NULL] AS l FROM e WHERE f IS NOT NULL)
        SELECT record_id, pos::INT AS pos, coalesce(d, '') || CASE WHEN len(l) > 0 THEN chr(10) || chr(10) || 'Args:' || chr(10) || array_to_string(l, chr(10)) ELSE '' END AS docstring FROM a""",
    "sf23_json": "SELECT (props::JSON->>'k')::INT AS k, count(*) AS n FROM events GROUP BY ALL",
    "sf24_durations": f"SELECT project_id, (epoch_us(max(last_updated)) - epoch_us(min(last_updated))) / 1e6 AS seconds FROM {_D} WHERE project_id IS NOT NULL GROUP BY project_id",
    "sf28_suffix": f"SELECT lower(string_split(file_path, '.')[-1]) AS suffix, count(*) AS n FROM {_S} GROUP BY ALL",
    "ag11_prompt_tokens": f"SELECT project_id, provider, (sum(length(text)) // 4)::BIGINT AS tokens FROM {_T} GROUP BY ALL",
    "ag12_ordered_concat": f"SELECT project_id, file_path, trim(string_agg(summary, chr(10) || chr(10) ORDER BY record_id)) AS content FROM {_D} WHERE project_id IS NOT NULL AND file_path IS NOT NULL AND summary IS NOT NULL GROUP BY ALL",
    "ag16_special_counts": f"SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines, ((length(text) - length(replace(text, '```', ''))) // 3)::BIGINT AS fences FROM {_T}",
    "ex8_html_tags": f"""WITH t AS (SELECT file_id, unnest(regexp_extract_all(code, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM {_S} WHERE regexp_matches(lower(file_path), '\\.html?$'))
        SELECT file_id, lower(tag) AS tag, count(*) AS n FROM t GROUP BY ALL""",
}
