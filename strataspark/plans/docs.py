"""Queries of docstrings and reports, with SQL that goes line by line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import report
from ..functions import text as T
from ..operators import docparse
from .metrics import records
from .text import docs


def _read(spark, root):
    d = docs(spark, root).where("source = 'docstring'").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    return d.select("doc_id", "text", docparse.marked_lines(F.col("text")).alias("m"))


def sf19_contents(spark, root):
    """The sections of every docstring, by the digest of what is in them."""
    names = ["summary", "parameters", "returns", "raises", "examples"]
    d = _read(spark, root).select("doc_id", *[docparse.section(F.col("m"), n).alias(n) for n in names])
    return d.unpivot("doc_id", names, "section", "content").where("content is not null").select("doc_id", "section", F.md5("content").alias("content_md5"))


def sf19_entries(spark, root):
    """Parameters with the lines that continue them."""
    d = _read(spark, root).select("doc_id", F.posexplode(docparse.parameters(F.col("m"))).alias("pos", "p"))
    return d.select("doc_id", "pos", "p.name", "p.type", F.md5("p.description").alias("description_md5"))


def sf19_raises(spark, root):
    d = _read(spark, root).select("doc_id", F.posexplode(docparse.raises(F.col("m"))).alias("pos", "p"))
    return d.select("doc_id", "pos", "p.name", F.md5("p.description").alias("description_md5"))


def sf19_returns(spark, root):
    return _read(spark, root).select("doc_id", docparse.returns(F.col("m")).alias("r")).select("doc_id", "r.type", F.md5("r.description").alias("description_md5"))


def sf19_examples(spark, root):
    """Fenced code; every docstring that shows code in its text is read as an example."""
    d = docs(spark, root).where("text like '%```%'").select("doc_id", docparse.marked_lines(F.concat(F.lit("Examples:\n"), F.replace("text", F.lit("\r"), F.lit("")))).alias("m"))
    return d.select("doc_id", F.posexplode(docparse.examples(F.col("m"))).alias("pos", "code")).select("doc_id", "pos", F.md5("code").alias("code_md5"))


def va3_errors(spark, root):
    m = F.col("m")
    found = docparse.errors(F.coalesce(docparse.section(m, "summary"), F.lit("")), docparse.parameters(m), docparse.returns(m))
    return _read(spark, root).select("doc_id", F.md5(F.array_join(found, "|")).alias("errors_md5"), F.size(found).alias("n"))


def sf21_fixes(spark, root):
    f = docs(spark, root).select("doc_id", docparse.fixed(F.col("text")).alias("f"))
    return f.select("doc_id", F.md5("f.text").alias("fixed_md5"), F.array_join("f.changes", ",").alias("changes"))


def va7_pipeline(spark, root):
    """Whether docstrings hold after they are put right; the texts of no docstring are empty ones."""
    d = docs(spark, root).select("doc_id", F.when(F.col("source") == "docstring", F.replace("text", F.lit("\r"), F.lit(""))).alias("text"))
    return docparse.pipeline(d, "doc_id", "text").groupBy("valid", F.size("errors").alias("n_errors")).agg(F.count("*").alias("n"))


def _functions(spark, root):
    f = records(spark, root).select("record_id", F.posexplode("functions").alias("pos", "f")).where("f.docstring is not null")
    args = F.filter(F.coalesce("f.args", F.array().cast("array<string>")), lambda a: a.isNotNull())
    params = F.transform(args, lambda a: F.struct(a.alias("name"), F.lit(None).cast("string").alias("type"), F.concat(F.lit("the "), a).alias("description")))
    return f.select("record_id", "pos", F.col("f.docstring").alias("summary"), params.alias("params"), F.when(F.col("f.async"), "awaitable").alias("result"))


def _form(make):
    def query(spark, root):
        return _functions(spark, root).select("record_id", "pos", F.md5(make(F.col("summary"), F.col("params"), F.col("result"))).alias("docstring_md5"))

    return query


def sf3_report_table(spark, root):
    """Functions of a record as a table, its second column to the right."""
    rows = F.transform(F.filter(F.coalesce("functions", F.slice("functions", 1, 0)), lambda f: f.isNotNull()), lambda f: F.array(f["name"], F.round(f["complexity"], 2).cast("string")))
    return records(spark, root).where("functions is not null").select("record_id", F.md5(report.table(["Function name", "Complexity", "Note"], rows, ["left", "right", "center"])).alias("table_md5"))


def _badges():
    m = "metrics."
    return report.all_badges({"Complexity": F.col(m + "complexity"), "Volume": F.col(m + "halstead.volume"), "Difficulty": F.col(m + "halstead.difficulty"), "Effort": F.col(m + "halstead.effort"), "Maintainability": F.col(m + "maintainability_index")})


def sf7_badges(spark, root):
    return records(spark, root).select("record_id", _badges().alias("badges"))


def rm14_reports(spark, root):
    """The report of every record, whole, by its digest."""

    def items(column: str):
        return F.transform(F.filter(F.col(column), lambda x: x.isNotNull() & x["name"].isNotNull()), lambda x: F.concat_ws("\n\n", F.concat(F.lit("### "), x["name"]), F.nullif(x["docstring"], F.lit(""))))

    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    out = report.report(name, _badges(), F.col("summary"), [report.section("Functions", items("functions")), report.section("Classes", items("classes"))])
    return records(spark, root).where("file_path is not null").select("record_id", F.md5(out).alias("report_md5"))


def sf16_signed(spark, root):
    v = F.col("metrics.complexity") - 15.0
    return records(spark, root).select("record_id", T.signed(v).alias("shown"))


def sf24_spans(spark, root):
    """How long the records of a project span, as text."""
    d = records(spark, root).where("project_id is not null and last_updated is not null").groupBy("project_id").agg((F.max(F.unix_seconds("last_updated")) - F.min(F.unix_seconds("last_updated"))).alias("s"))
    return d.select("project_id", T.duration(F.col("s")).alias("span"))


QUERIES = {
    f.__name__: f
    for f in (sf19_contents, sf19_entries, sf19_raises, sf19_returns, sf19_examples, va3_errors, sf21_fixes, va7_pipeline, sf3_report_table, sf7_badges, rm14_reports, sf16_signed, sf24_spans)
} | {
    "sf22_numpy": _form(docparse.numpy),
    "sf22_jsdoc": _form(lambda s, p, r: docparse.jsdoc(s, p, r, r)),
    "sf22_tsdoc": _form(docparse.tsdoc),
    "sf22_generic": _form(lambda s, p, r: docparse.generic(s, p, r, r)),
}

_D = "(SELECT * FROM documentation QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"


def _parsed(texts: str) -> str:
    """Lines with their sections and entries, by windows over the lines."""
    return rf"""WITH d AS ({texts}),
    l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, regexp_replace(unnest(string_split(text, chr(10))), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS line FROM d),
    h AS (SELECT *, CASE WHEN line LIKE '%:' THEN CASE lower(rtrim(line, ':')) WHEN 'args' THEN 'parameters' WHEN 'arguments' THEN 'parameters' WHEN 'parameters' THEN 'parameters' WHEN 'returns' THEN 'returns'
        WHEN 'raises' THEN 'raises' WHEN 'examples' THEN 'examples' END END AS head FROM l),
    b AS (SELECT *, count(head) OVER w AS block, coalesce(last_value(head IGNORE NULLS) OVER w, 'summary') AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    k AS (SELECT * FROM b WHERE head IS NULL QUALIFY block = max(block) OVER (PARTITION BY doc_id, section)),
    c AS (SELECT doc_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS content FROM k GROUP BY ALL),
    e AS (SELECT doc_id, section, pos, line, count(*) FILTER (contains(line, ':')) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry, contains(line, ':') AS opens,
        trim(line[strpos(line, ':') + 1:], E' \t') AS rest FROM k WHERE line <> '' AND section IN ('parameters', 'raises')),
    f AS (SELECT doc_id, section, (entry - 1)::INT AS pos, max(CASE WHEN opens THEN trim(line[:strpos(line, ':') - 1], E' \t') END) AS name,
        max(CASE WHEN opens THEN CASE WHEN contains(rest, '  ') THEN trim(rest[:strpos(rest, '  ') - 1], E' \t') ELSE rest END END) AS kind,
        max(CASE WHEN opens THEN rest END) AS rest, max(CASE WHEN opens THEN CASE WHEN contains(rest, '  ') THEN trim(rest[strpos(rest, '  ') + 2:], E' \t') ELSE '' END END) AS said,
        coalesce(string_agg(CASE WHEN NOT opens THEN ' ' || line END, '' ORDER BY pos), '') AS more FROM e WHERE entry > 0 GROUP BY doc_id, section, entry),
    r AS (SELECT d.doc_id, CASE WHEN contains(content, ':') THEN trim(content[:strpos(content, ':') - 1], E' \t\n') ELSE 'None' END AS kind,
        CASE WHEN contains(content, ':') THEN trim(content[strpos(content, ':') + 1:], E' \t\n') ELSE coalesce(nullif(content, ''), 'No return value.') END AS said FROM d LEFT JOIN c ON c.doc_id = d.doc_id AND c.section = 'returns'),
    s AS (SELECT d.doc_id, coalesce(content, '') AS content FROM d LEFT JOIN c ON c.doc_id = d.doc_id AND c.section = 'summary'),
    x AS (SELECT doc_id, 1 AS part, pos, unnest([CASE WHEN lower(kind) IN ('none', 'nonetype') THEN NULL WHEN kind = '' THEN 'Parameter ' || name || ': Empty type string'
            WHEN NOT regexp_matches(kind, '^[A-Za-z_][A-Za-z0-9_.]*(\[.*\])?$') THEN 'Parameter ' || name || ': Invalid type format: ' || kind END, CASE WHEN length(trim(said || more)) < 10 THEN 'Parameter ' || name || ' description too short' END]) AS said,
            unnest([0, 1]) AS nth FROM f WHERE section = 'parameters'
        UNION ALL SELECT doc_id, 2, 0, unnest([CASE WHEN lower(kind) IN ('none', 'nonetype') THEN NULL WHEN kind = '' THEN 'Return type: Empty type string' WHEN NOT regexp_matches(kind, '^[A-Za-z_][A-Za-z0-9_.]*(\[.*\])?$') THEN 'Return type: Invalid type format: ' || kind END,
            CASE WHEN length(said) < 10 THEN 'Return missing or too short description' END]), unnest([0, 1]) FROM r
        UNION ALL SELECT doc_id, 3, 0, CASE WHEN length(content) < 10 THEN 'Summary too short (minimum 10 characters)' END, 0 FROM s),
    y AS (SELECT d.doc_id, coalesce(string_agg(x.said, '|' ORDER BY part, pos, nth), '') AS errors, count(x.said) AS n FROM d LEFT JOIN x ON x.doc_id = d.doc_id AND x.said IS NOT NULL GROUP BY d.doc_id)"""


_TEXTS = "SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text IS NOT NULL AND source = 'docstring'"
_FIX = [
    ("{t}", r"'\n\s*\n\s*\n', chr(10) || chr(10), 'g'"),
    ("{t}", r"'^(\s*[A-Za-z]+:)\s*([A-Z])', '\1' || chr(10) || '    \2'"),
    ("{t}", r"'\n\s{4,}', chr(10) || '    ', 'g'"),
    ("{t}", r"""'\"\"\"[\s\n]*', '\"\"\"', 'g'""".replace(r"\"", '"')),
    ("{t}", r"""'[\s\n]*\"\"\"$', '\"\"\"'""".replace(r"\"", '"')),
]


def _fixed(texts: str) -> str:
    steps = [f"f0 AS ({texts})"] + [f"f{i + 1} AS (SELECT *, regexp_replace(t{i}, {rule}) AS t{i + 1} FROM f{i})" for i, (_, rule) in enumerate(_FIX)]
    return ", ".join(steps)


_CHANGES = "array_to_string([i FOR i IN [" + ", ".join(f"CASE WHEN t{i} <> t{i + 1} THEN {i} END" for i in range(5)) + "] IF i IS NOT NULL], ',')"
_E = f"""WITH e AS (SELECT record_id, i - 1 AS pos, functions[i] AS f FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i)),
    a AS (SELECT record_id, pos::INT AS pos, f.docstring AS s, [x FOR x IN coalesce(f.args, []::VARCHAR[]) IF x IS NOT NULL] AS p, CASE WHEN f.async THEN 'awaitable' END AS r FROM e WHERE f.docstring IS NOT NULL)"""
_NL = "chr(10)"


def _joined(*parts: str) -> str:
    return "array_to_string([x FOR x IN flatten([" + ", ".join(parts) + "]) IF x IS NOT NULL], chr(10))"


_COLOUR = "CASE WHEN {v} <= {low} THEN 'success' WHEN {v} <= {medium} THEN 'yellow' ELSE 'critical' END"


def _badge(name: str, value: str) -> str:
    low, medium = {"Complexity": (5, 10), "Volume": (500, 1000), "Difficulty": (5, 10), "Effort": (500, 1000), "Maintainability": (65, 85)}[name]
    return f"CASE WHEN {value} <> 0 THEN '![{name}](https://img.shields.io/badge/{name}-' || printf('%.2f', {value}) || '-' || {_COLOUR.format(v=value, low=low, medium=medium)} || ')' END"


_BADGES = "concat_ws(' ', " + ", ".join(_badge(n, "metrics." + c) for n, c in (("Complexity", "complexity"), ("Volume", "halstead.volume"), ("Difficulty", "halstead.difficulty"), ("Effort", "halstead.effort"), ("Maintainability", "maintainability_index"))) + ")"


def _escaped(x: str) -> str:
    return rf"trim(regexp_replace(replace(regexp_replace({x}, '([`*_{{}}\[$()#+\-.!|])', '\\\1', 'g'), chr(13), ''), '[ \t\n]+', ' ', 'g'))"


def _items(column: str) -> str:
    return f"[concat_ws(chr(10) || chr(10), '### ' || x.name, nullif(x.docstring, '')) FOR x IN {column} IF x IS NOT NULL AND x.name IS NOT NULL]"


ORACLES = {
    "sf19_contents": f"{_parsed(_TEXTS)} SELECT doc_id, section, md5(content) AS content_md5 FROM c",
    "sf19_entries": f"{_parsed(_TEXTS)} SELECT doc_id, pos, name, kind AS type, md5(said || more) AS description_md5 FROM f WHERE section = 'parameters'",
    "sf19_raises": f"{_parsed(_TEXTS)} SELECT doc_id, pos, name, md5(rest || more) AS description_md5 FROM f WHERE section = 'raises'",
    "sf19_returns": f"{_parsed(_TEXTS)} SELECT doc_id, kind AS type, md5(said) AS description_md5 FROM r",
    "sf19_examples": r"""WITH d AS (SELECT doc_id, text FROM documents WHERE contains(text, '```')),
        l AS (SELECT doc_id, unnest(range(len(string_split(replace(text, chr(13), ''), chr(10))))) AS pos, regexp_replace(unnest(string_split(replace(text, chr(13), ''), chr(10))), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS line FROM d),
        h AS (SELECT *, line LIKE '%:' AND lower(rtrim(line, ':')) IN ('args', 'arguments', 'parameters', 'returns', 'raises', 'examples') AS head, line LIKE '%:' AND lower(rtrim(line, ':')) = 'examples' AS ours FROM l),
        b AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM h),
        o AS (SELECT doc_id, block, bool_or(ours) AS ours FROM b GROUP BY ALL),
        k AS (SELECT b.* FROM b JOIN o USING (doc_id, block) WHERE NOT b.head AND (o.ours OR block = 0) QUALIFY block = max(block) OVER (PARTITION BY doc_id)),
        z AS (SELECT * FROM k QUALIFY pos <= max(CASE WHEN line <> '' THEN pos END) OVER (PARTITION BY doc_id)),
        q AS (SELECT *, count(*) FILTER (line LIKE '```%') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fences, count(*) FILTER (line LIKE '```%') OVER (PARTITION BY doc_id) AS n FROM z)
        SELECT doc_id, ((fences - 1) // 2)::INT AS pos, md5(coalesce(string_agg(CASE WHEN line NOT LIKE '```%' THEN line END, chr(10) ORDER BY pos), '')) AS code_md5 FROM q WHERE fences % 2 = 1
        GROUP BY doc_id, fences HAVING max(n) > fences OR count(*) > 1""",
    "va3_errors": f"{_parsed(_TEXTS)} SELECT doc_id, md5(errors) AS errors_md5, n::INT AS n FROM y",
    "sf21_fixes": f"WITH {_fixed('SELECT doc_id, text AS t0 FROM documents WHERE text IS NOT NULL')} SELECT doc_id, md5(t5) AS fixed_md5, {_CHANGES} AS changes FROM f5",
    "va7_pipeline": _parsed(f"WITH {_fixed(_TEXTS.replace('AS text', 'AS t0'))} SELECT doc_id, t5 AS text, len([1 FOR i IN [{', '.join(f't{i} <> t{i + 1}' for i in range(5))}] IF i]) AS fixes, t0 FROM f5")
    + """ SELECT coalesce(y.n = 0 AND d.t0 <> '', false) AS valid, (CASE WHEN d.doc_id IS NULL OR d.t0 = '' THEN 1 ELSE y.n + d.fixes END)::INT AS n_errors, count(*) AS n
        FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) t LEFT JOIN d USING (doc_id) LEFT JOIN y USING (doc_id) GROUP BY ALL""",
    "sf22_numpy": f"{_E} SELECT record_id, pos, md5({_joined('[s, chr(0)]', '''CASE WHEN len(p) > 0 THEN ['Parameters', '----------'] ELSE [] END''', '''flatten([[x || ' : Any', '    the ' || x] FOR x IN p])''', '''CASE WHEN r IS NOT NULL THEN [chr(0), 'Returns', '-------', r] ELSE [] END''')} || chr(10)) AS docstring_md5 FROM a".replace("chr(0)", "''"),
    "sf22_jsdoc": f"{_E} SELECT record_id, pos, md5({_joined('''['/**', ' * ' || s]''', '''CASE WHEN len(p) > 0 THEN [' *'] ELSE [] END''', '''[' * @param {*} ' || x || ' the ' || x FOR x IN p]''', '''[' * @returns {' || r || '} ' || r, ' */']''')}) AS docstring_md5 FROM a",
    "sf22_tsdoc": f"{_E} SELECT record_id, pos, md5({_joined('''['/**', ' * ' || s, ' *']''', '''[' * @param ' || x || ' - the ' || x FOR x IN p]''', '''CASE WHEN len(p) > 0 THEN [' *'] ELSE [] END''', '''[' * @returns ' || r, ' */']''')}) AS docstring_md5 FROM a",
    "sf22_generic": f"{_E} SELECT record_id, pos, md5({_joined('[s]', '''CASE WHEN len(p) > 0 THEN ['', 'Parameters:'] ELSE [] END''', '''['  ' || x || ' (): the ' || x FOR x IN p]''', '''CASE WHEN r IS NOT NULL THEN ['', 'Returns:', '  ' || r || ': ' || r] ELSE [] END''')}) AS docstring_md5 FROM a",
    "sf3_report_table": f"""WITH r AS (SELECT record_id, [[coalesce(f.name, ''), coalesce(round(f.complexity, 2)::VARCHAR, ''), ''] FOR f IN functions IF f IS NOT NULL] AS rows FROM {_D} WHERE functions IS NOT NULL)
        SELECT record_id, md5(CASE WHEN len(rows) = 0 THEN '' ELSE array_to_string(list_concat(['| Function name | Complexity | Note |', '| :--- | ---: | :---: |'], ['| ' || {_escaped('x[1]')} || ' | ' || {_escaped('x[2]')} || ' | ' || x[3] || ' |' FOR x IN rows]), chr(10)) END) AS table_md5 FROM r""",
    "sf7_badges": f"SELECT record_id, {_BADGES} AS badges FROM {_D}",
    "rm14_reports": rf"""WITH b AS (SELECT record_id, concat_ws(chr(10) || chr(10), '# ' || regexp_extract(file_path, '([^/]*)$', 1), nullif({_BADGES}, ''), nullif(summary, ''),
            CASE WHEN len({_items('functions')}) > 0 THEN '## Functions' || chr(10) || chr(10) || array_to_string({_items('functions')}, chr(10) || chr(10)) END,
            CASE WHEN len({_items('classes')}) > 0 THEN '## Classes' || chr(10) || chr(10) || array_to_string({_items('classes')}, chr(10) || chr(10)) END) AS body FROM {_D} WHERE file_path IS NOT NULL),
        l AS (SELECT record_id, body, [{{'signs': regexp_extract(x, '^(#+)', 1), 'title': trim(regexp_replace(x, '^#+', ''))}} FOR x IN string_split(body, chr(10))] AS ls FROM b),
        t AS (SELECT record_id, body, array_to_string([repeat('  ', length(h.signs)::INT - 1) || '- [' || h.title || '](#' || replace(regexp_replace(lower(h.title), '[^\p{{L}}\p{{N}}_\- ]', '', 'g'), ' ', '-') || ')' FOR h IN ls IF h.signs <> '' AND h.title <> ''], chr(10)) AS toc FROM l)
        SELECT record_id, md5('# Table of Contents' || chr(10) || chr(10) || toc || chr(10) || chr(10) || body) AS report_md5 FROM t""",
    "sf16_signed": f"SELECT record_id, CASE WHEN metrics.complexity IS NULL THEN 'N/A' ELSE CASE WHEN metrics.complexity > 15 THEN '+' ELSE '' END || printf('%.1f', metrics.complexity - 15.0) END AS shown FROM {_D}",
    "sf24_spans": f"""WITH s AS (SELECT project_id, (floor(epoch(max(last_updated))) - floor(epoch(min(last_updated))))::BIGINT AS s FROM {_D} WHERE project_id IS NOT NULL AND last_updated IS NOT NULL GROUP BY project_id)
        SELECT project_id, CASE WHEN s // 86400 = 1 THEN '1 day, ' WHEN s // 86400 <> 0 THEN (s // 86400) || ' days, ' ELSE '' END || printf('%d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS span FROM s""",
}
