"""Queries of chunking, structure, graph and validation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, extract, graph, validate
from ..operators.metrics import numbered
from ..sources.shared import scratch
from ..sources.tables import load
from ..streaming import windows
from .metrics import calls, records
from .store import files, pj9_path_tree
from .text import docs


def _language(spark, root, *suffixes):
    return files(spark, root).where(F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).isin(*suffixes))


def ch1_line_chunks(spark, root):
    return chunking.line_chunks(docs(spark, root).select("doc_id", "text"), "doc_id", "text", 100)


def ch5_merged_chunks(spark, root):
    return chunking.merge_adjacent(ch1_line_chunks(spark, root), "doc_id")


def ch6_token_slices(spark, root):
    return chunking.token_slices(docs(spark, root).select("doc_id", "text"), "doc_id", "text", 50).select("doc_id", "slice_no", F.md5("slice").alias("slice_md5"))


def ch7_materialised(spark, root):
    return chunking.materialised(docs(spark, root).select("doc_id", "text"), "doc_id", "text", 100).select("doc_id", "chunk_no", "tokens", F.md5("content").alias("content_md5"))


def ch3_split_points(spark, root):
    """Where a Python file would be split, read as a class if it has one and else as a function."""
    py = _language(spark, root, "py").where("code is not null").select("file_id", F.split(F.replace("code", F.lit("\r"), F.lit("")), "\n", -1).alias("lines"))
    kind = F.when(F.exists("lines", lambda x: x.startswith("class ")), "class").otherwise("function")
    return py.select("file_id", kind.alias("kind"), "lines").select("file_id", "kind", chunking.split_after(F.col("kind"), F.col("lines")).alias("split_at"))


def ch4_split(spark, root):
    """Every chunk of a text cut in two at half of its lines."""
    c = chunking.materialised(docs(spark, root).select("doc_id", "text"), "doc_id", "text", 100)
    half = F.floor((F.col("end_line") - F.col("start_line") + 1) / 2).cast("int")
    return chunking.split_chunks(c, half).select("doc_id", "chunk_no", "part", "start_line", "end_line", F.md5("content").alias("content_md5"))


def ch5_contents(spark, root):
    """Neighbouring chunks as one: their contents, and the first name that there is."""
    c = chunking.materialised(docs(spark, root).select("doc_id", "text"), "doc_id", "text", 100)
    named = c.withColumn("name", F.when(F.col("chunk_no") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("n"), F.col("chunk_no").cast("string"))))
    return chunking.merge_contents(named, "doc_id").select("doc_id", "chunk_no", "next_no", "start_line", "end_line", "name", F.md5("content").alias("content_md5"))


def ch8_batches(spark, root):
    rows = numbered(calls(spark, root).where("project_id is not null").select("project_id", "seq"), "project_id", "seq")
    return rows.select("project_id", "seq", F.floor((F.col("n") - 1) / 5).cast("bigint").alias("batch"))


def ch2_python_chunks(spark, root):
    return chunking.python_chunks(_language(spark, root, "py"), 4096 - 200)


def so6_within_budget(spark, root):
    """Records of a file, newest first, that fit into 12 tokens of summary together."""
    r = records(spark, root).where("project_id is not null and file_path is not null")
    items = r.select("project_id", "file_path", (-F.col("record_id")).alias("order"), F.col("record_id").alias("id"), F.floor(F.coalesce(F.length("summary"), F.lit(0)) / 4).alias("tokens"))
    return chunking.fitting(items, ["project_id", "file_path"], 12).select("project_id", "file_path", F.col("id").alias("record_id"))


def ex1_python_structure(spark, root):
    return extract.python_structure(_language(spark, root, "py"))


def ex11_raised(spark, root):
    return ex1_python_structure(spark, root).where("kind = 'raises'").groupBy("name").agg(F.count("*").alias("n"))


def _declared(language):
    def query(spark, root):
        return extract.declarations(_language(spark, root, *extract.SUFFIXES[language]), language)

    return query


def ex3_script_metrics(spark, root):
    return extract.script_metrics(_language(spark, root, "js", "mjs"))


def ud1_structure(spark, root):
    """Declarations of all languages by kind, each file by the handler of its language."""
    return extract.structure(files(spark, root)).groupBy("language", "kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


def in1_docstrings(spark, root):
    """Python files with a docstring put into their first function, by how many lines they grew."""
    py = _language(spark, root, "py").where("code is not null").select("file_id", F.replace("code", F.lit("\r"), F.lit("")).alias("code"))
    first = F.regexp_extract("code", r"(?m)^(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)", 1)
    out = extract.insert_docstring(F.col("code"), F.nullif(first, F.lit("")), F.lit("Says what this does."))
    grown = (F.length(out) - F.length(F.replace(out, F.lit("Says what this does."), F.lit("")))) / 20
    return py.select("file_id", grown.cast("int").alias("n_put"), F.md5(F.regexp_replace(out, r'[ ]*"""Says what this does\."""\n', "")).alias("rest_md5"))


def in2_comments(spark, root):
    """Go files with a comment before their first function."""
    go = _language(spark, root, "go").where("code is not null").select("file_id", F.replace("code", F.lit("\r"), F.lit("")).alias("code"))
    first = F.regexp_extract("code", r"(?m)^func ([A-Za-z_][A-Za-z0-9_]*)\(", 1)
    return go.select("file_id", F.md5(extract.insert_comment(F.col("code"), F.nullif(first, F.lit("")), F.concat(first, F.lit(" costs $1.")), "go")).alias("code_md5"))


def gr1_dependencies(spark, root):
    return ex1_python_structure(spark, root).where("kind in ('import', 'uses')").select("file_id", "kind", "name")


def gr1_names(spark, root):
    return extract.imported_names(_language(spark, root, "py"))


def ex11_names(spark, root):
    """How often each exception is raised, and whether it is named like one."""
    raised = extract.declarations(_language(spark, root, "py"), "python").where("kind = 'raises'")
    return raised.groupBy("name", validate.exception_name(F.col("name")).alias("ok")).agg(F.count("*").alias("n"))


def gr2_resolved(spark, root):
    py = _language(spark, root, "py")
    module = py.select("project_id", "file_id", F.regexp_replace(F.regexp_extract("file_path", r"([^/]+)\.py$", 1), "^$", "?").alias("module"))
    deps = extract.python_structure(py).where("kind = 'import'").join(py.select("file_id", "project_id"), "file_id")
    names = deps.select("project_id", "file_id", F.explode(F.array_distinct(F.split("name", r"\."))).alias("name")).where("name <> ''")
    return graph.resolve(names, module)


def gr3_reach(spark, root):
    """Depth of every node of the projects' path trees below their roots; a path names what is above it."""
    nodes = pj9_path_tree(spark, root).select(F.concat("project_id", F.lit("/"), "path").alias("node"))
    parts = F.split("node", "/")
    tree = nodes.select(parts[0].alias("seed"), "node", (F.size(parts) - 1).alias("depth"))
    return tree.unionByName(tree.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())


def gr4_descendants(spark, root):
    parts = F.split("file_path", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return files(spark, root).where("project_id is not null and file_path is not null").select("project_id", up.alias("path")).groupBy("project_id", "path").agg(F.count("*").alias("n_files"))


def va1_documents(spark, root):
    return validate.document_violations(records(spark, root)).select("record_id", F.array_join("violations", ",").alias("violations"))


def va5_summaries(spark, root):
    return records(spark, root).where("summary is not null").select("record_id", F.array_join(validate.summary_quality(F.col("summary")), ",").alias("violations"))


def va6_exceptions(spark, root):
    return ex1_python_structure(spark, root).where("kind = 'raises'").select("file_id", "name", "line", validate.exception_name(F.col("name")).alias("ok"))


def tr5_stream_totals(spark, root):
    """The call log read as a file stream into running totals; repeated calls count, as a stream delivers them."""
    source = load(spark, root, "api_calls")
    place = scratch(spark, "totals")
    stream = spark.readStream.schema(source.schema).parquet(f"{root}/api_calls.parque[t]")  # a pattern takes a file as well as a folder
    windows.run_totals(windows.cumulative(stream, "provider"), f"{place}/table", f"{place}/state")
    return spark.read.parquet(f"{place}/table")


QUERIES = {
    f.__name__: f
    for f in (tr5_stream_totals, gr1_names, ex11_names, ch3_split_points, ch4_split, ch5_contents, ex3_script_metrics, ud1_structure, in1_docstrings, in2_comments, ch1_line_chunks, ch2_python_chunks, ch5_merged_chunks, ch6_token_slices, ch7_materialised, ch8_batches, so6_within_budget, ex1_python_structure, ex11_raised, gr1_dependencies, gr2_resolved, gr3_reach, gr4_descendants, va1_documents, va5_summaries, va6_exceptions)
} | {
    "ex1_python": _declared("python"),
    "ex2_javascript": _declared("javascript"),
    "ex2_typescript": _declared("typescript"),
    "ex4_java": _declared("java"),
    "ex5_go": _declared("go"),
    "ex6_cpp": _declared("cpp"),
    "ex7_css": _declared("css"),
}

_D = "(SELECT * FROM documentation QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_S = "(SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id) = 1)"
_T = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


_HIDE = {"script": r"""\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''|`(?:[^`\\]|\\.)*`|//[^\n]*|(?s:/\*.*?\*/)""", "clike": r"""\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''|//[^\n]*|(?s:/\*.*?\*/)""", "python": r"""(?s:\"{3}.*?\"{3})|(?s:''{3}.*?''{3})|\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''|#[^\n]*""", "css": r"""\"(?:[^\"\\\n]|\\.)*\"|''(?:[^''\\\n]|\\.)*''|(?s:/\*.*?\*/)"""}
_NAME = "regexp_matches({}, '^[A-Za-z_$]')"


def _tokens_sql(family: str, *suffixes: str) -> str:
    """Tokens of the code outside texts and comments, each with those behind it."""
    named = ", ".join(f"'{s}'" for s in suffixes)
    word = "[-A-Za-z_][-A-Za-z0-9_]*" if family == "css" else "[A-Za-z_$][A-Za-z0-9_$]*"
    hide = _HIDE["script" if family == "go" else family]
    return rf"""WITH f AS (SELECT file_id, regexp_extract_all(regexp_replace(replace(code, chr(13), ''), '{hide}', ' ', 'g'), '{word}|[0-9][A-Za-z0-9_.]*|[^\s]') AS ts FROM {_S} WHERE code IS NOT NULL AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) IN ({named})),
        u AS (SELECT file_id, unnest(range(len(ts))) AS i, unnest(ts) AS t FROM f),
        w AS (SELECT *, lead(t) OVER s AS t1, lead(t, 2) OVER s AS t2, lead(t, 3) OVER s AS t3, lead(t, 4) OVER s AS t4 FROM u WINDOW s AS (PARTITION BY file_id ORDER BY i)),
        p AS (SELECT file_id, i, t, lead(t) OVER s AS next, lead(i) OVER s AS till FROM u WHERE t IN ('(', ')') WINDOW s AS (PARTITION BY file_id ORDER BY i))"""


def _numbered_sql(*parts: str) -> str:
    return ", n AS (" + " UNION ALL ".join(parts) + ") SELECT file_id, kind, (row_number() OVER (PARTITION BY file_id, kind ORDER BY i) - 1)::INT AS pos, name FROM n"


def _kind_sql(kind: str, when: str, name: str = "t1") -> str:
    return f"SELECT file_id, i, '{kind}' AS kind, {name} AS name FROM w WHERE {when}"


_DECLARED = {
    "ex1_python": _tokens_sql("python", "py") + _numbered_sql(_kind_sql("function", f"t = 'def' AND {_NAME.format('t1')}"), _kind_sql("class", f"t = 'class' AND {_NAME.format('t1')}"), _kind_sql("raises", f"t = 'raise' AND {_NAME.format('t1')}")),
    "ex2_javascript": _tokens_sql("script", "js", "mjs")
    + _numbered_sql(
        _kind_sql("function", f"t = 'function' AND t1 = '*' AND t3 = '(' AND {_NAME.format('t2')}", "t2"),
        _kind_sql("function", f"t = 'function' AND t2 = '(' AND {_NAME.format('t1')}"),
        _kind_sql("class", f"t = 'class' AND {_NAME.format('t1')}"),
        f"""SELECT w.file_id, w.i, 'arrow', w.t1 FROM w JOIN p ON p.file_id = w.file_id AND p.i = w.i + CASE WHEN w.t3 = 'async' THEN 4 ELSE 3 END AND p.t = '(' AND p.next = ')' JOIN w e ON e.file_id = w.file_id AND e.i = p.till AND e.t1 = '=' AND e.t2 = '>'
            WHERE w.t = 'const' AND {_NAME.format('w.t1')} AND w.t2 = '='""",
    ),
    "ex2_typescript": _tokens_sql("script", "ts") + _numbered_sql(_kind_sql("function", f"t = 'function' AND t2 = '(' AND {_NAME.format('t1')}"), _kind_sql("class", f"t = 'class' AND {_NAME.format('t1')}"), _kind_sql("interface", f"t = 'interface' AND {_NAME.format('t1')}")),
    "ex4_java": _tokens_sql("clike", "java")
    + r""", x AS (SELECT *, min(CASE WHEN NOT regexp_matches(t, '^[A-Za-z_0-9<>,\[\]]') THEN i END) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM w),
        m AS (SELECT x.file_id, x.i, s.i AS at_paren, l.t AS name FROM x JOIN u s ON s.file_id = x.file_id AND s.i = x.stop AND s.t = '(' JOIN u l ON l.file_id = x.file_id AND l.i = x.stop - 1 WHERE x.t IN ('public', 'private', 'protected') AND x.stop - 1 - x.i >= 2 AND regexp_matches(l.t, '^[A-Za-z_]'))"""
    + _numbered_sql(_kind_sql("class", f"t IN ('class', 'interface', 'enum', 'record') AND {_NAME.format('t1')}"), "SELECT file_id, min(i) AS i, 'method', name FROM m GROUP BY file_id, at_paren, name"),
    "ex5_go": _tokens_sql("go", "go")
    + _numbered_sql(
        _kind_sql("function", f"t = 'func' AND t2 = '(' AND {_NAME.format('t1')}"),
        f"SELECT w.file_id, w.i, 'function', e.t1 FROM w JOIN p ON p.file_id = w.file_id AND p.i = w.i + 1 AND p.t = '(' AND p.next = ')' JOIN w e ON e.file_id = w.file_id AND e.i = p.till AND e.t2 = '(' AND {_NAME.format('e.t1')} WHERE w.t = 'func' AND w.t1 = '('",
        _kind_sql("struct", f"t = 'type' AND t2 = 'struct' AND {_NAME.format('t1')}"),
    ),
    "ex6_cpp": _tokens_sql("clike", "cpp", "cc", "h", "hpp") + _numbered_sql(_kind_sql("class", f"t IN ('class', 'struct') AND {_NAME.format('t1')} AND (t2 IN (':', '{{') OR t2 = 'final' AND t3 IN (':', '{{'))"), _kind_sql("macro", f"t = '#' AND t1 = 'define' AND {_NAME.format('t2')}", "t2")),
    "ex7_css": _tokens_sql("css", "css") + _numbered_sql(_kind_sql("variable", "regexp_matches(t, '^--[A-Za-z]') AND t1 = ':'", "t")),
}
_ALL = " UNION ALL ".join(f"SELECT '{n.split('_')[1]}' AS language, kind, name FROM ({sql})" for n, sql in _DECLARED.items())
_WORDS = ", ".join(f"'{w}'" for w in extract.OPERATOR_WORDS)


_CHUNKS = f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {_T}),
    r AS (SELECT doc_id, lines, list_reduce([{{'total': length(x) // 4, 'pos': 1::BIGINT, 'ends': []::BIGINT[]}} FOR x IN lines], lambda a, b: {{'total': CASE WHEN a.total + b.total >= 100 THEN 0 ELSE a.total + b.total END,
        'pos': a.pos + 1, 'ends': CASE WHEN a.total + b.total >= 100 THEN list_append(a.ends, a.pos + 1) ELSE a.ends END}}, {{'total': 0::BIGINT, 'pos': 0::BIGINT, 'ends': []::BIGINT[]}}) AS s FROM l),
    e AS (SELECT doc_id, lines, CASE WHEN len(s.ends) > 0 AND s.ends[-1] = s.pos THEN s.ends ELSE list_append(s.ends, s.pos) END AS ends FROM r),
    c AS (SELECT doc_id, lines, i - 1 AS chunk_no, CASE WHEN i = 1 THEN 1 ELSE ends[i - 1] + 1 END AS start_line, ends[i] AS end_line FROM e, LATERAL (SELECT unnest(range(1, len(ends) + 1)) AS i))"""
ORACLES = {
    "tr5_stream_totals": """SELECT provider, count(*) AS api_calls, count(*) FILTER (WHERE NOT coalesce(success, false)) AS api_errors, sum(CASE WHEN success THEN coalesce(tokens, 0) ELSE 0 END)::BIGINT AS total_tokens
        FROM api_calls GROUP BY provider""",
    "ch1_line_chunks": f"{_CHUNKS} SELECT doc_id, chunk_no::INT AS chunk_no, start_line::INT AS start_line, end_line::INT AS end_line FROM c",
    "ch5_merged_chunks": f"{_CHUNKS} SELECT a.doc_id, a.chunk_no::INT AS chunk_no, b.chunk_no::INT AS next_no, a.start_line::INT AS start_line, b.end_line::INT AS end_line FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.end_line + 1 = b.start_line",
    "ch6_token_slices": f"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS x FROM {_T})
        SELECT doc_id, i::INT AS slice_no, md5(array_to_string(x[i * 50 + 1:i * 50 + 50], ' ')) AS slice_md5 FROM t, LATERAL (SELECT unnest(range(greatest((len(x) + 49) // 50, 1))) AS i)""",
    "ch7_materialised": f"{_CHUNKS} SELECT doc_id, chunk_no::INT AS chunk_no, (length(k) // 4)::BIGINT AS tokens, md5(k) AS content_md5 FROM (SELECT doc_id, chunk_no, array_to_string(lines[start_line:end_line], chr(10)) AS k FROM c)",
    "ch3_split_points": rf"""WITH p AS (SELECT file_id, string_split(replace(code, chr(13), ''), chr(10)) AS ls FROM {_S} WHERE code IS NOT NULL AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) = 'py'),
        k AS (SELECT file_id, ls, CASE WHEN len([x FOR x IN ls IF starts_with(x, 'class ')]) > 0 THEN 'class' ELSE 'function' END AS kind FROM p),
        l AS (SELECT file_id, kind, len(ls) AS n, unnest(range(len(ls))) AS i, ltrim(unnest(ls), E' \t') AS x FROM k)
        SELECT file_id, kind, (CASE WHEN kind = 'function' THEN min(CASE WHEN regexp_matches(x, '^(return|yield)') AND i + 1 < n THEN i + 1 END) ELSE min(CASE WHEN starts_with(x, 'def ') AND i > 0 THEN i END) END)::INT AS split_at FROM l GROUP BY file_id, kind""",
    "ch4_split": f"""{_CHUNKS}, h AS (SELECT doc_id, chunk_no, lines, start_line AS a, end_line AS b, (end_line - start_line + 1) // 2 AS k FROM c),
        s AS (SELECT doc_id, chunk_no, 0 AS part, lines, a, a + k - 1 AS b FROM h WHERE k > 0 UNION ALL SELECT doc_id, chunk_no, 1, lines, a + k, b FROM h WHERE k > 0)
        SELECT doc_id, chunk_no::INT AS chunk_no, part::INT AS part, a::INT AS start_line, b::INT AS end_line, md5(array_to_string(lines[a:b], chr(10))) AS content_md5 FROM s""",
    "ch5_contents": f"""{_CHUNKS}, m AS (SELECT doc_id, chunk_no, start_line, end_line, array_to_string(lines[start_line:end_line], chr(10)) AS content, CASE WHEN chunk_no % 2 = 0 THEN '' ELSE 'n' || chunk_no END AS name FROM c)
        SELECT a.doc_id, a.chunk_no::INT AS chunk_no, b.chunk_no::INT AS next_no, a.start_line::INT AS start_line, b.end_line::INT AS end_line, coalesce(nullif(a.name, ''), b.name) AS name, md5(a.content || chr(10) || b.content) AS content_md5
        FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.end_line + 1 = b.start_line""",
    "so6_within_budget": f"""WITH i AS (SELECT project_id, file_path, list({{'id': record_id, 't': (coalesce(length(summary), 0) // 4)::BIGINT, 'u': 0::BIGINT, 'got': []::BIGINT[]}} ORDER BY record_id DESC) AS line FROM {_D} WHERE project_id IS NOT NULL AND file_path IS NOT NULL GROUP BY ALL)
        SELECT project_id, file_path, unnest(list_reduce(line, lambda a, x: CASE WHEN a.u + x.t <= 12 THEN {{'id': x.id, 't': x.t, 'u': a.u + x.t, 'got': list_append(a.got, x.id)}} ELSE a END, {{'id': 0::BIGINT, 't': 0::BIGINT, 'u': 0::BIGINT, 'got': []::BIGINT[]}}).got) AS record_id FROM i""",
    "ch8_batches": "SELECT project_id, seq, (row_number() OVER (PARTITION BY project_id ORDER BY seq) - 1) // 5 AS batch FROM (SELECT DISTINCT * FROM api_calls) WHERE project_id IS NOT NULL",
    "gr3_reach": f"""WITH RECURSIVE n AS (SELECT DISTINCT project_id || '/' || array_to_string(xs[1:i], '/') AS path FROM (SELECT project_id, string_split(file_path, '/') AS xs FROM {_S} WHERE project_id IS NOT NULL AND file_path IS NOT NULL), LATERAL (SELECT unnest(range(1, len(xs) + 1)) AS i)),
        e AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS src, path AS dst FROM n), r AS (SELECT DISTINCT string_split(path, '/')[1] AS seed, string_split(path, '/')[1] AS node, 0 AS depth FROM n
        UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL""",
    "gr4_descendants": f"""WITH p AS (SELECT project_id, string_split(file_path, '/') AS xs FROM {_S} WHERE project_id IS NOT NULL AND file_path IS NOT NULL)
        SELECT project_id, array_to_string(xs[1:i], '/') AS path, count(*) AS n_files FROM p, LATERAL (SELECT unnest(range(1, len(xs) + 1)) AS i) GROUP BY ALL""",
    "va1_documents": f"""SELECT record_id, array_to_string([v FOR v IN [CASE WHEN project_id IS NULL THEN 'project_id' END, CASE WHEN file_path IS NULL THEN 'file_path' END, CASE WHEN version IS NULL THEN 'version' END,
        CASE WHEN language IS NULL THEN 'language' END, CASE WHEN len([c FOR c IN classes IF c IS NOT NULL AND c.name IS NULL]) > 0 THEN 'classes.name' END,
        CASE WHEN len([f FOR f IN functions IF f IS NOT NULL AND f.name IS NULL]) > 0 THEN 'functions.name' END,
        CASE WHEN len([m FOR m IN flatten([c.methods FOR c IN classes IF c.methods IS NOT NULL]) IF m.type IS NOT NULL AND m.type NOT IN ('instance', 'class', 'static')]) > 0 THEN 'methods.type' END] IF v IS NOT NULL], ',') AS violations FROM {_D}""",
    "va5_summaries": f"""SELECT record_id, array_to_string([v FOR v IN [CASE WHEN len([w FOR w IN regexp_split_to_array(trim(summary), '\\s+') IF w <> '']) < 3 THEN 'words' END, CASE WHEN NOT regexp_matches(summary, '^[A-Z]') THEN 'capital' END,
        CASE WHEN NOT regexp_matches(summary, '[.?!]\\s*$') THEN 'stop' END, CASE WHEN length(summary) < 10 THEN 'length' END] IF v IS NOT NULL], ',') AS violations FROM {_D} WHERE summary IS NOT NULL""",
    **_DECLARED,
    "ex11_names": f"SELECT name, name IN ('BaseException', 'BaseExceptionGroup', 'Exception', 'ExceptionGroup', 'GeneratorExit', 'KeyboardInterrupt', 'StopAsyncIteration', 'StopIteration', 'SystemExit', 'Warning') OR regexp_matches(name, '^[A-Z][a-zA-Z0-9]*(Error|Exception|Warning)$') AS ok, count(*) AS n FROM ({_DECLARED['ex1_python']}) WHERE kind = 'raises' GROUP BY ALL",
    "gr1_names": rf"""WITH f AS (SELECT file_id, string_split(regexp_replace(replace(code, chr(13), ''), '{_HIDE["python"]}', ' ', 'g'), chr(10)) AS ls FROM {_S} WHERE code IS NOT NULL AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) = 'py'),
        l AS (SELECT file_id, ltrim(unnest(ls), E' 	') AS x FROM f),
        n AS (SELECT DISTINCT file_id, split_part(split_part(trim(unnest(string_split(regexp_replace(x, '^import\s+', ''), ','))), ' ', 1), ';', 1) AS name FROM l WHERE regexp_matches(x, '^import[ 	]')),
        w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(x, '\.?[A-Za-z_][A-Za-z0-9_]*')) AS name FROM l WHERE NOT regexp_matches(x, '^(import|from)[ 	]'))
        SELECT n.file_id, n.name, w.name IS NOT NULL AS used FROM n LEFT JOIN w ON w.file_id = n.file_id AND w.name = n.name WHERE n.name <> ''""",
    "ud1_structure": f"SELECT language, kind, count(*) AS n, count(DISTINCT name) AS n_names FROM ({_ALL}) GROUP BY ALL",
    "ex3_script_metrics": rf"""WITH f AS (SELECT file_id, regexp_replace(replace(code, chr(13), ''), '{_HIDE["script"]}', ' ', 'g') AS c FROM {_S} WHERE code IS NOT NULL AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) IN ('js', 'mjs')),
        t AS (SELECT file_id, len([x FOR x IN string_split(c, chr(10)) IF trim(x) <> ''])::INT AS sloc, regexp_extract_all(c, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|===|!==|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^!~<>=?:.,;(){{}}\[\]]') AS ts FROM f),
        k AS (SELECT file_id, sloc, [x FOR x IN ts IF regexp_matches(x, '^[A-Za-z0-9_$]') AND x NOT IN ({_WORDS})] AS b, [x FOR x IN ts IF NOT (regexp_matches(x, '^[A-Za-z0-9_$]') AND x NOT IN ({_WORDS})) AND x NOT IN (')', ']', '}}')] AS a,
            len([x FOR x IN ts IF x IN ('if', 'for', 'while', 'case', 'catch', '?', '&&', '||', '??')]) + 1 AS cc FROM t),
        m AS (SELECT file_id, sloc, len(a) + len(b) AS n, CASE WHEN len(a) + len(b) > 0 THEN cc ELSE 0 END AS cc, CASE WHEN len(a) + len(b) > 0 THEN (len(a) + len(b)) * log2(len(list_distinct(a)) + len(list_distinct(b))) ELSE 0.0 END AS v,
            CASE WHEN len(b) > 0 THEN len(list_distinct(a)) / 2.0 * len(b) / len(list_distinct(b)) ELSE 0.0 END AS d FROM k)
        SELECT file_id, sloc, cc::INT AS complexity, round(v, 4) AS volume, round(d, 4) AS difficulty, round(v * d, 3) AS effort,
            CASE WHEN n > 0 THEN round(greatest(0.0, (171 - 5.2 * ln(greatest(v, 1.0)) - 0.23 * cc - 16.2 * ln(greatest(sloc, 1)::DOUBLE)) * 100 / 171), 4) ELSE 0.0 END AS maintainability FROM m""",
    "in2_comments": rf"""WITH g AS (SELECT file_id, string_split(replace(code, chr(13), ''), chr(10)) AS ls FROM {_S} WHERE code IS NOT NULL AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) = 'go'),
        n AS (SELECT file_id, ls, [regexp_extract(x, '^func ([A-Za-z_][A-Za-z0-9_]*)\(', 1) FOR x IN ls IF regexp_matches(x, '^func [A-Za-z_][A-Za-z0-9_]*\(')][1] AS name FROM g)
        SELECT file_id, md5(array_to_string(CASE WHEN name IS NULL THEN ls ELSE [CASE WHEN regexp_matches(x, '^[ \t]*(func|type)\s+(\([^()]*\)\s*)?' || name || '([^A-Za-z0-9_$]|$)') THEN regexp_extract(x, '^([ \t]*)', 1) || '// ' || name || ' costs $1.' || chr(10) || x ELSE x END FOR x IN ls] END, chr(10))) AS code_md5 FROM n""",
    "in1_docstrings": rf"""WITH p AS (SELECT file_id, replace(code, chr(13), '') AS code FROM {_S} WHERE code IS NOT NULL AND lower(regexp_extract(file_path, '\.([^./]+)$', 1)) = 'py'),
        n AS (SELECT file_id, code, nullif(regexp_extract(code, '(?m)^(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS name FROM p)
        SELECT file_id, CASE WHEN name IS NULL THEN 0 ELSE len([x FOR x IN regexp_extract_all(code, '(?m)^[ \t]*(?:async )?(?:def|class) +' || name || '(?:\[[^\[\]]*\])?(?:\((?:[^()]|\([^()]*\))*\))?[^:\n]*:[ \t]*(?:#[^\n]*)?\n[ \t]*[^\n]{{0,4}}') IF NOT regexp_matches(x, '\n[ \t]*[rRuU]?("{{3}}|''{{3}})[^\n]{{0,3}}$')]) END::INT AS n_put, md5(code) AS rest_md5 FROM n""",
}
