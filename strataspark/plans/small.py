"""Queries of the smaller filters, projections, joins and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import report
from ..functions import text as T
from ..operators import extract, joins, validate
from ..sources import files as trees
from ..sources.shared import scratch
from ..sources.tables import load
from .metrics import calls, records
from .store import files, pj5_metric_cards

IGNORED = ["build/", "*.json", "!deploy/*.json", "src/core/**", "tests/[a-m]*.py", "vendor", "**/gen/*"]


def _suffixed(spark, root, *suffixes):
    return files(spark, root).where("code is not null").where(F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).isin(*suffixes))


def fl5_ignored(spark, root):
    """Paths that an ignore file with folders, globs and negations keeps."""
    return files(spark, root).where("file_path is not null").where(~trees.ignored(F.col("file_path"), IGNORED)).select("file_id", "file_path")


def fl9_not_empty(spark, root):
    return load(spark, root, "documents").where(F.col("text").rlike(r"\S")).select("doc_id")


def fl11_kept_results(spark, root):
    return calls(spark, root).where("success and tokens > 0").select("seq", "tokens")


def fl13_suffixes(spark, root):
    p = F.lower("file_path")
    return files(spark, root).select("file_id", p.rlike(r"\.(ts|tsx)$").alias("is_typescript"), p.rlike(r"\.(jsx|tsx)$").alias("is_react"))


def fl14_comments(spark, root):
    """Comment lines that are no part of a doc block, and the lines of the first doc block without its marks."""
    f = _suffixed(spark, root, "js", "mjs", "ts")
    lines = F.transform(F.filter(F.split(F.replace("code", F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x).startswith("//") | F.trim(x).startswith("*")), lambda x: F.trim(x))
    block = F.regexp_extract(F.replace("code", F.lit("\r"), F.lit("")), r"(?s)(/\*\*.*?\*/)", 1)
    return f.select("file_id", F.size(F.filter(lines, lambda x: ~x.startswith("*"))).alias("n_plain"), F.when(block != "", F.md5(F.array_join(T.comment_lines(block), "|"))).alias("block_md5"))


def pj1_dropped(spark, root):
    return load(spark, root, "documents").drop("text", "n_chars", "updated_at")


def pj3_merged(spark, root):
    """Defaults and measured values of a record as one map, the measured ones win."""
    m = F.col("metrics")
    left = F.create_map(F.lit("complexity"), F.lit(0.0), F.lit("maintainability_index"), F.lit(100.0), F.lit("coverage"), F.lit(0.0))
    right = F.map_filter(F.create_map(F.lit("complexity"), m["complexity"], F.lit("maintainability_index"), m["maintainability_index"], F.lit("volume"), m["halstead"]["volume"]), lambda k, v: v.isNotNull())
    return records(spark, root).select("record_id", F.explode(joins.merged(left, right)).alias("key", "value"))


def jn3_every_match(spark, root):
    """Every documented function of a project whose name is that of a Go function, in any spelling."""
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
    go = _suffixed(spark, root, "go")
    decl = extract.declarations(go, "go").where("kind = 'function'").join(go.select("file_id", "project_id"), "file_id").select("file_id", "pos", "project_id", plain(F.col("name")).alias("key"))
    f = records(spark, root).select("record_id", "project_id", F.posexplode("functions").alias("doc_pos", "f")).where("f.name is not null")
    return joins.every_match(decl, f.select("record_id", "doc_pos", "project_id", plain(F.col("f.name")).alias("key")), ["project_id", "key"]).select("file_id", "pos", "record_id", "doc_pos")


def _probed(last):
    """Go functions beside the last or the first documented function of their project and name."""

    def query(spark, root):
        plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
        go = _suffixed(spark, root, "go")
        decl = extract.declarations(go, "go").where("kind = 'function'").join(go.select("file_id", "project_id"), "file_id").select("file_id", "pos", "project_id", plain(F.col("name")).alias("key"))
        f = records(spark, root).select("record_id", "project_id", F.posexplode("functions").alias("doc_pos", "f")).where("f.name is not null")
        docs = f.select("project_id", plain(F.col("f.name")).alias("key"), (F.col("record_id") * 1000 + F.col("doc_pos")).alias("place"))
        one = joins.last_by(docs.withColumn("at", F.col("place")), ["project_id", "key"], "place") if last else joins.first_by(docs.withColumn("at", F.col("place")), ["project_id", "key"], "place")
        return decl.join(one, ["project_id", "key"], "left").select("file_id", "pos", F.col("at").alias("place"))

    return query


def so2_newest(spark, root):
    """The 1,000 newest records of the whole store."""
    return records(spark, root).orderBy(F.desc_nulls_last("last_updated"), F.desc("record_id")).limit(1000).select("record_id")


def so3_kept(spark, root):
    """What a cache of 100 entries holds that drops the oldest first."""
    return calls(spark, root).orderBy(F.desc("seq")).limit(100).select("seq")


def so5_first_match(spark, root):
    size = F.col("p_size")
    return load(spark, root, "part").select("p_partkey", joins.first_match([(size > 40, F.lit("large")), (size > 15, F.lit("middle")), (F.col("p_brand") == "Brand#11", F.lit("small own"))], F.lit("small")).alias("class"))


def pj2_mapped_classes(spark, root):
    c = records(spark, root).select("record_id", F.posexplode("classes").alias("pos", "c")).where("c is not null")
    return c.select("record_id", "pos", F.coalesce("c.name", F.lit("anonymous")).alias("name"), F.coalesce(F.size("c.methods"), F.lit(0)).alias("n_methods"), F.coalesce("c.superclass", F.lit("object")).alias("superclass"))


def fl12_constants(spark, root):
    """Names that Python modules assign on their first level, parted by their spelling."""
    py = _suffixed(spark, root, "py").select("file_id", extract.bare(F.col("code"), "python").alias("c"))
    n = py.select("file_id", F.posexplode(F.regexp_extract_all("c", F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_]*)[ \t]*=(?!=)"), F.lit(1))).alias("pos", "name"))
    return n.select("file_id", "pos", "name", ((F.upper("name") == F.col("name")) & F.col("name").rlike("[A-Z]")).alias("is_constant"))


def fl16_language(spark, root):
    """Files of one language, by any of its names."""
    names = load(spark, root, "language_aliases").where("language = 'python'").select(F.col("alias").alias("l"))
    f = files(spark, root).select("file_id", F.lower(F.trim("language")).alias("l"))
    return f.join(names, "l", "left_semi").select("file_id")


def jn6_two_level(spark, root):
    """Methods of a record found again in another record of the project: first the class, then the method."""
    c = records(spark, root).where("project_id is not null").select("record_id", "project_id", F.explode("classes").alias("c")).where("c.name is not null")
    m = c.select("record_id", "project_id", F.col("c.name").alias("class"), F.explode("c.methods").alias("m")).where("m.name is not null").select("record_id", "project_id", "class", F.col("m.name").alias("method"), F.col("m.complexity").alias("complexity"))
    new = m.groupBy("project_id", "class", "method").agg(F.max("record_id").alias("last_record"))
    old = m.groupBy("project_id", "class", "method").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n"))
    return joins.two_level(old, new.where("last_record % 2 = 0"), ["project_id"], "class", "method")


def jn14_first_of_tag(spark, root):
    """Each tag of a page beside the first page that has it."""
    s = _suffixed(spark, root, "html", "htm")
    tags = s.select("file_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("code", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower))).alias("tag"))
    return joins.looked_up(tags, tags.withColumnRenamed("file_id", "first_file"), "tag", "first_file", "first_file", F.lit(-1))


def jn15_language_info(spark, root):
    """The language that an alias stands for; what no alias is known for stands for itself."""
    f = files(spark, root).select("file_id", F.lower(F.trim("language")).alias("alias"))
    return joins.looked_up(f, load(spark, root, "language_aliases"), "alias", "language", "language", F.col("alias"))


def so4_first_args(spark, root):
    """The first three arguments, and dots where there are more."""
    f = records(spark, root).select("record_id", F.posexplode("functions").alias("pos", "f")).where("f.args is not null")
    a = F.array_compact(F.col("f.args"))
    return f.select("record_id", "pos", F.concat(F.array_join(F.slice(a, 1, 3), ", "), F.when(F.size(a) > 3, ", ...").otherwise("")).alias("args"))


def so7_indented(spark, root):
    return records(spark, root).select("record_id", F.md5(trees.sorted_json(["file_path", "language", "project_id", "version"])).alias("json_md5"))


def st2_bag(spark, root):
    """Names of functions and of methods, one bag."""
    r = records(spark, root)
    a = r.select(F.explode("functions").alias("f")).select(F.col("f.name").alias("name"))
    b = r.select(F.explode("classes").alias("c")).select(F.explode("c.methods").alias("m")).select(F.col("m.name").alias("name"))
    return a.unionAll(b).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))


def sf25_comment_text(spark, root):
    c = _suffixed(spark, root, "cpp", "cc", "h", "hpp").select("file_id", F.posexplode(F.regexp_extract_all(F.replace("code", F.lit("\r"), F.lit("")), F.lit(r"(?m)^[ \t]*//[^\n]*"), F.lit(0))).alias("pos", "line"))
    return c.select("file_id", "pos", F.md5(T.comment_text(F.col("line"))).alias("text_md5"))


def sf26_field_types(spark, root):
    """Fields of Go structs: name and type, as it is printed."""
    c = _suffixed(spark, root, "go").select("file_id", F.posexplode(F.regexp_extract_all(F.replace("code", F.lit("\r"), F.lit("")), F.lit(r"(?m)^\t[A-Z][A-Za-z0-9]* [^\n`]+ `"), F.lit(0))).alias("pos", "line"))
    parts = c.select("file_id", "pos", F.regexp_extract("line", r"^\t([A-Za-z0-9]+) ", 1).alias("name"), F.trim(F.regexp_extract("line", r"^\t[A-Za-z0-9]+ (.*) `$", 1)).alias("kind"))
    return parts.select("file_id", "pos", "name", T.go_type(F.col("kind")).alias("type"))


def sf27_rendered(spark, root):
    values = {"name": F.regexp_extract("file_path", r"([^/]*)$", 1), "language": F.col("language"), "summary": F.col("summary"), "version": F.col("version")}
    page = report.render("# {{ name|escape }}\n\n{{ language|upper }} {{ version }}\n\n{{ summary|first }}", values, {"first": lambda c: F.substring(c, 1, 20)})
    return records(spark, root).select("record_id", F.md5(page).alias("page_md5"))


def va2_functions(spark, root):
    """What the functions of service answers lack of their schema."""
    r = load(spark, root, "doc_responses").dropDuplicates(["response_id"]).select("response_id", F.try_parse_json("payload").alias("v"))
    f = r.select("response_id", F.posexplode(F.try_variant_get("v", "$.functions", "array<variant>")).alias("pos", "f")).where("f is not null")
    return f.select("response_id", "pos", F.array_join(F.transform(validate.shape_errors(F.col("f"), validate.FUNCTION_SCHEMA), lambda e: F.concat_ws(":", e["path"], e["message"])), ",").alias("errors"))


def va8_metrics(spark, root):
    """What the payloads of structure records lack of the shape of metrics."""
    r = load(spark, root, "structure_records").dropDuplicates(["record_id"]).select("record_id", F.try_parse_json("payload").alias("v")).where("v is not null")
    return r.select("record_id", F.array_join(F.transform(validate.shape_errors(F.col("v"), validate.METRICS_SHAPE), lambda e: F.concat_ws(":", e["path"], e["message"])), ",").alias("errors"))


def fl_visible(spark, root):
    """FL1-FL5 through their operator: folders, suffixes and an ignore pattern."""
    return files(spark, root).where(trees.visible(F.col("file_path"), ("node_modules", "vendor", "third_party", "build"), (".json", ".yml", ".yaml"), ("src/core/",))).select("file_id", "file_path")


def sk2_written_pages(spark, root):
    """Pages written as text, a folder for each project, and read back line by line."""
    place = scratch(spark, "pages")
    page = F.concat_ws("\n\n", F.concat(F.lit("# "), F.regexp_extract("file_path", r"([^/]*)$", 1)), F.col("summary"))
    trees.write_pages(records(spark, root).where("project_id is not null and file_path is not null").select("project_id", page.alias("page")), "project_id", "page", place)
    return spark.read.schema("value string, project_id string").text(place).groupBy("project_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("value").startswith("# ")).alias("n_pages"))


def tr3_gate(spark, root):
    """Calls that come with no quota left in the minute of their provider, and how long they wait for the next."""
    c = calls(spark, root).where("provider is not null and called_at is not null").select("seq", "provider", F.unix_micros("called_at").alias("us"))
    minute = F.floor(F.col("us") / 60_000_000)
    nth = F.row_number().over(Window.partitionBy("provider", minute).orderBy("us", "seq"))
    return c.withColumn("nth", nth).where("nth > 1").select("seq", ((minute + 1) * 60_000_000 - F.col("us")).alias("wait_us"))


def pj5_status(spark, root):
    """Metrics of a record, one to a row, beside the threshold of each and what it says."""
    limits = F.create_map(*[F.lit(x) for pair in (("maintainability_index", 85.0), ("complexity", 15.0), ("volume", 1000.0), ("difficulty", 10.0), ("effort", 1000.0)) for x in pair])
    long = pj5_metric_cards(spark, root).withColumn("threshold", limits[F.col("metric")])
    return long.select("record_id", "metric", "threshold", T.metric_status(F.col("value"), F.col("threshold")).alias("status"))


def va1_messages(spark, root):
    """Every violation of a record as path and message."""
    v = validate.document_violations(records(spark, root)).select("record_id", F.explode("violations").alias("path"))
    return v.select("record_id", "path", F.when(F.col("path") == "methods.type", "must be one of instance, class, static").otherwise("is required").alias("message"))


QUERIES = {
    f.__name__: f
    for f in (
        so2_newest, so3_kept, so5_first_match, pj2_mapped_classes, fl12_constants, fl16_language, fl_visible, sk2_written_pages, tr3_gate, pj5_status, va1_messages, fl5_ignored, fl9_not_empty, fl11_kept_results, fl13_suffixes, fl14_comments, pj1_dropped, pj3_merged, jn3_every_match, jn6_two_level, jn14_first_of_tag, jn15_language_info, so4_first_args, so7_indented,
        st2_bag, sf25_comment_text, sf26_field_types, sf27_rendered, va2_functions, va8_metrics,
    )
} | {"jn1_probed": _probed(True), "jn2_probed": _probed(False)}

_C = "(SELECT DISTINCT * FROM api_calls)"
_D = "(SELECT * FROM documentation QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_S = "(SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id) = 1)"
_P = "(SELECT response_id, payload FROM doc_responses WHERE json_valid(payload) QUALIFY row_number() OVER (PARTITION BY response_id) = 1)"


def _of(*suffixes: str) -> str:
    named = ", ".join(f"'{s}'" for s in suffixes)
    return f"(SELECT file_id, project_id, replace(code, chr(13), '') AS code FROM {_S} WHERE code IS NOT NULL AND lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) IN ({named}))"


def _shape(value: str, fields: dict[str, str]) -> str:
    checks = ", ".join(f"CASE WHEN json_type({value}, '$.{f}') IS NULL OR json_type({value}, '$.{f}') = 'NULL' AND FALSE THEN '{f}:required' WHEN json_type({value}, '$.{f}') NOT IN ({kinds}) THEN '{f}:type' END" for f, kinds in fields.items())
    return f"array_to_string([x FOR x IN [{checks}] IF x IS NOT NULL], ',')"


def _probed_sql(which: str) -> str:
    return rf"""WITH g AS {_of('go')}, x AS (SELECT file_id, project_id, regexp_extract_all(regexp_replace(code, '"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`[^`]*`|//[^\n]*|(?s:/\*.*?\*/)', ' ', 'g'), '\bfunc\s+(?:\([^()]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS xs FROM g),
        d AS (SELECT file_id, project_id, unnest(range(len(xs)))::INT AS pos, lower(replace(unnest(xs), '_', '')) AS key FROM x),
        f AS (SELECT project_id, lower(replace(functions[i].name, '_', '')) AS key, {which}(record_id * 1000 + i - 1)::BIGINT AS place FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i) WHERE functions[i].name IS NOT NULL GROUP BY ALL)
        SELECT file_id, pos, place FROM d LEFT JOIN f USING (project_id, key)"""


ORACLES = {
    "jn1_probed": _probed_sql("max"),
    "jn2_probed": _probed_sql("min"),
    "so2_newest": f"SELECT record_id FROM {_D} ORDER BY last_updated DESC NULLS LAST, record_id DESC LIMIT 1000",
    "so3_kept": f"SELECT seq FROM {_C} ORDER BY seq DESC LIMIT 100",
    "so5_first_match": "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 15 THEN 'middle' WHEN p_brand = 'Brand#11' THEN 'small own' ELSE 'small' END AS class FROM part",
    "pj2_mapped_classes": f"""WITH c AS (SELECT record_id, (i - 1)::INT AS pos, classes[i] AS c FROM {_D}, LATERAL (SELECT unnest(range(1, len(classes) + 1)) AS i))
        SELECT record_id, pos, coalesce(c.name, 'anonymous') AS name, coalesce(len(c.methods), 0)::INT AS n_methods, coalesce(c.superclass, 'object') AS superclass FROM c WHERE c IS NOT NULL""",
    "fl12_constants": rf"""WITH p AS {_of('py')}, l AS (SELECT file_id, string_split(regexp_replace(code, '(?s:"{{3}}.*?"{{3}})|(?s:''{{3}}.*?''{{3}})|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|#[^\n]*', ' ', 'g'), chr(10)) AS ls FROM p),
        n AS (SELECT file_id, unnest(range(len(ls))) AS i, regexp_extract(unnest(ls), '^([A-Za-z_][A-Za-z0-9_]*)[ \t]*=([^=]|$)', 1) AS name FROM l)
        SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY i) - 1)::INT AS pos, name, upper(name) = name AND regexp_matches(name, '[A-Z]') AS is_constant FROM n WHERE name <> ''""",
    "fl16_language": f"SELECT file_id FROM {_S} s WHERE EXISTS (SELECT 1 FROM language_aliases a WHERE a.alias = lower(trim(s.language)) AND a.language = 'python')",
    "fl_visible": f"""SELECT file_id, file_path FROM {_S} WHERE NOT regexp_matches(file_path, '(^|/)\\.') AND NOT regexp_matches(file_path, '(^|/)(node_modules|vendor|third_party|build)(/|$)')
        AND lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) NOT IN ('.json', '.yml', '.yaml') AND NOT starts_with(file_path, 'src/core/')""",
    "sk2_written_pages": f"""WITH p AS (SELECT project_id, concat_ws(chr(10) || chr(10), '# ' || regexp_extract(file_path, '([^/]*)$', 1), summary) AS page FROM {_D} WHERE project_id IS NOT NULL AND file_path IS NOT NULL),
        l AS (SELECT project_id, unnest(string_split(page, chr(10))) AS x FROM p) SELECT project_id, count(*) AS n_lines, count(*) FILTER (starts_with(x, '# ')) AS n_pages FROM l GROUP BY project_id""",
    "tr3_gate": f"""WITH c AS (SELECT seq, provider, epoch_us(called_at) AS us FROM {_C} WHERE provider IS NOT NULL AND called_at IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY provider, us // 60000000 ORDER BY us, seq) AS nth FROM c)
        SELECT seq, ((us // 60000000 + 1) * 60000000 - us)::BIGINT AS wait_us FROM n WHERE nth > 1""",
    "pj5_status": f"""WITH u AS (UNPIVOT (SELECT record_id, metrics.maintainability_index AS maintainability_index, metrics.complexity AS complexity, metrics.halstead.volume AS volume, metrics.halstead.difficulty AS difficulty, metrics.halstead.effort AS effort FROM {_D})
        ON maintainability_index, complexity, volume, difficulty, effort INTO NAME metric VALUE value), t AS (SELECT *, CASE metric WHEN 'maintainability_index' THEN 85.0 WHEN 'complexity' THEN 15.0 WHEN 'difficulty' THEN 10.0 ELSE 1000.0 END::DOUBLE AS threshold FROM u)
        SELECT record_id, metric, threshold, CASE WHEN value >= 1.2 * threshold THEN 'red' WHEN value >= threshold THEN 'yellow' ELSE 'green' END AS status FROM t""",
    "va1_messages": f"""SELECT record_id, path, CASE WHEN path = 'methods.type' THEN 'must be one of instance, class, static' ELSE 'is required' END AS message FROM (SELECT record_id, unnest([v FOR v IN [CASE WHEN project_id IS NULL THEN 'project_id' END,
        CASE WHEN file_path IS NULL THEN 'file_path' END, CASE WHEN version IS NULL THEN 'version' END, CASE WHEN language IS NULL THEN 'language' END, CASE WHEN len([c FOR c IN classes IF c IS NOT NULL AND c.name IS NULL]) > 0 THEN 'classes.name' END,
        CASE WHEN len([f FOR f IN functions IF f IS NOT NULL AND f.name IS NULL]) > 0 THEN 'functions.name' END,
        CASE WHEN len([m FOR m IN flatten([c.methods FOR c IN classes IF c.methods IS NOT NULL]) IF m.type IS NOT NULL AND m.type NOT IN ('instance', 'class', 'static')]) > 0 THEN 'methods.type' END] IF v IS NOT NULL]) AS path FROM {_D})""",
    "fl5_ignored": f"""SELECT file_id, file_path FROM {_S} WHERE file_path IS NOT NULL AND NOT (
        (regexp_matches('/' || file_path, '/build/.') AND NOT regexp_matches(file_path, '^deploy/[^/]*\\.json$')) OR (regexp_matches(file_path, '\\.json(/|$)') AND NOT regexp_matches(file_path, '^deploy/[^/]*\\.json(/|$)'))
        OR starts_with(file_path, 'src/core/') OR regexp_matches(file_path, '^tests/[a-m][^/]*\\.py(/|$)') OR list_contains(string_split(file_path, '/'), 'vendor') OR regexp_matches('/' || file_path, '/gen/.'))""",
    "fl9_not_empty": "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) > 0",
    "fl11_kept_results": f"SELECT seq, tokens FROM {_C} WHERE success AND tokens > 0",
    "fl13_suffixes": f"SELECT file_id, list_contains(['ts', 'tsx'], string_split(lower(file_path), '.')[-1]) AS is_typescript, list_contains(['jsx', 'tsx'], string_split(lower(file_path), '.')[-1]) AS is_react FROM {_S}",
    "fl14_comments": rf"""WITH f AS {_of('js', 'mjs', 'ts')}, b AS (SELECT file_id, code, strpos(code, '/**') AS i FROM f), e AS (SELECT *, CASE WHEN i > 0 THEN strpos(code[i + 3:], '*/') ELSE 0 END AS j FROM b),
        t AS (SELECT file_id, code, CASE WHEN j > 0 THEN code[i + 3:i + j + 1] END AS body FROM e)
        SELECT file_id, len([x FOR x IN string_split(code, chr(10)) IF starts_with(ltrim(x, ' '), '//')])::INT AS n_plain,
            md5(array_to_string([regexp_replace(x, '^[ \t]*\* ?', '') FOR x IN string_split(regexp_replace(regexp_replace(body, '^[ \t]*\n?', ''), '\n?[ \t]*$', ''), chr(10))], '|')) AS block_md5 FROM t""",
    "pj1_dropped": "SELECT * EXCLUDE (text, n_chars, updated_at) FROM documents",
    "pj3_merged": f"""WITH d AS (SELECT record_id, metrics.complexity AS c, metrics.maintainability_index AS m, metrics.halstead.volume AS v FROM {_D})
        SELECT record_id, 'complexity' AS key, coalesce(c, 0.0) AS value FROM d UNION ALL SELECT record_id, 'maintainability_index', coalesce(m, 100.0) FROM d UNION ALL SELECT record_id, 'coverage', 0.0 FROM d
        UNION ALL SELECT record_id, 'volume', v FROM d WHERE v IS NOT NULL""",
    "jn3_every_match": rf"""WITH g AS {_of('go')}, x AS (SELECT file_id, project_id, regexp_extract_all(code, '\bfunc\s+(?:\([^()]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\(', 1) AS xs FROM g),
        d AS (SELECT file_id, project_id, unnest(range(len(xs)))::INT AS pos, lower(replace(unnest(xs), '_', '')) AS key FROM x),
        f AS (SELECT record_id, project_id, (i - 1)::INT AS doc_pos, lower(replace(functions[i].name, '_', '')) AS key FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i) WHERE functions[i].name IS NOT NULL)
        SELECT file_id, pos, record_id, doc_pos FROM d JOIN f USING (project_id, key)""",
    "jn6_two_level": f"""WITH c AS (SELECT record_id, project_id, unnest(classes) AS c FROM {_D} WHERE project_id IS NOT NULL), m AS (SELECT record_id, project_id, c.name AS class, unnest(c.methods) AS m FROM c WHERE c.name IS NOT NULL),
        g AS (SELECT project_id, class, m.name AS method, min(record_id) AS record_id, max(record_id) AS last_record, count(*) AS n FROM m WHERE m.name IS NOT NULL GROUP BY ALL)
        SELECT project_id, class, method, record_id, n, CASE WHEN last_record % 2 = 0 THEN last_record END AS last_record, last_record % 2 = 0 AS matched FROM g
        WHERE (project_id, class) IN (SELECT (project_id, class) FROM g WHERE last_record % 2 = 0)""",
    "jn14_first_of_tag": f"""WITH t AS (SELECT DISTINCT file_id, lower(unnest(regexp_extract_all(code, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM {_of('html', 'htm')}) SELECT file_id, tag, min(file_id) OVER (PARTITION BY tag) AS first_file FROM t""",
    "jn15_language_info": f"""SELECT file_id, lower(trim(s.language)) AS alias, coalesce((SELECT min(a.language) FROM language_aliases a WHERE a.alias = lower(trim(s.language))), lower(trim(s.language))) AS language FROM {_S} s""",
    "so4_first_args": f"""WITH e AS (SELECT record_id, (i - 1)::INT AS pos, [a FOR a IN functions[i].args IF a IS NOT NULL] AS a FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i) WHERE functions[i].args IS NOT NULL)
        SELECT record_id, pos, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ', ...' ELSE '' END AS args FROM e""",
    "so7_indented": f"""WITH p AS (SELECT record_id, [k || to_json(v) FOR k, v IN [1]] AS x FROM {_D}) SELECT record_id, md5('{{' || chr(10) || array_to_string([x FOR x IN ['  "file_path" : ' || to_json(file_path), '  "language" : ' || to_json(language), '  "project_id" : ' || to_json(project_id), '  "version" : ' || to_json(version)] IF x IS NOT NULL AND x NOT LIKE '%: null'], ',' || chr(10)) || chr(10) || '}}') AS json_md5 FROM {_D}""".replace("WITH p AS (SELECT record_id, [k || to_json(v) FOR k, v IN [1]] AS x FROM " + _D + ") ", ""),
    "st2_bag": f"""WITH n AS (SELECT unnest(functions).name AS name FROM {_D} UNION ALL SELECT unnest(c.methods).name FROM (SELECT unnest(classes) AS c FROM {_D})) SELECT name, count(*) AS n FROM n WHERE name IS NOT NULL GROUP BY name""",
    "sf25_comment_text": f"""WITH l AS (SELECT file_id, x, i FROM (SELECT file_id, string_split(code, chr(10)) AS xs FROM {_of('cpp', 'cc', 'h', 'hpp')}), LATERAL (SELECT unnest(xs) AS x, unnest(range(len(xs))) AS i) WHERE starts_with(ltrim(x, E' \\t'), '//'))
        SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY i) - 1)::INT AS pos, md5(ltrim(CASE WHEN starts_with(ltrim(x, E' \\t'), '///') THEN ltrim(x, E' \\t')[4:] ELSE ltrim(x, E' \\t')[3:] END, E' \\t')) AS text_md5 FROM l""",
    "sf26_field_types": f"""WITH l AS (SELECT file_id, x, i FROM (SELECT file_id, string_split(code, chr(10)) AS xs FROM {_of('go')}), LATERAL (SELECT unnest(xs) AS x, unnest(range(len(xs))) AS i) WHERE regexp_matches(x, '^\\t[A-Z][A-Za-z0-9]* [^`]+ `')),
        p AS (SELECT file_id, i, ltrim(x, E'\\t')[:strpos(ltrim(x, E'\\t'), ' ') - 1] AS name, trim(string_split(ltrim(x, E'\\t')[strpos(ltrim(x, E'\\t'), ' ') + 1:], ' `')[1]) AS kind FROM l)
        SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY i) - 1)::INT AS pos, name, CASE WHEN regexp_full_match(kind, '(\\*|\\[\\])*[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)?') THEN kind ELSE 'unknown' END AS type FROM p""",
    "sf27_rendered": rf"""SELECT record_id, md5('# ' || coalesce(trim(regexp_replace(replace(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '([`*_{{}}\[$()#+\-.!|])', '\\\1', 'g'), chr(13), ''), '[ \t\n]+', ' ', 'g')), '') || chr(10) || chr(10)
        || coalesce(upper(language), '') || ' ' || coalesce(version, '') || chr(10) || chr(10) || coalesce(summary[:20], '')) AS page_md5 FROM {_D}""",
    "va2_functions": "WITH f AS (SELECT response_id, i::INT AS pos, payload->'$.functions'->i::INT AS f FROM " + _P + """, LATERAL (SELECT unnest(range(json_array_length(payload, '$.functions')::BIGINT)) AS i) WHERE json_type(payload, '$.functions') = 'ARRAY')
        SELECT response_id, pos, """ + _shape("f", {"name": "'VARCHAR'", "docstring": "'VARCHAR'", "args": "'ARRAY'", "async": "'BOOLEAN'"}) + " AS errors FROM f WHERE f IS NOT NULL AND json_type(f) <> 'NULL'",
    "va8_metrics": "WITH f AS (SELECT record_id, payload AS f FROM structure_records WHERE json_valid(payload) QUALIFY row_number() OVER (PARTITION BY record_id) = 1) SELECT record_id, "
    + _shape("f", {"complexity": "'BIGINT', 'UBIGINT', 'DOUBLE'", "maintainability_index": "'BIGINT', 'UBIGINT', 'DOUBLE'", "halstead": "'OBJECT'"}) + " AS errors FROM f",
}
