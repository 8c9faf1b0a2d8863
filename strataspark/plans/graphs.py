"""Queries of the context graph, its maintenance and its caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, store
from ..sources.tables import load
from .metrics import records
from .store import files


def _tree(spark, root):
    """Regions, nations, customers and orders as one tree: its nodes, and its edges in the order of keys."""
    r, n, c, o = (load(spark, root, t) for t in ("region", "nation", "customer", "orders"))

    def node(letter, key):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    nodes = (
        r.select(node("r", "r_regionkey").alias("node"), F.lit("main").alias("language"), F.lit(1).alias("tokens"))
        .unionByName(n.select(node("n", "n_nationkey").alias("node"), F.lit("main").alias("language"), F.length("n_name").alias("tokens")))
        .unionByName(c.select(node("c", "c_custkey").alias("node"), F.when(F.col("c_mktsegment") == "BUILDING", "other").otherwise("main").alias("language"), (F.col("c_custkey") % 61).cast("int").alias("tokens")))
        .unionByName(o.select(node("o", "o_orderkey").alias("node"), F.lit("main").alias("language"), (F.col("o_orderkey") % 997).cast("int").alias("tokens")))
    )
    edges = (
        n.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("bigint").alias("pos"))
        .unionByName(c.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"), F.col("c_custkey").alias("pos")))
        .unionByName(o.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"), F.col("o_orderkey").alias("pos")))
    )
    return nodes, edges


def gr3_context(spark, root):
    """The context of every region under every budget, in the order of the walk."""
    nodes, edges = _tree(spark, root)
    budgets = load(spark, root, "context_budgets")
    r = load(spark, root, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    every = F.explode(F.sequence(F.lit(1), F.lit(4)))
    seeds = r.select("node", every.alias("budget_id")).join(budgets, "budget_id")
    seeds = seeds.select(F.concat_ws("/", "node", "budget_id").alias("seed"), "node", F.lit("main").alias("language"), F.col("max_tokens").cast("bigint").alias("budget"))
    return graph.context(nodes, edges, seeds)


def gr10_lookup(spark, root):
    """The context of nations that are looked up by the path of their names."""
    nodes, edges = _tree(spark, root)
    r, n = load(spark, root, "region"), load(spark, root, "nation")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name").alias("seed"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.context(nodes, edges, named.withColumns({"language": F.lit("main"), "budget": F.lit(4096).cast("bigint")})).groupBy("seed").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("depth").alias("depth"))


def gr4_ancestors(spark, root):
    known = files(spark, root).where("project_id is not null and file_path is not null").select("file_id", F.col("file_path").alias("path"))
    return graph.prefixes(known, "path", ["file_id"]).where("distance > 0").select("file_id", "ancestor", "distance")


def gr5_find(spark, root):
    """Nodes found by path, and by the id of the file at them."""
    known = files(spark, root).where("project_id is not null").select("file_id", "project_id", "file_path")
    return known.where((F.col("file_path") == "src/core/index.js") | (F.col("file_id") % 500 == 7)).select("file_id", "project_id", "file_path")


def _states(spark, root):
    """Two states of the sources: md5 of the code, and that of the same with some files changed, gone and new."""
    now = files(spark, root).where("code is not null").select("file_id", F.md5("code").alias("hash"))
    old = now.where("file_id % 7 <> 0").withColumn("hash", F.when(F.col("file_id") % 5 == 0, F.md5("hash")).otherwise(F.col("hash")))
    return old, now.where("file_id % 11 <> 0")


def gr7_changed(spark, root):
    old, new = _states(spark, root)
    return store.changed(old, new, "file_id", "hash")


def tr6_invalidated(spark, root):
    """What a cache over the old state keeps."""
    old, new = _states(spark, root)
    return store.invalidated(old, store.changed(old, new, "file_id", "hash"), "file_id").select("file_id", "hash")


def gr8_removed(spark, root):
    """The tree without the nations of one region: what is left, by kind of node and of edge."""
    nodes, edges = _tree(spark, root)
    gone = load(spark, root, "nation").where("n_regionkey = 2").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    left, kept_edges = graph.remove(nodes, edges, gone)
    a = left.groupBy(F.concat(F.lit("node "), F.substring("node", 1, 1)).alias("part")).agg(F.count("*").alias("n"))
    return a.unionByName(kept_edges.groupBy(F.concat(F.lit("edge "), F.substring("src", 1, 1)).alias("part")).agg(F.count("*").alias("n")))


def gr9_cleared(spark, root):
    """A store cleared of a project: what is left of it, and the edges, which a clearing leaves."""
    r = records(spark, root)
    return r.where("project_id is distinct from 'harbor-mono'").groupBy("project_id").agg(F.count("*").alias("n"))


def cc1_read_through(spark, root):
    """Texts looked up in two tiers by hash; the first is small, the second partly stale."""
    docs = load(spark, root, "documents").where("text is not null").select("doc_id", "text", "source")
    nodes = docs.select("doc_id", F.md5("text").alias("hash"))
    memory = docs.where("doc_id % 4 = 0").select("doc_id", F.md5("text").alias("hash"), F.lit("m").alias("content"))
    disk = docs.where("doc_id % 3 = 0").select("doc_id", F.md5(F.when(F.col("source") == "readme", F.lit("stale")).otherwise(F.col("text"))).alias("hash"), F.lit("d").alias("content"))
    return store.read_through(nodes, [memory, disk], "doc_id", "hash").select("doc_id", "content", "tier")


def sk3_rejected(spark, root):
    """Inserts that are refused: files as new records of the store."""
    rows = files(spark, root).select("file_id", "project_id", "file_path", F.col("code").alias("summary"))
    return store.rejected(records(spark, root), rows, ["project_id", "file_path"], ["project_id", "file_path", "summary"]).select("file_id", "status")


def sk4_stamped(spark, root):
    """An update with the time it was made, and the keys that it found no row for."""
    s = records(spark, root).select("record_id", "project_id", "file_path", "summary", "last_updated")
    new = files(spark, root).where("file_id % 2 = 0").select("project_id", "file_path", F.col("commit_id").alias("summary"))
    return store.update_matched(s, new, ["project_id", "file_path"], ["summary"], "last_updated", F.lit("2026-01-01 00:00:00").cast("timestamp")).select(
        "record_id", "summary", F.unix_micros("last_updated").alias("updated")
    )


def sk4_absent(spark, root):
    new = files(spark, root).where("file_id % 2 = 0").select("project_id", "file_path")
    return store.absent(records(spark, root), new, ["project_id", "file_path"]).groupBy("project_id").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (gr3_context, gr10_lookup, gr4_ancestors, gr5_find, gr7_changed, tr6_invalidated, gr8_removed, gr9_cleared, cc1_read_through, sk3_rejected, sk4_stamped, sk4_absent)
}

_D = "(SELECT * FROM documentation QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
_S = "(SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id) = 1)"
_N = """nodes AS (SELECT 'r' || r_regionkey AS node, 'main' AS language, 1::BIGINT AS tokens FROM region UNION ALL SELECT 'n' || n_nationkey, 'main', length(n_name) FROM nation
    UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'other' ELSE 'main' END, c_custkey % 61 FROM customer UNION ALL SELECT 'o' || o_orderkey, 'main', o_orderkey % 997 FROM orders),
    edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey::BIGINT AS pos FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders)"""


def _walk_sql(seeds: str) -> str:
    """The walk on a tree, level by level; a level is folded in the order of the queue."""
    fold = """list_reduce(line, lambda a, x: CASE WHEN a.used >= a.budget OR a.used + x.tokens > a.budget THEN a
        ELSE {'budget': a.budget, 'used': a.used + x.tokens, 'node': '', 'tokens': 0::BIGINT, 'got': list_append(a.got, {'node': x.node, 'tokens': x.tokens})} END,
        {'budget': budget, 'used': used, 'node': '', 'tokens': 0::BIGINT, 'got': []::STRUCT(node VARCHAR, tokens BIGINT)[]})"""
    blank = "'budget': 0::BIGINT, 'used': 0::BIGINT, 'node': {n}, 'tokens': {t}, 'got': []::STRUCT(node VARCHAR, tokens BIGINT)[]"
    return f"""WITH RECURSIVE {_N}, seeds AS ({seeds}),
    w AS (SELECT seed, budget, 0 AS depth, {fold.replace('line', 'line0')} AS f FROM (SELECT seed, budget, 0::BIGINT AS used, [{{{blank.format(n='nodes.node', t='tokens')}}}] AS line0 FROM seeds JOIN nodes ON nodes.node = seeds.node AND nodes.language = 'main')
        UNION ALL SELECT seed, budget, depth, {fold} FROM (
            SELECT w.seed, w.budget, w.depth + 1 AS depth, w.f.used AS used, list({{{blank.format(n='n.node', t='n.tokens')}}} ORDER BY g.nth, e.pos) AS line
            FROM w, LATERAL (SELECT unnest(range(len(w.f.got))) AS nth, unnest(w.f.got) AS g) g JOIN edges e ON e.src = g.g.node JOIN nodes n ON n.node = e.dst AND n.language = 'main'
            WHERE w.f.used < w.budget GROUP BY ALL)),
    t AS (SELECT seed, depth, unnest(range(len(f.got))) AS nth, unnest(f.got) AS g FROM w),
    res AS (SELECT seed, (row_number() OVER (PARTITION BY seed ORDER BY depth, nth) - 1)::INT AS pos, g.node AS node, depth::INT AS depth, g.tokens AS tokens FROM t)"""


ORACLES = {
    "gr3_context": _walk_sql("SELECT 'r' || r_regionkey || '/' || budget_id AS seed, 'r' || r_regionkey AS node, max_tokens::BIGINT AS budget FROM region, context_budgets") + " SELECT * FROM res",
    "gr10_lookup": _walk_sql("SELECT r_name || '/' || n_name AS seed, 'n' || n_nationkey AS node, 4096::BIGINT AS budget FROM nation JOIN region ON n_regionkey = r_regionkey")
    + " SELECT seed, count(*) AS n, sum(tokens)::BIGINT AS tokens, max(depth)::INT AS depth FROM res GROUP BY seed",
    "gr4_ancestors": f"""WITH p AS (SELECT file_id, string_split(file_path, '/') AS xs FROM {_S} WHERE project_id IS NOT NULL AND file_path IS NOT NULL)
        SELECT file_id, array_to_string(xs[1:i], '/') AS ancestor, (len(xs) - i)::INT AS distance FROM p, LATERAL (SELECT unnest(range(1, len(xs))) AS i)""",
    "gr5_find": f"SELECT file_id, project_id, file_path FROM {_S} WHERE project_id IS NOT NULL AND (file_path = 'src/core/index.js' OR file_id % 500 = 7)",
    "gr7_changed": f"""WITH n AS (SELECT file_id, md5(code) AS h FROM {_S} WHERE code IS NOT NULL), o AS (SELECT file_id, CASE WHEN file_id % 5 = 0 THEN md5(h) ELSE h END AS h FROM n WHERE file_id % 7 <> 0), m AS (SELECT * FROM n WHERE file_id % 11 <> 0)
        SELECT coalesce(m.file_id, o.file_id) AS file_id, CASE WHEN o.file_id IS NULL THEN 'added' WHEN m.file_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN m ON o.file_id = m.file_id WHERE o.h IS DISTINCT FROM m.h""",
    "tr6_invalidated": f"SELECT file_id, md5(code) AS hash FROM {_S} WHERE code IS NOT NULL AND file_id % 7 <> 0 AND file_id % 11 <> 0 AND file_id % 5 <> 0",
    "gr8_removed": f"""WITH {_N}, g AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 2)
        SELECT 'node ' || node[1] AS part, count(*) AS n FROM nodes WHERE node NOT IN (FROM g) GROUP BY ALL UNION ALL SELECT 'edge ' || src[1], count(*) FROM edges WHERE src NOT IN (FROM g) AND dst NOT IN (FROM g) GROUP BY ALL""",
    "gr9_cleared": f"SELECT project_id, count(*) AS n FROM {_D} WHERE project_id IS DISTINCT FROM 'harbor-mono' GROUP BY project_id",
    "cc1_read_through": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'm' WHEN doc_id % 3 = 0 AND source IS DISTINCT FROM 'readme' THEN 'd' END AS content,
        (CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 3 = 0 AND source IS DISTINCT FROM 'readme' THEN 1 END)::INT AS tier FROM documents WHERE text IS NOT NULL""",
    "sk3_rejected": f"""WITH s AS (SELECT *, EXISTS (SELECT 1 FROM documentation d WHERE d.project_id = f.project_id AND d.file_path = f.file_path) AS there FROM {_S} f)
        SELECT file_id, (CASE WHEN project_id IS NULL OR file_path IS NULL OR code IS NULL THEN 400 ELSE 409 END)::INT AS status FROM s WHERE project_id IS NULL OR file_path IS NULL OR code IS NULL OR there""",
    "sk4_stamped": f"""SELECT record_id, CASE WHEN s.file_id IS NOT NULL THEN coalesce(s.commit_id, d.summary) ELSE d.summary END AS summary, CASE WHEN s.file_id IS NOT NULL THEN epoch_us(TIMESTAMP '2026-01-01 00:00:00') ELSE epoch_us(d.last_updated) END AS updated
        FROM {_D} d LEFT JOIN (SELECT * FROM {_S} WHERE file_id % 2 = 0) s ON s.project_id = d.project_id AND s.file_path = d.file_path""",
    "sk4_absent": f"SELECT project_id, count(*) AS n FROM (SELECT DISTINCT project_id, file_path FROM {_S} WHERE file_id % 2 = 0) s WHERE NOT EXISTS (SELECT 1 FROM documentation d WHERE d.project_id = s.project_id AND d.file_path = s.file_path) GROUP BY project_id",
}
