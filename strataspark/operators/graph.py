"""Trees and dependency graphs as edge tables (GR*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """GR4: nodes reached from each seed with their least depth: seed, node, depth.

    Breadth first by joins on the edges, until a step finds nothing new or ``max_depth``, if one is
    given. Every step keeps what is new and cuts the lineage, so a lost executor costs no more than the
    step at hand. Cycles end by themselves. Columns of ``edges``: src, dst. For trees of paths see
    ``prefixes``, which needs no steps.
    """
    seen = kept(seeds.select(F.col("node").alias("seed"), F.col("node"), F.lit(0).alias("depth")).distinct())
    edge = edges.select("src", "dst").distinct()
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edge, front.node == edge.src).select("seed", F.col("dst").alias("node")).distinct()
        front = kept(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)
    return seen


def prefixes(nodes: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """GR4 in trees of paths: every node with itself and the nodes above it, nearest first: keep, path,
    ancestor, distance. A path names its ancestors, so nothing is joined."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor"), (F.size(parts) - i).alias("distance")))
    return nodes.select(*keep, path, F.explode(up).alias("u")).select(*keep, path, "u.*")


CONTEXT = "seed string, pos int, node string, depth int, tokens bigint"


def context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GR3: breadth-first context of each seed under a token budget and a language.

    ``nodes``: node, language, tokens. ``edges``: src, dst, pos (order of a node's edges). ``seeds``: seed,
    node, language, budget. The queue is worked in order and every node is seen once. A node of another
    language or one that would go over the budget is passed over, and nothing behind it is queued; the walk
    ends when the budget is used up. A seed whose node is not known has no rows. Columns: seed, pos, node,
    depth, tokens.

    What fits depends on all that came before, so the walk goes level by level: one join brings the next
    level of all seeds, and each seed folds its own level in queue order. Of nodes of one size a level can
    take no more than the budget left holds, and always the first ones, so only these are folded: their
    number is bounded by the budget (nodes of no tokens aside, which are results).
    """
    known = nodes.select("node", F.col("language").alias("node_language"), F.col("tokens").cast("bigint").alias("tokens"))
    out_edges = edges.select("src", "dst", "pos")
    state = kept(seeds.select("seed", "language", "budget", F.lit(0).cast("bigint").alias("used")))
    front = kept(seeds.select("seed", "node", F.lit(0).cast("bigint").alias("order")))
    seen = kept(front.select("seed", "node"))
    taken = None
    depth = 0
    while True:
        like = Window.partitionBy("seed", "tokens").orderBy("order")
        level = (
            front.join(known, "node")
            .join(state, "seed")
            .where("node_language <=> language and used < budget and tokens <= budget - used")
            .withColumn("nth", F.row_number().over(like))
            .where("tokens = 0 or nth * tokens <= budget - used")
        )
        line = F.array_sort(F.collect_list(F.struct("order", "node", "tokens"))).alias("line")
        zero = F.struct(F.col("used").alias("used"), F.array().cast("array<struct<order:bigint,node:string,tokens:bigint>>").alias("got"))

        def take(acc: Column, x: Column) -> Column:
            over = (acc["used"] >= F.col("budget")) | (acc["used"] + x["tokens"] > F.col("budget"))
            return F.when(over, acc).otherwise(F.struct((acc["used"] + x["tokens"]).alias("used"), F.array_append(acc["got"], x).alias("got")))

        done = kept(level.groupBy("seed", "budget", "used").agg(line).select("seed", F.aggregate("line", zero, take).alias("f")))
        got = done.select("seed", "f.used", F.posexplode("f.got").alias("at", "g")).select("seed", "at", F.col("g.node").alias("node"), F.col("g.tokens").alias("tokens"))
        if got.isEmpty():
            break
        rows = got.select("seed", F.lit(depth).alias("depth"), "at", "node", "tokens")
        taken = rows if taken is None else taken.unionByName(rows)
        state = kept(state.join(done.select("seed", F.col("f.used").alias("now")), "seed", "left").select("seed", "language", "budget", F.coalesce("now", "used").alias("used")))
        step = got.join(out_edges, got.node == out_edges.src).select("seed", F.col("dst").alias("node"), F.struct("at", "pos").alias("place"))
        new = step.groupBy("seed", "node").agg(F.min("place").alias("place")).join(seen, ["seed", "node"], "left_anti")
        front = kept(new.withColumn("order", F.row_number().over(Window.partitionBy("seed").orderBy("place", "node")).cast("bigint")).select("seed", "node", "order"))
        seen = kept(seen.unionByName(front.select("seed", "node")))
        depth += 1
    if taken is None:
        return seeds.sparkSession.createDataFrame([], CONTEXT)
    return taken.select("seed", (F.row_number().over(Window.partitionBy("seed").orderBy("depth", "at")) - 1).alias("pos"), "node", "depth", "tokens")


def remove(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR8: a graph without some nodes (column node) and without the edges that touch them."""
    g = gone.select("node").distinct()
    left = edges.join(g, edges.src == g.node, "left_anti")
    return nodes.join(g, "node", "left_anti"), left.join(g, left.dst == g.node, "left_anti")


def tree_edges(nodes: DataFrame, path: str = "path") -> DataFrame:
    """Edges from each path to the paths right below it."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return nodes.select(parent.alias("src"), F.col(path).alias("dst")).where("src <> ''")


def resolve(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """GR2, JN9: dependencies that name a known module, as edges between its file and theirs.

    ``dependencies``: project_id, file_id, name. ``modules``: project_id, file_id, module.
    """
    target = modules.select("project_id", F.col("module").alias("name"), F.col("file_id").alias("dst"))
    return dependencies.join(target, ["project_id", "name"]).where(F.col("file_id") != F.col("dst")).select(F.col("file_id").alias("src"), "dst").distinct()
