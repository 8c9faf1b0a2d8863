"""Queries of problem 7: texts in containers of the capacities in context_budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import packing, tokens


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """One row for each text or piece and capacity, with its container."""
    sizes = tokens.counts(load(spark, root, "documents"), "doc_id")
    budgets = load(spark, root, "context_budgets").select("budget_id", F.col("max_tokens").alias("capacity"))
    return packing.pack(sizes, budgets)


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers used by capacity, beside the least number that could hold the tokens."""
    budgets = load(spark, root, "context_budgets").select("budget_id", F.col("max_tokens").alias("capacity"))
    used = p7_containers(spark, root).where("container_id is not null")
    per = used.groupBy("budget_id", "container_id").agg(F.sum("size").alias("tokens"))
    total = per.groupBy("budget_id").agg(
        F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest")
    )
    return total.join(F.broadcast(budgets), "budget_id").select(
        "budget_id",
        "capacity",
        "n_containers",
        F.ceil(F.col("n_tokens") / F.col("capacity")).alias("at_least"),
        "fullest",
        (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused"),
    )


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}
