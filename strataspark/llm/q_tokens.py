"""Queries of problem 6: token ids of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import tokens


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(load(spark, root, "documents"), "doc_id")


def p6_volume(spark: SparkSession, root: str) -> DataFrame:
    """Documents, characters and tokens by language as written."""
    docs = load(spark, root, "documents").select("doc_id", "lang", "text", "n_chars")
    sized = tokens.counts(docs.select(F.struct("lang", "n_chars").alias("doc"), "text"), "doc")
    return sized.groupBy(F.col("doc.lang").alias("lang")).agg(
        F.count("*").alias("n_docs"), F.sum("doc.n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens")
    )


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every text encoded and decoded again: whether it is as it was, by source."""
    docs = load(spark, root, "documents").select("doc_id", "text", "source")
    back = tokens.decode(tokens.encode(docs.select(F.struct("doc_id", "text", "source").alias("doc"), "text"), "doc"), "doc").withColumnRenamed("text", "again")
    same = F.coalesce("doc.text", F.lit("")) == F.col("again")
    return back.groupBy(F.col("doc.source").alias("source")).agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


def p6_limits(spark: SparkSession, root: str) -> DataFrame:
    """How many texts, with their source before them, are within each budget."""
    docs = load(spark, root, "documents").select("doc_id", F.array("source", "text").alias("texts"))
    budgets = {r.budget_id: r.max_tokens for r in load(spark, root, "context_budgets").limit(1_000).collect()}  # a fixed dimension
    counted = tokens.batch_counts(docs.withColumn("texts", F.array_compact("texts")), "doc_id", "texts")
    # one row for each size, so the few budgets meet sizes and not texts
    sizes = counted.groupBy("n_tokens", "error").agg(F.count("*").alias("n"))
    ok = tokens.within(F.col("n_tokens"), F.col("error"), F.col("max_tokens"))
    each = sizes.withColumn("b", F.explode(F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(m).alias("max_tokens")) for b, m in sorted(budgets.items())]))).select("*", "b.*")
    return each.groupBy("budget_id").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_within"), F.sum("n").alias("n"))


QUERIES = {"p6_ids": p6_ids, "p6_volume": p6_volume, "p6_decoded": p6_decoded, "p6_limits": p6_limits}
ORACLES = {"p6_decoded": "SELECT source, count(*) AS n, count(*) AS n_same FROM documents GROUP BY source"}
