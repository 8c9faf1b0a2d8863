"""Nearest neighbours of a stated query set (SF12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; null for vectors of no length."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def nearest(rows: DataFrame, ident: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """The k rows most like each query by cosine, exactly; equal scores go by id. A query is not its own neighbour.

    Each query meets every row, partition by partition; the rank is limited before anything is shuffled.
    """
    q = queries.select(F.col(ident).alias("query_id"), unit(F.col(vector)).alias("q")).where("q is not null")
    r = rows.select(F.col(ident).alias("match_id"), unit(F.col(vector)).alias("r")).where("r is not null")
    scored = r.crossJoin(q).where("query_id <> match_id").select("query_id", "match_id", F.round(dot(F.col("q"), F.col("r")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
