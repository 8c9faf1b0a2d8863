"""Queries over the call log and the documentation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.tables import load


def calls(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "api_calls").dropDuplicates(["seq"])


def records(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documentation").dropDuplicates(["record_id"])


def ag1_provider_summary(spark, root):
    return metrics.provider_summary(calls(spark, root))


def ag2_running_latency(spark, root):
    return metrics.running_latency(calls(spark, root).where("project_id is not null"), "project_id", "seq")


def ag4_timing(spark, root):
    return metrics.timing(calls(spark, root))


def ag5_error_histogram(spark, root):
    return metrics.error_histogram(calls(spark, root))


def ag6_totals(spark, root):
    return metrics.totals(calls(spark, root), "project_id")


def ag7_rollup(spark, root):
    return metrics.rollup_summary(calls(spark, root), "provider", "project_id")


def ag8_cache(spark, root):
    docs = load(spark, root, "documents").select("source", (F.col("text").isNotNull() & (F.col("n_chars") > 500)).alias("hit"), F.floor(F.coalesce("n_chars", F.lit(0)) / 4).cast("bigint").alias("tokens"))
    return metrics.cache_ratios(docs, "source")


def ag9_complexity_rank(spark, root):
    fs = F.transform(F.filter("functions", lambda f: f.isNotNull()), lambda f: F.coalesce(f["complexity"], F.lit(0.0)))
    total = F.coalesce(F.aggregate(fs, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return records(spark, root).select("record_id", total.alias("complexity")).withColumn("rank", metrics.complexity_rank(F.col("complexity")))


def ag10_last_function_wins(spark, root):
    each = records(spark, root).select("record_id", F.posexplode("functions").alias("pos", "f")).where("f.name is not null")
    return each.groupBy("record_id", F.col("f.name").alias("name")).agg(F.max_by(F.coalesce("f.complexity", F.lit(0.0)), "pos").alias("complexity"))


def ag13_progress(spark, root):
    w = calls(spark, root).where("project_id is not null").select("project_id", "seq")
    return metrics.progress(w, "project_id", "seq")


def ag15_counts(spark, root):
    return records(spark, root).select("record_id", F.coalesce(F.size("functions"), F.lit(0)).alias("n_functions"), F.coalesce(F.size("classes"), F.lit(0)).alias("n_classes"))


def wn1_trend(spark, root):
    h = records(spark, root).where("project_id is not null and file_path is not null").select("record_id", "project_id", "file_path", "last_updated", F.col("metrics.complexity").alias("complexity"))
    return metrics.trend(h, ["project_id", "file_path"], ["last_updated", "record_id"], "complexity").drop("last_updated")


def wn1_monthly_orders(spark, root):
    o = load(spark, root, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return metrics.trend(o, ["o_orderstatus"], ["month"], "total")


def tr4_latest_state(spark, root):
    c = calls(spark, root).where("project_id is not null").select("project_id", "seq", "provider", "success")
    return metrics.latest(c, "project_id", ["seq"])


QUERIES = {f.__name__: f for f in (ag1_provider_summary, ag2_running_latency, ag4_timing, ag5_error_histogram, ag6_totals, ag7_rollup, ag8_cache, ag9_complexity_rank, ag10_last_function_wins, ag13_progress, ag15_counts, wn1_trend, wn1_monthly_orders, tr4_latest_state)}

_C = "(SELECT DISTINCT * FROM api_calls)"
_D = "(SELECT * FROM documentation QUALIFY row_number() OVER (PARTITION BY record_id) = 1)"
ORACLES = {
    "ag1_provider_summary": f"""SELECT provider, count(*) AS api_calls, count(*) FILTER (WHERE NOT coalesce(success, false)) AS api_errors,
        coalesce(sum(CASE WHEN success THEN coalesce(tokens, 0) ELSE 0 END), 0)::BIGINT AS total_tokens, round(avg(CASE WHEN success THEN latency END), 6) AS avg_latency,
        round(count(*) FILTER (WHERE NOT coalesce(success, false)) / count(*) * 100.0, 6) AS error_rate,
        round(sum(CASE WHEN success THEN coalesce(tokens, 0) ELSE 0 END) / count(*), 6) AS tokens_per_call FROM {_C} GROUP BY provider""",
    "ag2_running_latency": f"""WITH RECURSIVE c AS (SELECT project_id, coalesce(success, false) AND latency IS NOT NULL AS ok, latency, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS n FROM {_C} WHERE project_id IS NOT NULL),
        l AS (SELECT project_id, list({{'n': n::DOUBLE, 'x': coalesce(latency, 0.0), 'ok': ok, 'avg': 0.0::DOUBLE}} ORDER BY n) AS xs FROM c GROUP BY project_id)
        SELECT project_id, round(list_reduce(xs, lambda a, b: {{'n': b.n, 'x': b.x, 'ok': b.ok, 'avg': CASE WHEN b.ok THEN (a.avg * (b.n - 1) + b.x) / b.n ELSE a.avg END}},
        {{'n': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'ok': false, 'avg': 0.0::DOUBLE}}).avg, 4) AS running_latency FROM l""",
    "ag4_timing": f"SELECT coalesce(min(latency), 0) AS least, coalesce(max(latency), 0) AS greatest, round(coalesce(avg(latency), 0), 6) AS mean FROM {_C}",
    "ag5_error_histogram": f"SELECT provider, coalesce(error_type, 'Unknown') AS error_type, count(*) AS n FROM {_C} WHERE NOT coalesce(success, false) GROUP BY ALL",
    "ag6_totals": f"""SELECT project_id, count(*) AS total, count(success) AS processed, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed,
        round(count(*) FILTER (WHERE success) / count(*) * 100.0, 6) AS success_rate, round(CASE WHEN count(success) > 0 THEN count(*) FILTER (WHERE NOT success) / count(success) * 100.0 ELSE 0 END, 6) AS error_rate FROM {_C} GROUP BY project_id""",
    "ag7_rollup": f"""SELECT provider, project_id, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(success, false)) AS errors, sum(coalesce(tokens, 0))::BIGINT AS tokens,
        grouping(provider, project_id)::BIGINT AS level FROM {_C} GROUP BY ROLLUP (provider, project_id)""",
    "ag8_cache": """SELECT source, round(count(*) FILTER (WHERE text IS NOT NULL AND n_chars > 500) / count(*), 6) AS hit_ratio, round(sum(coalesce(n_chars, 0) // 4) / count(*), 6) AS tokens_per_chunk FROM documents GROUP BY source""",
    "ag9_complexity_rank": f"""SELECT record_id, complexity, CASE WHEN complexity <= 5 THEN 'A' WHEN complexity <= 10 THEN 'B' WHEN complexity <= 20 THEN 'C' WHEN complexity <= 30 THEN 'D' WHEN complexity <= 40 THEN 'E' ELSE 'F' END AS rank
        FROM (SELECT record_id, coalesce(list_sum([f.complexity FOR f IN functions]), 0.0) AS complexity FROM {_D})""",
    "ag10_last_function_wins": f"""WITH e AS (SELECT record_id, i, functions[i] AS f FROM {_D}, LATERAL (SELECT unnest(range(1, len(functions) + 1)) AS i))
        SELECT record_id, f.name AS name, arg_max(coalesce(f.complexity, 0.0), i) AS complexity FROM e WHERE f.name IS NOT NULL GROUP BY ALL""",
    "ag13_progress": f"SELECT project_id, seq, round(row_number() OVER (PARTITION BY project_id ORDER BY seq) / count(*) OVER (PARTITION BY project_id) * 100, 6) AS progress FROM {_C} WHERE project_id IS NOT NULL",
    "ag15_counts": f"SELECT record_id, coalesce(len(functions), 0)::INT AS n_functions, coalesce(len(classes), 0)::INT AS n_classes FROM {_D}",
    "wn1_trend": f"""SELECT record_id, project_id, file_path, metrics.complexity AS complexity, (row_number() OVER w - 1)::INT AS version_idx,
        round(CASE WHEN lag(metrics.complexity) OVER w <> 0 THEN (metrics.complexity - lag(metrics.complexity) OVER w) / lag(metrics.complexity) OVER w * 100 END, 6) AS trend
        FROM {_D} WHERE project_id IS NOT NULL AND file_path IS NOT NULL WINDOW w AS (PARTITION BY project_id, file_path ORDER BY last_updated NULLS FIRST, record_id)""",
    "wn1_monthly_orders": """WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
        SELECT month, o_orderstatus, total, (row_number() OVER w - 1)::INT AS version_idx, round((total - lag(total) OVER w) / lag(total) OVER w * 100, 6) AS trend FROM o WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)""",
    "tr4_latest_state": f"SELECT project_id, max(seq) AS seq, arg_max({{'p': provider}}, seq).p AS provider, arg_max({{'s': success}}, seq).s AS success FROM {_C} WHERE project_id IS NOT NULL GROUP BY project_id",
}
