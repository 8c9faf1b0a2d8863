"""Call and processing metrics as aggregates over an event log (AG*, RM5, WN*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """AG3: part of whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole * scale).otherwise(F.lit(0.0))


def provider_summary(calls: DataFrame, key: str = "provider") -> DataFrame:
    """AG1, AG3: counters and ratios by provider; tokens count for successful calls only."""
    ok = F.coalesce("success", F.lit(False))
    done = calls.groupBy(key).agg(
        F.count("*").alias("api_calls"),
        F.count_if(~ok).alias("api_errors"),
        F.sum(F.when(ok, F.coalesce("tokens", F.lit(0))).otherwise(0)).alias("total_tokens"),
        F.round(F.avg(F.when(ok, F.col("latency"))), 6).alias("avg_latency"),
    )
    return done.withColumns(
        {
            "error_rate": F.round(ratio(F.col("api_errors"), F.col("api_calls")), 6),
            "tokens_per_call": F.round(ratio(F.col("total_tokens"), F.col("api_calls"), 1.0), 6),
        }
    )


def error_histogram(calls: DataFrame, key: str = "provider") -> DataFrame:
    """AG5: failures by type, ``Unknown`` where none is given; the sizes of both keys are small."""
    return (
        calls.where(~F.coalesce("success", F.lit(False)))
        .groupBy(key, F.coalesce("error_type", F.lit("Unknown")).alias("error_type"))
        .agg(F.count("*").alias("n"))
    )


def error_maps(calls: DataFrame, key: str = "provider") -> DataFrame:
    """AG5 as a map for each key, built from the counts."""
    counted = error_histogram(calls, key)
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("error_types"))


#: Rows of a key that one task orders; longer keys are cut into blocks of their order column.
BLOCK = 50_000


def numbered(rows: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame:
    """Adds ``block`` and ``n``, the place of a row in its key by an integer column, without one task for a key.

    The column is cut into blocks; counts of whole blocks give each its offset.
    """
    cut = rows.withColumn("block", F.floor(F.col(order) / block))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(key, "block").agg(F.count("*").alias("size")).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(key, "block").orderBy(order))
    return cut.withColumn("within", within).join(offsets.drop("size"), [key, "block"]).withColumn("n", F.col("within") + F.col("offset")).drop("within", "offset")


def running_latency(calls: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame:
    """AG2: the order-dependent average: on success ``avg = (avg * (n - 1) + x) / n`` with n all calls so far.

    Every call maps the average to ``shrink * avg + part``. A block of calls does so as well, with the
    sum of its logarithms and its parts weighted by what follows; blocks are put together the same way.
    A success at n = 1 forgets what was before it, which is nothing.
    """
    ok = F.coalesce("success", F.lit(False)) & F.col("latency").isNotNull()
    rows = numbered(calls.select(key, order, "latency", ok.alias("ok")), key, order, block)
    shrink = F.when(F.col("ok") & (F.col("n") > 1), F.log((F.col("n") - 1) / F.col("n"))).otherwise(F.lit(0.0))
    later = Window.partitionBy(key, "block").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    weight = F.exp(F.coalesce(F.sum("shrink").over(later), F.lit(0.0)))
    part = F.when(F.col("ok"), F.col("latency") / F.col("n") * weight).otherwise(F.lit(0.0))
    blocks = rows.withColumn("shrink", shrink).withColumn("part", part).groupBy(key, "block").agg(F.sum("part").alias("part"), F.sum("shrink").alias("shrink"))
    after = Window.partitionBy(key).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = blocks.withColumn("part", F.col("part") * F.exp(F.coalesce(F.sum("shrink").over(after), F.lit(0.0))))
    return whole.groupBy(key).agg(F.round(F.sum("part"), 4).alias("running_latency"))


def timing(calls: DataFrame, value: str = "latency") -> DataFrame:
    """AG4: least, greatest and mean of a duration; 0 where there is none."""
    return calls.agg(
        F.coalesce(F.min(value), F.lit(0.0)).alias("least"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("greatest"),
        F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("mean"),
    )


def totals(results: DataFrame, key: str) -> DataFrame:
    """AG6: success against all rows, errors against processed ones (those with an outcome)."""
    done = results.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("success").isNotNull()).alias("processed"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )
    return done.withColumns(
        {
            "success_rate": F.round(ratio(F.col("successful"), F.col("total")), 6),
            "error_rate": F.round(ratio(F.col("failed"), F.col("processed")), 6),
        }
    )


def rollup_summary(calls: DataFrame, *keys: str) -> DataFrame:
    """AG7: overall and nested summaries in one pass."""
    return calls.rollup(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("errors"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
        F.grouping_id().alias("level"),
    )


def cache_ratios(cached: DataFrame, key: str) -> DataFrame:
    """AG8: share of hits (0 to 1) and tokens of an average chunk."""
    done = cached.groupBy(key).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sum("tokens").alias("tokens"))
    return done.select(
        key,
        F.round(ratio(F.col("hits"), F.col("n"), 1.0), 6).alias("hit_ratio"),
        F.round(ratio(F.col("tokens"), F.col("n"), 1.0), 6).alias("tokens_per_chunk"),
    )


def complexity_rank(value: Column) -> Column:
    """SF20: letter of a cyclomatic complexity."""
    return F.when(value <= 5, "A").when(value <= 10, "B").when(value <= 20, "C").when(value <= 30, "D").when(value <= 40, "E").otherwise("F")


def trend(history: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """WN1, WN2: change in percent against the version before, and the version's index."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    change = F.when(before.isNotNull() & F.col(value).isNotNull() & (before != 0), (F.col(value) - before) / before * 100)
    return history.withColumns({"version_idx": F.row_number().over(w) - 1, "trend": F.round(change, 6)})


def progress(tasks: DataFrame, task: str, order: str) -> DataFrame:
    """AG13, WN3: share of a task done after each of its rows."""
    size = tasks.groupBy(task).agg(F.count("*").alias("size"))
    return numbered(tasks, task, order).join(size, task).withColumn("progress", F.round(F.col("n") / F.col("size") * 100, 6)).drop("block", "n", "size")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """TR4, RM16: the last row of every key; combines before the shuffle."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r")).select(key, "r.*")


def bursts(rows: DataFrame, key: str, time: str, order: str, gap_seconds: int, block_seconds: int = 86_400) -> DataFrame:
    """TR2 over a whole log: numbers the bursts of each key; a gap of at least ``gap_seconds`` ends one.

    A key is cut into blocks of time, so no task orders a whole key: each block is compared with the
    last row of the block before it, and bursts are counted on from the blocks before.
    """
    cut = rows.withColumn("block", F.floor(F.unix_seconds(time) / block_seconds))
    along = Window.partitionBy(key).orderBy("block")
    last = cut.groupBy(key, "block").agg(F.max(time).alias("last")).withColumn("before", F.lag("last").over(along)).drop("last")
    within = Window.partitionBy(key, "block").orderBy(time, order)
    earlier = F.coalesce(F.lag(time).over(within), F.col("before"))
    begins = earlier.isNull() | (F.unix_micros(time) - F.unix_micros(earlier) >= gap_seconds * 1_000_000)
    marked = cut.join(last, [key, "block"]).withColumn("begins", begins.cast("bigint")).drop("before")
    counted = marked.groupBy(key, "block").agg(F.sum("begins").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return marked.withColumn("own", F.sum("begins").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(counted, [key, "block"]).withColumn("burst", F.col("own") + F.col("offset")).drop("own", "offset", "begins", "block")


def ordered_concat(rows: DataFrame, keys: list[str], order: str, text: str, between: str, block: int = BLOCK) -> DataFrame:
    """AG12: the texts of each key in the order of an integer column, as one. Blocks of the order are put
    together first, each by itself, and then the blocks, so no task sorts all rows of a key; the result is
    one text for each key, as asked."""
    cut = rows.select(*keys, order, text, F.floor(F.col(order) / block).alias("block"))
    parts = cut.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("line"))
    joined = parts.select(*keys, "block", F.array_join(F.transform("line", lambda x: x[text]), between).alias(text))
    whole = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", text))).alias("line"))
    return whole.select(*keys, F.array_join(F.transform("line", lambda x: x[text]), between).alias(text))
