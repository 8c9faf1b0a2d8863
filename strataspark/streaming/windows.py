"""Streaming forms of the log operators (TR*). Each takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_windows(events: DataFrame, time: str, key: str, limit: int, window: str = "15 minutes", late: str = "7 days") -> DataFrame:
    """TR1: requests by key and window, and whether they pass the limit. State is dropped ``late`` behind."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n", (F.col("n") > limit).alias("limited"))


def debounced(queries: DataFrame, time: str, key: str, query: str, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """TR2: of every burst with gaps under ``gap`` the last query; blank ones count for the burst only."""
    burst = queries.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.max_by(query, time).alias(query))
    return burst.where(F.trim(query) != "").select(F.col("w.start").alias("start"), key, query)


def cumulative(events: DataFrame, key: str) -> DataFrame:
    """TR5: running totals by key, for update or complete mode."""
    ok = F.coalesce("success", F.lit(False))
    return events.groupBy(key).agg(F.count("*").alias("api_calls"), F.count_if(~ok).alias("api_errors"), F.sum(F.when(ok, F.coalesce("tokens", F.lit(0))).otherwise(0)).alias("total_tokens"))


def quota_gate(calls: DataFrame, key: str, quota: int, output: str = "waits bigint, seen bigint") -> DataFrame:
    """TR3: keyed state: calls seen, and how many of them came with no quota left in their key."""

    def step(name: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, waits = state.get if state.exists else (0, 0)
        for frame in frames:
            n = len(frame)
            waits += max(0, seen + n - max(quota, seen))
            seen += n
        state.update((seen, waits))
        yield pd.DataFrame({key: [name[0]], "waits": [waits], "seen": [seen]})

    return calls.select(key).groupBy(key).applyInPandasWithState(step, f"{key} string, {output}", "seen bigint, waits bigint", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drives a stream over all that is there, into parquet, and ends."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_totals(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drives a stream of whole results (complete mode); every batch replaces the table."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
