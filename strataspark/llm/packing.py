"""Filling containers of fixed capacity with texts (problem 7).

Large-item matching. Items above a third of the capacity fit at most twice into a container: the
largest is matched with the largest other one that still fits beside it. Smaller items are then
placed, largest first, each into the container with the least room that still takes it, and into a
new one if there is none.

Items of one size are alike, so the plan of a container kind needs only the number of items of each
size: at most ``capacity`` rows, however many texts there are. Each kind is planned in a Spark task
of its own from that histogram, in time almost linear in the number of sizes. The plan says which
ranks of a size go to which containers; Spark gives each item its rank within its size (by salted
groups and their offsets, so that no size is in one task) and looks its container up.

Defined cases
    * A text above the capacity is cut into full pieces and a rest; other texts are never cut.
      A full piece is a container of its own.
    * A null or empty text has one row with size 0 and no container.
    * Repeated rows are items of their own. Ties go by rank; any order gives the same filling.
    * An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Rows up to which a plan is broadcast; a larger one is joined by shuffle. A plan has a few rows for
#: each size, whatever the number of texts.
BROADCAST_ROWS = 500_000

PLAN = "budget_id int, size int, rank_from bigint, n bigint, container_from bigint, each int"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (size, rank_from, n, container_from, each): items of ``size`` with ranks from
    ``rank_from`` go, ``each`` to a container, to the containers from ``container_from`` on."""
    left = {s: n for s, n in counts.items() if n and 0 < s <= capacity}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> [container_from, number]
    gap_sizes: list[int] = []
    containers = 0

    def place(size: int, n: int, start: int, each: int = 1) -> None:
        out.append((size, used[size], n, start, each))
        used[size] += n
        left[size] -= n

    def leave(gap: int, start: int, number: int) -> None:
        if gap and number:
            if not gaps[gap]:
                insort(gap_sizes, gap)
            gaps[gap].append([start, number])

    large = sorted(s for s in left if 3 * s > capacity)
    # below[i]: the place of the greatest size up to large[i - 1] that has items left; 0 for none
    below = [*range(len(large) + 1)]

    def last(i: int) -> int:
        while below[i] != i:
            below[i] = below[below[i]]
            i = below[i]
        return i

    def drop(size: int) -> None:
        if not left[size]:
            i = bisect_left(large, size) + 1
            below[i] = i - 1

    while at := last(len(large)):
        size = large[at - 1]
        other = last(min(at, bisect_left(large, capacity - size + 1)))
        if other == at and left[size] < 2:
            other = last(at - 1)
        if not other:
            n, room = left[size], capacity - size
            place(size, n, containers)
        elif other == at:
            n, room = left[size] // 2, capacity - 2 * size
            place(size, 2 * n, containers, 2)
        else:
            partner = large[other - 1]
            n, room = min(left[size], left[partner]), capacity - size - partner
            place(size, n, containers)
            place(partner, n, containers)
            drop(partner)
        drop(size)
        leave(room, containers, n)
        containers += n

    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            at = bisect_left(gap_sizes, size)
            if at == len(gap_sizes):
                fit = capacity // size
                number = -(-left[size] // fit)
                start, containers = containers, containers + number
                gap = capacity
            else:
                gap = gap_sizes[at]
                start, number = gaps[gap].pop()
                if not gaps[gap]:
                    gap_sizes.pop(at)
                fit = gap // size
            full = min(number, left[size] // fit)
            if full:
                place(size, full * fit, start, fit)
                leave(gap - fit * size, start, full)
            rest = left[size]
            if number > full and rest:  # the last container takes what remains
                place(size, rest, start + full, rest)
                leave(gap - rest * size, start + full, 1)
                full += 1
            leave(gap, start + full, number - full)
    return out


def pieces(sizes: DataFrame, kinds: dict[int, int]) -> DataFrame:
    """Items of each container kind: budget_id, capacity, doc_id, piece_no, size."""
    n, cap = F.col("n_tokens"), F.col("capacity")
    full = F.when(n > cap, F.floor(n / cap)).otherwise(F.lit(0)).cast("int")
    rest = (n - full * cap).cast("int")
    whole = F.array_repeat(cap, full)
    item = F.when((rest > 0) | (full == 0), F.concat(whole, F.array(rest))).otherwise(whole)
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("int").alias("capacity")) for b, c in sorted(kinds.items())]))
    return sizes.select("doc_id", "n_tokens", each.alias("kind")).select("doc_id", "n_tokens", "kind.*").select("budget_id", "capacity", "doc_id", F.posexplode(item).alias("piece_no", "size"))


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int")


def planned(histogram: DataFrame) -> DataFrame:
    """The plan (PLAN) of every container kind. ``histogram``: budget_id, capacity, size, n; a kind has
    at most ``capacity`` rows, which one task takes together."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        placed = plan(dict(zip(map(int, rows["size"]), map(int, rows["n"]), strict=True)), int(key[1]))
        out = pd.DataFrame(placed, columns=["size", "rank_from", "n", "container_from", "each"])
        out.insert(0, "budget_id", key[0])
        return out

    return histogram.groupBy("budget_id", "capacity").applyInPandas(run, PLAN)


def pack(sizes: DataFrame, budgets: DataFrame, salts: int | None = None) -> DataFrame:
    """The container of every item. ``sizes``: doc_id, n_tokens. ``budgets``: budget_id, capacity.

    ``budgets`` is a small dimension of at most 1,000 container kinds; capacities have no bound.
    """
    spark = sizes.sparkSession
    kinds = {r.budget_id: r.capacity for r in budgets.where("capacity > 0").limit(1_001).collect()}
    if len(kinds) > 1_000:
        raise ValueError("budgets is no small dimension")
    if not kinds:
        raise ValueError("no container has a capacity")
    items = pieces(kept(sizes), kinds)
    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = items.withColumn("salt", _salt(salts))

    # kept: at most one row for each kind, size and salt; the plan and the offsets come from it
    grouped = kept(items.groupBy("budget_id", "capacity", "size", "salt").agg(F.count("*").alias("n")))
    offsets = grouped.withColumn(
        "offset", F.sum("n").over(Window.partitionBy("budget_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select("budget_id", "size", "salt", F.coalesce("offset", F.lit(0)).alias("offset"))
    table = kept(planned(grouped.where("size > 0").groupBy("budget_id", "capacity", "size").agg(F.sum("n").alias("n"))))
    side = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table

    within = Window.partitionBy("budget_id", "size", "salt").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["budget_id", "size", "salt"]).withColumn("rank", F.col("r") + F.col("offset"))
    found = (ranked["budget_id"] == table["budget_id"]) & (ranked["size"] == table["size"]) & (ranked["rank"] >= table["rank_from"]) & (ranked["rank"] < table["rank_from"] + table["n"])
    container = (table["container_from"] + F.floor((ranked["rank"] - table["rank_from"]) / table["each"])).cast("bigint")
    return ranked.join(side, found, "left").select(
        ranked["budget_id"],
        ranked["doc_id"],
        ranked["piece_no"].cast("int").alias("piece_no"),
        (ranked["piece_no"] * ranked["capacity"]).cast("bigint").alias("first_token"),
        ranked["size"].cast("int").alias("size"),
        container.alias("container_id"),
    )
