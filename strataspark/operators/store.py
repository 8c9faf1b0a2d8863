"""The documentation store: lookup, search, insert, update, history (FL6, FL7, SK3, SK4, SO*, JN*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(store: DataFrame, project: str | None, path: str | None = None, version: str | None = None) -> DataFrame:
    """FL6: rows of a project, narrowed by path and version; none without a project."""
    found = store.where(F.col("project_id") == project) if project is not None else store.where(F.lit(False))
    if path is not None:
        found = found.where(F.col("file_path") == path)
    return found if version is None else found.where(F.col("version") == version)


def _holds(x: Column, query: str) -> Column:
    return F.coalesce(F.lower(x).contains(query.lower()), F.lit(False))


def search(store: DataFrame, query: str) -> DataFrame:
    """FL7: keeps the classes and functions whose name or text holds the query, without regard to case."""
    if not query:
        return store

    def method(m: Column) -> Column:
        return _holds(m["name"], query) | _holds(m["docstring"], query)

    def cls(c: Column) -> Column:
        inner = F.exists(F.coalesce(c["methods"], F.slice(c["methods"], 1, 0)), method)
        return _holds(c["name"], query) | _holds(c["docstring"], query) | F.coalesce(inner, F.lit(False))

    return store.withColumns(
        {"classes": F.filter("classes", cls), "functions": F.filter("functions", lambda f: _holds(f["name"], query) | _holds(f["docstring"], query))}
    )


def insert_absent(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SK3, JN10: rows whose key the store does not have; the rest would be conflicts."""
    return rows.join(store.select(*keys).distinct(), keys, "left_anti")


def update_matched(store: DataFrame, changes: DataFrame, keys: list[str], fields: list[str], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """SK4: the store with the given fields of matching rows replaced where the change has a value, and
    ``stamp`` set to ``now`` in these rows."""
    new = changes.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("_met"))
    joined = store.join(new, keys, "left")

    def field(c: str) -> Column:
        if c in fields:
            return F.coalesce(f"new_{c}", c).alias(c)
        return F.when(F.col("_met"), now).otherwise(F.col(c)).alias(c) if c == stamp else F.col(c)

    return joined.select(*map(field, store.columns))


def absent(store: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """SK4: keys of changes that no row of the store has (404)."""
    return changes.select(*keys).distinct().join(store.select(*keys), keys, "left_anti")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """SO2, SO3: the n newest rows of each key; the rank is cut before the shuffle by the engine."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def valid_cached(cached: DataFrame, nodes: DataFrame, key: str, hashed: str) -> DataFrame:
    """JN8, CC1: each node with its cached document where the hash still agrees, and the outcome."""
    c = cached.select(key, F.col(hashed).alias("cached_hash"), F.col("content").alias("cached"))
    joined = nodes.join(c, (nodes[key] == c[key]) & (nodes[hashed] == F.col("cached_hash")), "left").drop(c[key])
    return joined.withColumn("hit", F.col("cached").isNotNull()).drop("cached_hash")


def changed(old: DataFrame, new: DataFrame, key: str, hashed: str) -> DataFrame:
    """GR7: what a new state adds, changes and removes, by hash."""
    o = old.select(F.col(key).alias("old_key"), F.col(hashed).alias("old_hash"))
    n = new.select(F.col(key).alias("new_key"), F.col(hashed).alias("new_hash"))
    both = o.join(n, F.col("old_key") == F.col("new_key"), "full")
    kind = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    return both.select(F.coalesce("new_key", "old_key").alias(key), kind.alias("change")).where("change is not null")


def read_through(nodes: DataFrame, tiers: list[DataFrame], key: str, hashed: str) -> DataFrame:
    """CC1: each node with what the first tier holds for it under the same hash, and the tier's number
    (from 0; null for a miss). Each tier: key, hash, content; it is asked only by what the earlier ones missed."""
    out = nodes.withColumns({"content": F.lit(None).cast("string"), "tier": F.lit(None).cast("int")})
    for i, tier in enumerate(tiers):
        t = tier.select(F.col(key).alias("_k"), F.col(hashed).alias("_h"), F.col("content").alias("_c"))
        found = F.col("tier").isNull() & F.col("_c").isNotNull()
        joined = out.join(t, (out[key] == t["_k"]) & (out[hashed] == t["_h"]), "left")
        out = joined.withColumns({"content": F.coalesce("content", "_c"), "tier": F.when(found, F.lit(i)).otherwise(F.col("tier"))}).drop("_k", "_h", "_c")
    return out


def invalidated(cached: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """TR6: what a cache keeps after changes (see ``changed``): what changed or went is dropped."""
    return cached.join(changes.where("change in ('changed', 'removed')").select(key), key, "left_anti")


def rejected(store: DataFrame, rows: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """SK3: rows that an insert refuses, with the reason: 400 where a required field is missing, 409 where
    the key is in the store already."""
    there = store.select(*keys, F.lit(True).alias("_there")).distinct()
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    status = F.when(missing, 400).when(F.col("_there"), 409)
    return rows.join(there, keys, "left").withColumn("status", status).drop("_there").where("status is not null")
