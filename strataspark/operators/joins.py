"""Joins of the document pipeline (JN*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .metrics import BLOCK, numbered

#: Rows that hold an element from which on they are counted by what frequent elements they hold, not paired.
OFTEN = 1_000


def last_by(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """JN1: the last row of each key wins."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), pos).alias("r")).select(*key, "r.*")


def first_by(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """JN2, JN15: the first row of each key wins."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), pos).alias("r")).select(*key, "r.*")


def with_defaults(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """JN7: left join whose missing values are filled."""
    joined = left.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def sharing(left: DataFrame, right: DataFrame, array: str, left_id: str, right_id: str, salts: int = 16) -> DataFrame:
    """JN5: pairs whose arrays share an element: both sides are exploded and joined on the element.

    The pairs are the result, so their number is the output's; the left side is salted and the right one
    repeated for each salt, so that an element of very many arrays is no single task. Spark takes exploded
    rows for no larger than their file, so it is told not to broadcast them.
    """
    salt = F.pmod(F.xxhash64(left_id), F.lit(salts))
    a = left.select(F.col(left_id), F.explode(F.array_distinct(array)).alias("x")).withColumn("salt", salt)
    b = right.select(F.col(right_id), F.explode(F.array_distinct(array)).alias("x")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return a.join(b.hint("merge"), ["x", "salt"]).select(left_id, right_id).distinct()


def sharers(rows: DataFrame, array: str, ident: str) -> DataFrame:
    """JN5 where only numbers are wanted: for each row, how many other rows have an array that shares an
    element with its own: ident, n. Rows of equal arrays are one class; classes meet, not rows.

    A class whose array is not empty holds its own other members; every class pair is found once for
    each shared element and kept once, and adds the size of the other class.
    """
    each = rows.select(ident, F.array_sort(F.array_distinct(array)).alias("elements")).where("size(elements) > 0").withColumn("class", F.xxhash64("elements"))
    classes = each.groupBy("class", "elements").agg(F.count("*").alias("size"))
    met = sharing(classes, classes.withColumnRenamed("class", "other"), "elements", "class", "other")
    sizes = classes.select(F.col("class").alias("other"), "size")
    total = met.join(sizes, "other").groupBy("class").agg((F.sum("size") - 1).alias("n"))
    return each.select(ident, "class").join(total, "class").select(ident, "n")


def later_sharers(rows: DataFrame, array: str, ident: str, often: int = OFTEN, salts: int = 16, block: int = BLOCK) -> DataFrame:
    """JN5 where only numbers are wanted: for each row, how many rows of a greater integer ident have an
    array that shares an element with its own: ident, n; rows without any are left out.

    Rows that share one of the elements of more than ``often`` rows are not paired: those of the same
    frequent elements are one class, and a row's place among all rows of the classes that its own meets is
    the number. Rows meet by the other elements, at most ``often`` at each, where they share no frequent one.
    """
    each = rows.select(F.col(ident).alias("id"), F.explode(F.array_distinct(array)).alias("x")).where("id is not null and x is not null")
    frequent = each.groupBy("x").agg(F.count("*").alias("_n")).where(F.col("_n") > often).select("x", F.lit(True).alias("frequent"))
    split = kept(each.join(frequent, "x", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("frequent"), F.col("x")))).alias("often"), F.collect_list(F.when(F.col("frequent").isNull(), F.col("x"))).alias("seldom")))
    seldom = split.select("id", "often", F.explode("seldom").alias("x"))
    other = seldom.select(F.col("id").alias("other"), F.col("often").alias("other_often"), "x")
    apart = seldom.join(other.hint("merge"), "x").where("id < other and not arrays_overlap(often, other_often)").select("id", "other").distinct()
    paired = apart.groupBy("id").agg(F.count("*").alias("n"))
    marked = split.where("size(often) > 0").select("id", F.xxhash64("often").alias("class"), "often")
    classes = marked.select("class", "often").distinct().select("class", F.explode("often").alias("x"))
    met = classes.join(classes.withColumnRenamed("class", "other").hint("merge"), "x").select("class", "other").distinct()
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    members = marked.select(F.col("class").alias("other"), "id", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    among = met.withColumn("salt", salt).join(members.hint("merge"), ["other", "salt"]).select("class", "id", (F.col("class") == F.col("other")).alias("own"), (-F.col("id")).alias("down"))
    placed = numbered(among, "class", "down", block).where("own").select("id", (F.col("n") - 1).alias("n"))
    return paired.unionByName(placed).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").withColumnRenamed("id", ident)


def overlaps(rows: DataFrame, key: str, start: str, end: str, ident: str, width: int) -> DataFrame:
    """JN11: pairs of one key whose ranges overlap. Ranges are spread over bins of a width; pairs meet in
    the first bin that both reach, so each is found once and no key is compared with all of itself."""
    bins = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    spread = rows.select(key, start, end, ident).withColumn("bin", bins)
    a = spread.select(key, "bin", *[F.col(c).alias(f"a_{c}") for c in (start, end, ident)])
    b = spread.select(key, "bin", *[F.col(c).alias(f"b_{c}") for c in (start, end, ident)])
    first = F.floor(F.greatest(f"a_{start}", f"b_{start}") / width)
    met = (F.col(f"a_{ident}") < F.col(f"b_{ident}")) & (F.col(f"a_{start}") <= F.col(f"b_{end}")) & (F.col(f"b_{start}") <= F.col(f"a_{end}")) & (F.col("bin") == first)
    return a.join(b, [key, "bin"]).where(met).select(key, f"a_{ident}", f"b_{ident}")


def adjacent(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """JN12: rows whose successor in the key begins right behind them."""
    w = Window.partitionBy(key).orderBy(start, end)
    return rows.withColumn("next_start", F.lead(start).over(w)).where(F.col(end) + 1 == F.col("next_start"))


def _pieces(text: str, size: int) -> Column:
    """Distinct parts of a length; of shorter texts none."""
    n = F.length(text) - (size - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, names: DataFrame, name: str, salts: int = 8) -> DataFrame:
    """JN4: texts that hold a name, of whatever length; an empty name is in every text.

    A name can only lie in a text that has one of the name's three-letter pieces, so both sides meet on
    the piece of the name that fewest texts have, instead of every text meeting every name. Names of one
    or two letters meet on themselves. Texts are salted and names repeated, so a frequent piece is no
    single task.
    """
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    # texts that are alike are looked through once
    known = texts.select(F.col(text).alias("_t")).where("_t is not null").distinct().withColumn("salt", F.pmod(F.xxhash64("_t"), F.lit(salts)))
    wanted = names.select(F.col(name).alias("_n")).where("_n is not null").distinct()
    held = known.select("_t", "salt", F.explode(_pieces("_t", 3)).alias("piece"))
    often = held.groupBy("piece").agg(F.count("*").alias("often"))
    long = wanted.where("length(_n) >= 3").select("_n", F.explode(_pieces("_n", 3)).alias("piece"))
    rarest = long.join(often, "piece").groupBy("_n").agg(F.min_by("piece", F.struct("often", "piece")).alias("piece"))
    met = held.join(rarest.withColumn("salt", salt), ["piece", "salt"]).where("contains(_t, _n)").select("_t", "_n")
    short = wanted.where("length(_n) < 3").select("_n", F.col("_n").alias("piece")).withColumn("salt", salt)
    parts = known.select("_t", "salt", F.explode(F.concat(_pieces("_t", 1), _pieces("_t", 2), F.array(F.lit("")))).alias("piece"))
    met = met.unionByName(parts.join(short, ["piece", "salt"]).select("_t", "_n"))
    return texts.join(met, F.col(text) == F.col("_t")).drop("_t").join(names, F.col(name) == F.col("_n")).drop("_n")


def first_match(conditions: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """SO5: value of the first condition that holds."""
    out = otherwise
    for condition, value in reversed(conditions):
        out = F.when(condition, value).otherwise(out)
    return out


def every_match(declarations: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """JN3: every document of a declaration, not the first one only."""
    return declarations.join(docs, keys)


def two_level(docs: DataFrame, members: DataFrame, outer: list[str], name: str, inner: str) -> DataFrame:
    """JN6: class by class, then method by method inside it: rows whose class is in both (``matched`` tells
    whether the method is as well). Both: the outer keys, ``name`` (class), ``inner`` (method), and their own columns."""
    classes = members.select(*outer, name).distinct()
    own = [c for c in members.columns if c not in (*outer, name, inner)]
    there = members.withColumn("matched", F.lit(True)).select(*outer, name, inner, *own, "matched")
    return docs.join(classes, [*outer, name], "left_semi").join(there, [*outer, name, inner], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def looked_up(rows: DataFrame, table: DataFrame, key: str, order: str, value: str, otherwise: Column) -> DataFrame:
    """JN14, JN15: the first row of a table for a key, and something else where there is none."""
    first = table.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key, "left").withColumn(value, F.coalesce(F.col(value), otherwise))


def merged(left: Column, right: Column) -> Column:
    """PJ3: two maps as one, the right one wins."""
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(b, a))
