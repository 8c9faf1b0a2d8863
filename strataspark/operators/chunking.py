"""Chunks of texts under a token budget (CH*, SO6)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line_ends(text: str, limit: int) -> Column:
    """Last lines (from 1) of the chunks of a text: a fold over its lines that carries the cuts along."""
    lines = F.split(text, "\n", -1)
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("ends"))

    def step(acc: Column, line: Column) -> Column:
        total = acc["total"] + F.floor(F.length(line) / 4)
        pos = acc["pos"] + 1
        full = total >= limit
        return F.struct(
            F.when(full, F.lit(0)).otherwise(total).cast("bigint").alias("total"), pos.alias("pos"), F.when(full, F.array_append(acc["ends"], pos)).otherwise(acc["ends"]).alias("ends")
        )

    ends = F.aggregate(lines, zero, step, lambda a: F.when((F.size(a["ends"]) > 0) & (F.element_at(F.concat(F.array(F.lit(0)), a["ends"]), -1) == a["pos"]), a["ends"]).otherwise(F.array_append(a["ends"], a["pos"])))
    return ends


def _spans(ends: Column) -> Column:
    return F.transform(ends, lambda e, i: F.struct((F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)) + 1).alias("start_line"), e.alias("end_line")))


def line_chunks(texts: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """CH1: lines are added until their tokens reach the limit; a line is counted before the cut, so a
    chunk may exceed it. Tokens are a quarter of the characters.

    Columns: key, chunk_no, start_line, end_line (from 1, inclusive).
    """
    cut = texts.select(key, _line_ends(text, limit).alias("ends"))
    return cut.select(key, F.posexplode(_spans(F.col("ends"))).alias("chunk_no", "c")).select(key, "chunk_no", "c.start_line", "c.end_line")


def materialised(texts: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """CH7: the chunks of CH1 with their content and its tokens. The contents are cut inside the row of
    their text, so no text is copied to its chunks and nothing is joined."""
    cut = texts.select(key, F.split(text, "\n", -1).alias("lines"), _line_ends(text, limit).alias("ends"))
    whole = F.transform(
        _spans(F.col("ends")),
        lambda c: F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), F.array_join(F.slice("lines", c["start_line"], c["end_line"] - c["start_line"] + 1), "\n").alias("content")),
    )
    rows = cut.select(key, whole.alias("cs")).select(key, F.posexplode("cs").alias("chunk_no", "c"))
    return rows.select(key, "chunk_no", "c.start_line", "c.end_line", "c.content", F.floor(F.length("c.content") / 4).cast("bigint").alias("tokens"))


def token_slices(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """CH6: fixed numbers of blank-separated tokens."""
    tokens = F.split(text, " ", -1)
    n = F.ceil(F.size(tokens) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i * size + 1, F.lit(size)), " "))
    return texts.select(key, F.posexplode(parts).alias("slice_no", "slice"))


def merge_adjacent(a: DataFrame, key: str) -> DataFrame:
    """CH5, JN12: each chunk with the one that begins right behind it, as one."""
    b = a.select(F.col(key), (F.col("start_line") - 1).alias("end_line"), F.col("end_line").alias("new_end"), F.col("chunk_no").alias("next_no"))
    return a.join(b, [key, "end_line"]).select(key, "chunk_no", "next_no", "start_line", F.col("new_end").alias("end_line"))


def merge_contents(chunks: DataFrame, key: str) -> DataFrame:
    """CH5: each chunk with the one right behind it as one: contents line by line, the first name that is not
    empty. Every row meets its neighbour by the line where it begins, in one window over the text."""
    w = Window.partitionBy(key).orderBy("start_line")
    after = F.lead(F.struct("chunk_no", "start_line", "end_line", "content", "name")).over(w)
    rows = chunks.withColumn("after", after).where(F.col("after.start_line") == F.col("end_line") + 1)
    return rows.select(
        key, "chunk_no", F.col("after.chunk_no").alias("next_no"), "start_line", F.col("after.end_line").alias("end_line"),
        F.coalesce(F.nullif("name", F.lit("")), F.col("after.name")).alias("name"), F.concat("content", F.lit("\n"), F.col("after.content")).alias("content"),
    )


def split_after(kind: Column, lines: Column) -> Column:
    """CH3 as an expression: how many lines stay in the first part; null where there is no point. Behind the
    first line of a function that returns or yields, before the first method of a class; no part is empty (CH4)."""
    places = F.transform(lines, lambda x, i: F.struct(F.regexp_replace(x, r"^[ \t]+", "").alias("x"), i.alias("i")))
    out = F.filter(places, lambda p: p["x"].rlike("^(?:return|yield)") & (p["i"] + 1 < F.size(lines)))
    method = F.filter(places, lambda p: p["x"].startswith("def ") & (p["i"] > 0))
    return F.when(kind == "function", F.get(out, F.lit(0))["i"] + 1).when(kind == "class", F.get(method, F.lit(0))["i"])


def split_chunks(chunks: DataFrame, at: Column) -> DataFrame:
    """CH4: every chunk in two parts, the first of ``at`` lines, with their own line ranges. Chunks for which
    ``at`` leaves a part empty are left out."""
    lines = F.split("content", "\n", -1)
    n = F.size(lines)
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("start_line").alias("start_line"), (F.col("start_line") + at - 1).alias("end_line"), F.array_join(F.slice(lines, F.lit(1), at), "\n").alias("content")),
        F.struct(F.lit(1).alias("part"), (F.col("start_line") + at).alias("start_line"), F.col("end_line").alias("end_line"), F.array_join(F.slice(lines, at + 1, n - at), "\n").alias("content")),
    )
    rest = [c for c in chunks.columns if c not in ("start_line", "end_line", "content", "tokens")]
    return chunks.where((at > 0) & (at < n)).select(*rest, F.explode(parts).alias("p")).select(*rest, "p.*")


CODE_CHUNKS = "file_id bigint, start_line int, end_line int, kind string, name string"


def split_point(kind: str, lines: list[str]) -> int | None:
    """CH3: behind the first return or yield of a function, before the first method of a class; a
    point that leaves a part empty is none (CH4)."""
    for i, line in enumerate(map(str.strip, lines)):
        if kind == "function" and line.startswith(("return", "yield")) and i + 1 < len(lines):
            return i + 1
        if kind == "class" and line.startswith("def ") and i > 0:
            return i
    return None


def python_chunks(files: DataFrame, limit: int | None = None) -> DataFrame:
    """CH2: one chunk for each top-level function or class of a Python file, and one for each run of
    other statements between them. Files that do not parse have none.

    With ``limit``, functions and classes at any depth have their chunk too, and those of so many
    tokens (a quarter of the characters) or more are split by CH3 as long as there is a point.
    """

    def parts(lines: list[str], start: int, end: int, kind: str, name: str) -> Iterator[tuple[int, int, str, str]]:
        sizes = [len(x) for x in lines[start - 1 : end]]
        left = sum(sizes) + len(sizes) - 1
        while left // 4 >= limit:
            at = split_point(kind, lines[start - 1 : end])
            if at is None:
                break
            yield start, start + at - 1, kind, name
            left -= sum(sizes[:at]) + at
            sizes, start = sizes[at:], start + at
        yield start, end, kind, name

    def every(code: str) -> Iterator[tuple[int, int, str, str | None]]:
        import ast
        import re

        try:
            tree = ast.parse(code.lstrip("﻿"))
        except (SyntaxError, ValueError, RecursionError):
            return
        yield from (c for c in cut(code) if c[2] == "module")
        lines = re.split(r"\r\n|\r|\n", code.lstrip("﻿"))  # the lines that the parser counts
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                yield from parts(lines, start, node.end_lineno, "class" if isinstance(node, ast.ClassDef) else "function", node.name)

    def cut(code: str) -> Iterator[tuple[int, int, str, str | None]]:
        import ast

        try:
            body = ast.parse(code.lstrip("﻿")).body
        except (SyntaxError, ValueError, RecursionError):
            return
        run: list[int] = []
        for node in body:
            kind = {"FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class"}.get(type(node).__name__)
            start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            if kind is None:
                run = [run[0] if run else start, node.end_lineno]
                continue
            if run:
                yield run[0], run[1], "module", None
                run = []
            yield start, node.end_lineno, kind, node.name
        if run:
            yield run[0], run[1], "module", None

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("kind", pa.string()), ("name", pa.string())])
        for batch in batches:
            rows = [(f, *c) for f, code in zip(*(x.to_pylist() for x in batch.columns), strict=True) if code for c in (cut(code) if limit is None else every(code))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select(F.col("file_id").cast("bigint"), F.col("code").cast("string")).mapInArrow(visit, CODE_CHUNKS)


def fitting(items: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """SO6: takes the items of each key in order while they fit; one that does not fit is passed over.

    ``items``: keys, order, id, tokens. Gives the rows that are taken: keys, id. Items of no tokens always
    fit. Of items of one size no more can be taken than the budget holds, and always the first ones, so a
    key folds a number of items that the budget bounds, however many it has.
    """
    known = items.where(F.col("tokens") <= budget)
    free = known.where("tokens = 0").select(*keys, "id")
    like = Window.partitionBy(*keys, "tokens").orderBy("order")
    some = known.where("tokens > 0").withColumn("nth", F.row_number().over(like)).where(F.col("nth") * F.col("tokens") <= budget)
    line = F.array_sort(F.collect_list(F.struct("order", "id", F.col("tokens").cast("bigint").alias("tokens"))))
    kind = items.schema["id"].dataType.simpleString()
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["used"] + x["tokens"] > budget, acc).otherwise(F.struct((acc["used"] + x["tokens"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids")))

    taken = some.groupBy(*keys).agg(line.alias("line")).select(*keys, F.explode(F.aggregate("line", zero, step, lambda a: a["ids"])).alias("id"))
    return free.unionByName(taken)
