"""Docstrings read, checked, put right and written (SF19, SF21, SF22, VA3, VA7), within their row.

Everything is a column expression over the lines of one docstring, so nothing is shuffled.

Defined cases
    * A null or empty docstring has no sections; it has the one error ``Empty docstring``.
    * Of a section that comes more than once, the last one that has lines counts.
    * Sections that are missing give no rows; the pipeline reads a missing return as type ``None``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import TYPE_NAME

#: The words that open a section, and its name.
HEADS = {"args": "parameters", "arguments": "parameters", "parameters": "parameters", "returns": "returns", "raises": "raises", "examples": "examples"}
#: The rewrites of the repair, in their order.
FIXES = [
    (r"\n\s*\n\s*\n", "\n\n"),
    (r"^(\s*[A-Za-z]+:)\s*([A-Z])", "$1\n    $2"),
    (r"\n\s{4,}", "\n    "),
    (r'"""[\s\n]*', '"""'),
    (r'[\s\n]*"""$', '"""'),
]
BLANKS = r"^[ \t\r\n\f]+|[ \t\r\n\f]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def marked_lines(text: Column) -> Column:
    """Lines of a docstring with the section that they are in and its number: array<section, block, line>."""
    table = F.create_map(*[F.lit(x) for pair in HEADS.items() for x in pair])
    lines = F.transform(F.split(text, "\n", -1), stripped)
    zero = F.struct(F.lit("summary").alias("section"), F.lit(0).alias("block"), F.array().cast("array<struct<section:string,block:int,line:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        head = F.when(line.endswith(":"), table[F.lower(F.regexp_replace(line, ":+$", ""))])
        row = F.struct(acc["section"].alias("section"), acc["block"].alias("block"), line.alias("line"))
        return F.struct(F.coalesce(head, acc["section"]).alias("section"), (acc["block"] + F.when(head.isNotNull(), 1).otherwise(0)).alias("block"), F.when(head.isNotNull(), acc["out"]).otherwise(F.array_append(acc["out"], row)).alias("out"))

    return F.aggregate(lines, zero, step, lambda acc: acc["out"])


def section(marked: Column, name: str) -> Column:
    """Content of a section; null if it is not there."""
    own = F.filter(marked, lambda x: x["section"] == name)
    last = F.array_max(F.transform(own, lambda x: x["block"]))
    content = F.array_join(F.transform(F.filter(own, lambda x: x["block"] == last), lambda x: x["line"]), "\n")
    return F.when(F.size(own) > 0, stripped(content))


def _entries(content: Column, typed: bool) -> Column:
    """Entries ``name: ...`` with the lines that continue them: array<name, type, description>."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), stripped), lambda x: x != "")
    zero = F.array().cast("array<struct<name:string,type:string,description:string>>")

    def step(acc: Column, line: Column) -> Column:
        at = F.locate(":", line)
        rest = stripped(F.substr(line, at + 1))
        gap = F.locate("  ", rest)
        kind = F.when(gap > 0, stripped(F.substr(rest, F.lit(1), gap - 1))).otherwise(rest) if typed else F.lit(None).cast("string")
        said = F.when(gap > 0, stripped(F.substr(rest, gap + 2))).otherwise(F.lit("")) if typed else rest
        new = F.struct(stripped(F.substr(line, F.lit(1), at - 1)).alias("name"), kind.alias("type"), said.alias("description"))
        last = F.element_at(acc, -1)
        longer = F.struct(last["name"].alias("name"), last["type"].alias("type"), F.concat(last["description"], F.lit(" "), line).alias("description"))
        return F.when(at > 0, F.array_append(acc, new)).when(F.size(acc) > 0, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(acc)

    return F.when(content.isNotNull(), F.aggregate(lines, zero, step)).otherwise(zero)


def parameters(marked: Column) -> Column:
    """SF19: name, type and description, parted by two blanks; other lines continue the description."""
    return _entries(section(marked, "parameters"), True)


def raises(marked: Column) -> Column:
    """SF19: exceptions (name) and their descriptions."""
    return _entries(section(marked, "raises"), False)


def returns(marked: Column) -> Column:
    """SF19: type and description of the return; ``None`` where there is no type, or no section."""
    content = section(marked, "returns")
    at = F.locate(":", content)
    typed = F.struct(stripped(F.substr(content, F.lit(1), at - 1)).alias("type"), stripped(F.substr(content, at + 1)).alias("description"))
    bare = F.struct(F.lit("None").alias("type"), F.coalesce(F.nullif(content, F.lit("")), F.lit("No return value.")).alias("description"))
    return F.when(at > 0, typed).otherwise(bare)


def examples(marked: Column) -> Column:
    """SF19: code between fences, each block one example; a fence left open counts if lines follow it."""
    lines = F.split(section(marked, "examples"), "\n", -1)
    zero = F.struct(F.lit(False).alias("inside"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.startswith("```")
        last = F.array_append(F.element_at(acc["out"], -1), line)
        opened = F.array_append(acc["out"], F.array().cast("array<string>"))
        put = F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), last)
        return F.struct(
            F.when(fence, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"),
            F.when(fence & ~acc["inside"], opened).when(~fence & acc["inside"], put).otherwise(acc["out"]).alias("out"),
        )

    def close(acc: Column) -> Column:
        open_and_empty = acc["inside"] & (F.size(F.element_at(acc["out"], -1)) == 0)
        return F.transform(F.when(open_and_empty, F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)).otherwise(acc["out"]), lambda x: F.array_join(x, "\n"))

    return F.coalesce(F.aggregate(lines, zero, step, close), F.array().cast("array<string>"))


def type_errors(kind: Column, where: Column) -> Column:
    """VA4: what is wrong with a type, after ``where``; null if nothing is."""
    none = F.lower(kind).isin("none", "nonetype")
    return F.when(none, None).when(kind == "", F.concat(where, F.lit("Empty type string"))).when(~kind.rlike(TYPE_NAME), F.concat(where, F.lit("Invalid type format: "), kind))


def errors(summary: Column, params: Column, result: Column) -> Column:
    """VA3: every error of a parsed docstring, in order."""

    def of_param(p: Column) -> Column:
        name = F.concat(F.lit("Parameter "), p["name"])
        return F.array(type_errors(p["type"], F.concat(name, F.lit(": "))), F.when(F.length(stripped(p["description"])) < 10, F.concat(name, F.lit(" description too short"))))

    own = F.array(
        type_errors(result["type"], F.lit("Return type: ")),
        F.when(F.length(stripped(result["description"])) < 10, "Return missing or too short description"),
        F.when(F.length(stripped(summary)) < 10, "Summary too short (minimum 10 characters)"),
    )
    return F.array_compact(F.concat(F.flatten(F.transform(params, of_param)), own))


def fixed(text: Column) -> Column:
    """SF21: the docstring after the rewrites and the numbers of those that changed it: struct<text, changes>."""
    changes, now = [], text
    for i, (pattern, replacement) in enumerate(FIXES):
        after = F.regexp_replace(now, pattern, replacement)
        changes.append(F.when(after != now, F.lit(i)))
        now = after
    return F.struct(now.alias("text"), F.array_compact(F.array(*changes)).alias("changes"))


def pipeline(rows: DataFrame, key: str, text: str) -> DataFrame:
    """VA7: put right, read and check: key, valid, errors; rewrites are named behind the errors. Each step is
    a column of its own, so that none is computed more than once."""
    empty = F.col("t").isNull() | (F.col("t") == "")
    steps = rows.select(key, F.col(text).alias("t")).withColumn("f", fixed(F.coalesce("t", F.lit(""))))
    steps = steps.withColumn("m", marked_lines(F.col("f.text")))
    steps = steps.withColumns({"s": F.coalesce(section(F.col("m"), "summary"), F.lit("")), "p": parameters(F.col("m")), "r": returns(F.col("m"))})
    steps = steps.withColumn("found", errors(F.col("s"), F.col("p"), F.col("r")))
    done = F.concat("found", F.transform("f.changes", lambda i: F.concat(F.lit("Applied fix "), i.cast("string"))))
    return steps.select(
        key, F.when(empty, F.lit(False)).otherwise(F.size("found") == 0).alias("valid"), F.when(empty, F.array(F.lit("Empty docstring"))).otherwise(done).alias("errors")
    )


# --- writing --------------------------------------------------------------------------------------


def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.flatten(F.array(*parts))), "\n")


def _when(condition: Column, *lines: str) -> Column:
    return F.array(*[F.when(condition, F.lit(line)) for line in lines])


def numpy(summary: Column, params: Column, result: Column) -> Column:
    """SF22: NumPy's form. ``params``: array<name, type, description>; ``result``: text of the return or null."""
    each = F.flatten(F.transform(params, lambda p: F.array(F.concat(p["name"], F.lit(" : "), F.coalesce(p["type"], F.lit("Any"))), F.concat(F.lit("    "), F.coalesce(p["description"], F.lit(""))))))
    body = _lines(F.array(summary, F.lit("")), _when(F.size(params) > 0, "Parameters", "----------"), each, _when(result.isNotNull(), "", "Returns", "-------"), F.array(result))
    return F.concat(body, F.lit("\n"))


def jsdoc(summary: Column, params: Column, kind: Column, result: Column) -> Column:
    """SF22: JSDoc; types in braces, ``*`` for none."""
    each = F.transform(params, lambda p: F.concat(F.lit(" * @param {"), F.coalesce(p["type"], F.lit("*")), F.lit("} "), p["name"], F.lit(" "), F.coalesce(p["description"], F.lit(""))))
    back = F.when(kind.isNotNull() | result.isNotNull(), F.concat(F.lit(" * @returns {"), F.coalesce(kind, F.lit("*")), F.lit("} "), F.coalesce(result, F.lit(""))))
    return _lines(F.array(F.lit("/**"), F.concat(F.lit(" * "), summary)), _when(F.size(params) > 0, " *"), each, F.array(back, F.lit(" */")))


def tsdoc(summary: Column, params: Column, result: Column) -> Column:
    """SF22: TSDoc; names and descriptions parted by a dash."""
    each = F.transform(params, lambda p: F.concat(F.lit(" * @param "), p["name"], F.lit(" - "), F.coalesce(p["description"], F.lit(""))))
    has = F.size(params) > 0
    return _lines(
        F.array(F.lit("/**"), F.concat(F.lit(" * "), summary)), _when(summary.isNotNull(), " *"), each, _when(has, " *"), F.array(F.concat(F.lit(" * @returns "), result), F.lit(" */"))
    )


def generic(summary: Column, params: Column, kind: Column, result: Column) -> Column:
    """SF22: the plain form."""
    each = F.transform(params, lambda p: F.concat(F.lit("  "), p["name"], F.lit(" ("), F.coalesce(p["type"], F.lit("")), F.lit("): "), F.coalesce(p["description"], F.lit(""))))
    return _lines(F.array(summary), _when(F.size(params) > 0, "", "Parameters:"), each, _when(result.isNotNull(), "", "Returns:"), F.array(F.concat(F.lit("  "), F.coalesce(kind, F.lit("")), F.lit(": "), result)))
