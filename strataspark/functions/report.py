"""Reports of documentation records as Markdown (SF3, SF7, RM14), column expressions over one record."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import anchor, badge, badge_colour, escape_markdown, table_row

#: Where a metric is no longer low, and no longer medium.
THRESHOLDS = {"Complexity": (5, 10), "Volume": (500, 1000), "Difficulty": (5, 10), "Effort": (500, 1000), "Maintainability": (65, 85), "Coverage": (80, 60)}
ALIGNMENT = {"left": ":---", "center": ":---:", "right": "---:"}


def all_badges(metrics: dict[str, Column]) -> Column:
    """SF7: a badge for each metric that is there and not 0, parted by blanks."""

    def one(name: str, value: Column) -> Column:
        low, medium = THRESHOLDS[name]
        return F.when(value != 0, badge(F.lit(name), value, badge_colour(value, F.lit(low), F.lit(medium))))

    return F.concat_ws(" ", *[one(name, value) for name, value in metrics.items()])


def table(headers: list[str], rows: Column, alignment: list[str] | None = None) -> Column:
    """SF3: a Markdown table of an array of arrays of cells; rows are padded and cut to the headers, cells
    are escaped, and no rows give an empty text."""
    n = len(headers)
    line = F.array_join(F.array(table_row([escape_markdown(F.lit(h)) for h in headers]), F.lit("| " + " | ".join(ALIGNMENT.get(a, ":---") for a in (alignment or ["left"] * n)) + " |")), "\n")

    def row(cells: Column) -> Column:
        full = F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), 1, n)
        return F.concat(F.lit("| "), F.array_join(F.transform(full, lambda c: escape_markdown(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))

    return F.when(F.size(rows) > 0, F.concat(line, F.lit("\n"), F.array_join(F.transform(rows, row), "\n"))).otherwise(F.lit(""))


def contents(text: Column) -> Column:
    """SF4: the table of contents of a Markdown text, one line for each heading that says something."""
    heads = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.regexp_extract(x, "^(#+)", 1).alias("signs"), F.trim(F.regexp_replace(x, "^#+", "")).alias("title"))), lambda h: (h["signs"] != "") & (h["title"] != ""))
    return F.array_join(F.transform(heads, lambda h: F.concat(F.repeat(F.lit("  "), F.length(h["signs"]) - 1), F.lit("- ["), h["title"], F.lit("](#"), anchor(h["title"]), F.lit(")"))), "\n")


def section(title: str, items: Column) -> Column:
    """A section of items below a heading; null if there are none."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(items, "\n\n")))


def report(name: Column, badges: Column, summary: Column, sections: list[Column]) -> Column:
    """RM14: name, badges, summary and the sections that are there, behind their table of contents."""
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), name), F.nullif(badges, F.lit("")), F.nullif(summary, F.lit("")), *sections)
    return F.concat(F.lit("# Table of Contents\n\n"), contents(body), F.lit("\n\n"), body)


#: UD3: filters that templates may name; more can be put in.
FILTERS = {
    "title": F.initcap,
    "upper": F.upper,
    "lower": F.lower,
    "trim": F.trim,
    "escape": escape_markdown,
}


def render(template: str, values: dict[str, Column], filters: dict | None = None) -> Column:
    """SF27: a template whose ``{{ name|filter|... }}`` places are filled; missing values are empty."""
    known = FILTERS | (filters or {})
    parts = []
    for i, piece in enumerate(re.split(r"\{\{(.*?)\}\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
            continue
        name, *used = (x.strip() for x in piece.split("|"))
        value = values[name].cast("string")
        for f in used:
            value = known[f](value)
        parts.append(F.coalesce(value, F.lit("")))
    return F.concat(*parts)
