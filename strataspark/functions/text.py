"""Text functions as column expressions (SF*, AG16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text: Column, limit: int = 100, ellipsis: str = "...") -> Column:
    """SF1: cut at the last blank before the limit, if there is one after the first character."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.locate(" ", F.reverse(head)).cast("int")  # place of the last blank, from 0
    cut = F.when(head.contains(" ") & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(ellipsis)))


def escape_markdown(text: Column) -> Column:
    """SF2: signs with a meaning are escaped, line ends and runs of blanks become one blank."""
    escaped = F.regexp_replace(text, r"([`*_{}\[$()#+\-.!|])", r"\\$1")
    return F.trim(F.regexp_replace(F.replace(escaped, F.lit("\r"), F.lit("")), r"[ \t\n]+", " "))


def heading_level(line: Column) -> Column:
    """SF4: number of signs of a heading line, 0 for other lines."""
    return F.length(F.regexp_extract(line, r"^(#+)", 1))


def anchor(title: Column) -> Column:
    """SF4: anchor of a heading: lower case, word signs of any script, dashes for blanks."""
    return F.replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\- ]", ""), F.lit(" "), F.lit("-"))


def table_row(cells: list[Column]) -> Column:
    """SF3: one row of a Markdown table; null cells are empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def badge_colour(value: Column, low: Column, medium: Column, higher_is_better: bool = False) -> Column:
    """SF5: colour of a metric badge."""
    if higher_is_better:
        return F.when(value >= low, "success").when(value >= medium, "yellow").otherwise("critical")
    return F.when(value <= low, "success").when(value <= medium, "yellow").otherwise("critical")


def badge(name: Column, value: Column, colour: Column) -> Column:
    """SF6: Markdown of a badge; the name in title case with encoded blanks."""
    title = F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("%20"))
    return F.concat(F.lit("!["), title, F.lit("](https://img.shields.io/badge/"), title, F.lit("-"), F.format_string("%.2f", value), F.lit("-"), colour, F.lit(")"))


def estimated_tokens(text: Column) -> Column:
    """SF8: a quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def metric_status(value: Column, threshold: Column) -> Column:
    """SF15: grey without value, red from 1.2 times the threshold on, yellow from the threshold on."""
    return F.when(value.isNull(), "grey").when(value >= 1.2 * threshold, "red").when(value >= threshold, "yellow").otherwise("green")


def fixed(value: Column, digits: int = 2) -> Column:
    """SF16: fixed digits, N/A without value."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise(F.lit("N/A"))


def signature_key(name: Column, args: Column) -> Column:
    """SF17: key of a function's signature."""
    return F.md5(F.concat(name, F.lit("("), F.array_join(args, ", "), F.lit(")")))


def fix_docstring(text: Column) -> Column:
    """SF21: blanks at line ends, runs of empty lines, missing capital and missing stop are put right."""
    tidy = F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    capital = F.concat(F.upper(F.substring(tidy, 1, 1)), F.substr(tidy, F.lit(2)))
    return F.when(capital.rlike(r"[.!?:`)]\s*$") | (capital == ""), capital).otherwise(F.concat(capital, F.lit(".")))


def format_google(summary: Column, args: Column) -> Column:
    """SF22: summary and an ``Args:`` section with a line for each argument."""
    lines = F.transform(F.coalesce(args, F.array().cast("array<string>")), lambda a: F.concat(F.lit("    "), a))
    section = F.when(F.size(lines) > 0, F.concat(F.lit("\n\nArgs:\n"), F.array_join(lines, "\n"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(summary, F.lit("")), section)


def occurrences(text: Column, part: str) -> Column:
    """AG16: how often a text holds a part, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def signed(value: Column, digits: int = 1) -> Column:
    """SF16: fixed digits with a sign in front of what is above 0; N/A without value."""
    return F.when(value > 0, F.concat(F.lit("+"), fixed(value, digits))).otherwise(fixed(value, digits))


def comment_text(comment: Column) -> Column:
    """SF25: a C++ comment line without its slashes."""
    return F.regexp_replace(comment, r"^[ \t]*///?[ \t]*", "")


def go_type(kind: Column) -> Column:
    """SF26: a Go type as it is printed: pointers, slices and names of a package; ``unknown`` for all else."""
    return F.when(kind.rlike(r"^(?:\*|\[\])*[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?$"), kind).otherwise(F.lit("unknown"))


def duration(seconds: Column) -> Column:
    """SF24: seconds as ``[d day[s], ]h:mm:ss``."""
    s = F.floor(seconds).cast("bigint")
    days = F.floor(s / 86400)
    day = F.when(days == 1, F.lit("1 day, ")).when(days != 0, F.concat(days.cast("string"), F.lit(" days, "))).otherwise(F.lit(""))
    clock = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)
    return F.concat(day, clock)


def comment_lines(text: Column) -> Column:
    """RM11: the lines of a block comment without its marks."""
    body = F.regexp_replace(F.regexp_replace(text, r"^[ \t]*/\*\*[ \t]*\n?", ""), r"\n?[ \t]*\*/[ \t]*$", "")
    return F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"^[ \t]*\* ?", ""))
