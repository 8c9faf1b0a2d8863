"""Docstrings as rows: sections, parameters and their checks (SF18, SF19, VA3, VA4, WN4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .validate import TYPE_NAME

#: Section heads and the sections that they open.
SECTIONS = {"Args": "parameters", "Arguments": "parameters", "Parameters": "parameters", "Returns": "returns", "Raises": "raises", "Example": "examples", "Examples": "examples"}


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every line with its section: ``summary`` up to the first head, then the last head's section.

    A head is a line that is a known word and a colon; it belongs to no section itself. The last head
    is found by a running window over one text's lines.
    """
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)).alias("pos", "line"))
    word = F.regexp_extract(F.trim("line"), r"^([A-Z][a-z]+):$", 1)
    table = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", table[word])
    return marked.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("summary"))).where("head is null").select(key, "pos", "section", "line")


def parameters(lines: DataFrame, key: str) -> DataFrame:
    """SF19: ``name (type): description`` of the lines of a parameters section; type and text may be missing."""
    entry = r"^\s+([A-Za-z_*][A-Za-z0-9_]*)\s*(?:\(([^()]*)\))?:\s*(.*)$"
    found = lines.where((F.col("section") == "parameters") & F.col("line").rlike(entry))
    return found.select(
        key, "pos", F.regexp_extract("line", entry, 1).alias("name"), F.nullif(F.regexp_extract("line", entry, 2), F.lit("")).alias("type"), F.regexp_extract("line", entry, 3).alias("description")
    )


def checked(params: DataFrame) -> DataFrame:
    """VA3, VA4: parameters whose type is no type or whose description is under ten characters."""
    ok_type = F.col("type").isNull() | F.col("type").rlike(TYPE_NAME)
    return params.withColumns({"type_ok": ok_type, "description_ok": F.length(F.trim("description")) >= 10})
