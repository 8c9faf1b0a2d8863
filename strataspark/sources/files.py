"""Trees of files as tables, and tables as trees of files (SC*, SK*, FL1-FL5)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """SC1, SC2: every file below a folder: path relative to it, and content; bytes that are no UTF-8 are replaced."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace("path", r"^.*?" + "\\Q" + base + "\\E", "")
    return reader.load(root).select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def ignore_lines(lines: DataFrame) -> DataFrame:
    """SC4: patterns of an ignore file without blanks and comments."""
    text = F.trim("value")
    return lines.select(text.alias("pattern")).where((F.length("pattern") > 0) & ~F.col("pattern").startswith("#"))


def glob_pattern(glob: str) -> str:
    """FL3: an ignore pattern as a regular expression over a whole path.

    ``*`` and ``?`` stay inside a part, ``**`` goes over parts. A pattern with a slash inside is held to
    the root, others match a part anywhere; what is below a match is matched as well, and a slash at the
    end asks for a folder.
    """
    folder = glob.endswith("/")
    body = glob.strip("/")
    rooted = "/" in glob.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" + body[i + 2 : end] if body[i + 1] in "!^" else body[i + 1 : end]) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.+$" if folder else "(?:/.*)?$")


def ignored(path: Column, globs: list[str]) -> Column:
    """FL5: whether a path is ignored: of the patterns that match, the last one decides, and one that
    begins with ``!`` takes a path back."""
    out = F.lit(False)
    for glob in globs:
        back = glob.startswith("!")
        out = F.when(path.rlike(glob_pattern(glob[1:] if back else glob)), F.lit(not back)).otherwise(out)
    return out


def visible(path: Column, folders: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), globs: tuple[str, ...] = ()) -> Column:
    """FL1-FL5: no part begins with a dot or is an excluded folder, the last suffix is not skipped, no glob matches."""
    parts = F.split(path, "/")
    keep = ~F.exists(parts, lambda p: p.startswith("."))
    if folders:
        keep &= ~F.arrays_overlap(parts, F.array(*[F.lit(f) for f in folders]))
    if suffixes:
        keep &= ~F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*[s.lower() for s in suffixes])
    return keep & ~ignored(path, list(globs)) if globs else keep


def write_by_project(docs: DataFrame, path: str) -> None:
    """SK1: one folder for each project, JSON lines; files keep their full path as key."""
    docs.write.partitionBy("project_id").mode("overwrite").json(path)


def sorted_json(fields: list[str]) -> Column:
    """SO7: a record as JSON with its keys in order, indented."""
    return F.to_json(F.struct(*sorted(fields)), {"pretty": "true"})


def write_text(pages: DataFrame, column: str, path: str) -> None:
    """SK2: Markdown, one page to a line block."""
    pages.select(column).write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, folder: str, column: str, path: str) -> None:
    """SK2: Markdown, one folder for each value of ``folder``."""
    pages.select(folder, column).write.partitionBy(folder).mode("overwrite").text(path)
