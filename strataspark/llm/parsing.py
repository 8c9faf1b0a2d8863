"""Source files that do not parse (problem 3).

Each language has a lexer and a parsing expression grammar (see ``grammars``); a file parses if its
grammar consumes all of it. The packrat memo is kept in the Python worker and keyed by content, so a
statement or bracket pair that occurs in many files is parsed once. For a file that fails, the
furthest position that any rule could still have completed is reported, and what stands there.

Defined cases
    * Null and blank code, files of no known language, yaml, ini and dotenv always parse.
    * A leading byte-order mark is no part of the code; positions count from before it.
    * The language is the given one, trimmed and in lower case, by the alias table; where it is
      null, that of the last suffix of the path.
    * Redelivered files count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grammars
from .batches import sliced
from .peg import BASE, BRACKETS, NEWLINE, UNKNOWN, furthest

CHECKED = ("python", "javascript", "typescript", "java", "go", "cpp", "json", "css", "html")
RESULT = "file_id bigint, project_id string, language string, parses boolean, position bigint, cause string"
FIELDS = pa.schema(
    [("file_id", pa.int64()), ("project_id", pa.string()), ("language", pa.string()), ("parses", pa.bool_()), ("position", pa.int64()), ("cause", pa.string())]
)
BLANK = "﻿ \t\r\n\f\v\xa0"


class Checker:
    """The grammars of one Python worker, made when first used."""

    def __init__(self) -> None:
        self.made: dict[str, object] = {}

    def get(self, language: str):
        if language not in self.made:
            if language == "python":
                self.made[language] = grammars.PythonGrammar()
            elif language == "html":
                self.made[language] = grammars.HtmlGrammar()
            else:
                self.made[language] = grammars.MAKERS[language]()
        return self.made[language]

    def check(self, language: str, code: str, place: bool = True) -> tuple[int, str] | None:
        """None if the code parses, else where and why not; without ``place`` only that it does not."""
        if language not in CHECKED or not code.strip(BLANK):
            return None
        body = code.lstrip("﻿")
        made = self.get(language)
        if language == "html":
            found = made.place(body)
        elif language == "python":
            found = None if made.parses(body) else _python_place(made, body) if place else (0, "")
        else:
            grammar, lex, table, prepare = made
            kinds = prepare(body, table)
            found = None if grammar.parses(kinds) else _place(grammar, lex, table, kinds, body) if place else (0, "")
        if found is None:
            return None
        return found[0] + len(code) - len(body), found[1]


_CHECKER = Checker()


def _cause(code: str, at: int, said: str) -> str:
    m = grammars.MERGE.search(code)
    if m is not None and said != "other language":
        return "merge conflict"
    if not code[at:].strip(BLANK):
        return "truncated"
    return said


def _place(grammar, lex, table, kinds: str, code: str) -> tuple[int, str]:
    """The furthest failure: of the first bracket pair that no rule consumes, or of the outermost level."""
    raw = [(table[m[1]], m.start(1)) for m in lex.finditer(code)]
    semi = grammar.kinds.get(";", "")
    marks: list[tuple[str, int]] = []
    j = 0
    for i, (kind, at) in enumerate(raw):
        if j == len(kinds):
            break
        if kind and kind == kinds[j]:
            marks.append((kind, at))
            j += 1
        elif kind == NEWLINE and kinds[j] == semi and (i + 1 == len(raw) or raw[i + 1][0] not in (semi, NEWLINE, "")):
            marks.append((semi, at))
            j += 1
    at, said = _furthest(grammar, marks, len(code))
    return at, _cause(code, at, said)


def _furthest(grammar, marks: list[tuple[str, int]], size: int) -> tuple[int, str]:
    names = {o: k for k, (o, _) in BRACKETS.items()}
    levels: list[list[tuple[str, int]]] = [[]]
    opened: list[tuple[str, int]] = []
    for kind, at in marks:
        if kind in "([{":
            opened.append((kind, at))
            levels.append([])
        elif kind in ")]}":
            if not opened or BRACKETS[names[opened[-1][0]]][1] != kind:
                return at, f"unmatched {kind}"
            o, start = opened.pop()
            inner = levels.pop()
            content = grammar.typed("".join(k for k, _ in inner))
            made = grammar.memo[o + "".join(k for k, _ in inner) + kind]
            if ord(made) == BASE[names[o]]:
                best = max((furthest(grammar.sources[f"{names[o]}:{r}"], content) for r in grammar.inside[names[o]]), default=0)
                at = inner[best][1] if best < len(inner) else at
                return at, "unexpected sign" if UNKNOWN in content else "unexpected token"
            levels[-1].append((made, start))
        else:
            levels[-1].append((kind, at))
    if opened:
        return size, f"unclosed {opened[-1][0]}"
    outer = levels[0]
    best = furthest(grammar.sources[""], grammar.typed("".join(k for k, _ in outer)))
    return (outer[best][1] if best < len(outer) else size), "other language" if best <= 1 else "unexpected token"


def _python_place(made, code: str) -> tuple[int, str]:
    """The furthest place in the first line that is none, or the end where only the blocks do not fit."""
    if "\0" in code:
        return code.index("\0"), "unexpected sign"
    depth, first = 0, True
    marks: list[tuple[str, int]] = []
    for m in [*grammars._PY_LEX.finditer(code), None]:
        kind = made.table[m[1]] if m else chr(0x4000)
        at = m.start(1) if m else len(code)
        if not kind:
            continue
        if kind in "([{":
            depth += 1
        elif kind in ")]}":
            depth -= 1
            if depth < 0:
                return at, _cause(code, at, f"unmatched {kind}")
        if "䀀" <= kind <= "俿":
            if depth and m:
                continue
            if marks and made.line(made.lines.reduce("".join(k for k, _ in marks))) == UNKNOWN:
                where, said = _furthest(made.lines, marks, at)
                return where, _cause(code, where, "other language" if first and said == "other language" else "unexpected token" if said == "other language" else said)
            first = first and not marks
            marks = []
        else:
            marks.append((kind, at))
    return len(code), _cause(code, 0, "blocks do not fit")


def language_of(language: Column, path: Column, aliases: dict[str, str]) -> Column:
    """Language by alias table; by the last suffix of the path where none is given."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return table[F.when(language.isNotNull(), F.lower(F.regexp_replace(language, r"^\s+|\s+$", ""))).otherwise(suffix)]


def check_files(files: DataFrame, aliases: dict[str, str], report: bool = True) -> DataFrame:
    """Every file once with the verdict on it. ``report=False`` leaves position and cause out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(f, p, g, *_verdict(g, c, report)) for f, p, g, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

    chosen = files.select(
        F.col("file_id").cast("bigint"), "project_id", language_of(F.col("language"), F.col("file_path"), aliases).alias("language"), F.col("code").cast("string")
    )
    out = chosen.mapInArrow(run, RESULT)
    return out if report else out.drop("position", "cause")


def _verdict(language: str | None, code: str | None, place: bool) -> tuple[bool, int | None, str | None]:
    found = _CHECKER.check(language, code, place) if language and code else None
    return (True, None, None) if found is None else (False, *found)


def rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their share by project and language."""
    return (
        checked.dropDuplicates(["file_id"])
        .groupBy("project_id", "language")
        .agg(F.count("*").alias("n_files"), F.sum((~F.col("parses")).cast("bigint")).alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
