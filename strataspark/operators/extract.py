"""Code structure as rows (EX*, GR1, IN1, IN2, UD1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts and comments of a family of languages, taken out before declarations are looked for. The
#: quantifiers are possessive, so that long texts need no deep stack.
_TEXTS = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
_SCRIPTS = rf"{_TEXTS}|`(?:[^`\\]++|\\.)*+`|//[^\n]*+|(?s:/\*.*?\*/)"
_CLIKE = rf"{_TEXTS}|//[^\n]*+|(?s:/\*.*?\*/)"
_PYTHON = rf"(?s:\"\"\".*?\"\"\")|(?s:'''.*?''')|{_TEXTS}|#[^\n]*+"
HIDDEN = {"python": _PYTHON, "javascript": _SCRIPTS, "typescript": _SCRIPTS, "java": _CLIKE, "go": rf"{_TEXTS}|`[^`]*+`|//[^\n]*+|(?s:/\*.*?\*/)", "cpp": _CLIKE, "css": rf"{_TEXTS}|(?s:/\*.*?\*/)"}

#: Declarations of languages without a parser in Spark: kind and pattern, read by the engine's own
#: regular expressions outside comments and texts. They take a declaration by its first words.
DECLARATIONS = {
    "python": {"function": r"\bdef\s+([A-Za-z_][A-Za-z0-9_]*)", "class": r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)", "raises": r"\braise\s+([A-Za-z_][A-Za-z0-9_]*)"},
    "javascript": {"function": r"\bfunction\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", "class": r"\bclass\s+([A-Za-z_$][A-Za-z0-9_$]*)", "arrow": r"\bconst\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\([^()]*\)\s*=>"},
    "typescript": {"function": r"\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", "class": r"\bclass\s+([A-Za-z_$][A-Za-z0-9_$]*)", "interface": r"\binterface\s+([A-Za-z_$][A-Za-z0-9_$]*)"},
    "java": {"class": r"\b(?:class|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)", "method": r"\b(?:public|private|protected)\s+(?:static\s+)?[A-Za-z_0-9<>,\[\]\s]+\s([A-Za-z_][A-Za-z0-9_]*)\s*\("},
    "go": {"function": r"\bfunc\s+(?:\([^()]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(", "struct": r"\btype\s+([A-Za-z_][A-Za-z0-9_]*)\s+struct\b"},
    "cpp": {"class": r"\b(?:class|struct)\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:final\s*)?[:{]", "macro": r"#\s*define\s+([A-Za-z_][A-Za-z0-9_]*)"},
    "css": {"variable": r"(--[A-Za-z][A-Za-z0-9_-]*)\s*:"},
}
SUFFIXES = {"python": ("py",), "javascript": ("js", "mjs"), "typescript": ("ts",), "java": ("java",), "go": ("go",), "cpp": ("cpp", "cc", "h", "hpp"), "css": ("css",)}


def bare(code: Column, language: str) -> Column:
    """Code without its texts and comments, line ends evened out."""
    return F.regexp_replace(F.replace(code, F.lit("\r"), F.lit("")), HIDDEN[language], " ")


def _declared(language: str, code: Column) -> Column:
    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), lambda n, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), n.alias("name")))

    return F.concat(*[named(k, p) for k, p in DECLARATIONS[language].items()])


def declarations(files: DataFrame, language: str) -> DataFrame:
    """EX2, EX4-EX7: names that files of a language declare: file_id, kind, pos, name."""
    known = files.where("code is not null").select("file_id", bare(F.col("code"), language).alias("bare"))
    return known.select("file_id", F.explode(_declared(language, F.col("bare"))).alias("d")).select("file_id", "d.kind", "d.pos", "d.name")


def structure(files: DataFrame) -> DataFrame:
    """UD1: the handler of each language by the suffix of the path, in one pass: file_id, language, kind, pos, name."""
    suffix = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    language = F.coalesce(*[F.when(suffix.isin(*known), F.lit(name)) for name, known in SUFFIXES.items()])
    named = files.where("code is not null").select("file_id", language.alias("language"), "code").where("language is not null")
    found = F.coalesce(*[F.when(F.col("language") == name, _declared(name, bare(F.col("code"), name))) for name in SUFFIXES])
    return named.select("file_id", "language", F.explode(found).alias("d")).select("file_id", "language", "d.kind", "d.pos", "d.name")


def imported_names(files: DataFrame) -> DataFrame:
    """GR1: names that a Python file imports by plain ``import`` (first parts and aliases left as written), and
    whether its other lines read them as a word of their own: file_id, name, used."""
    clean = bare(F.col("code"), "python")
    lines = F.split(clean, "\n", -1)
    plain = F.filter(lines, lambda x: x.rlike(r"^[ \t]*import[ \t]"))
    names = F.array_distinct(F.flatten(F.transform(plain, lambda x: F.transform(F.split(F.regexp_replace(x, r"^[ \t]*import[ \t]+", ""), ","), lambda n: F.regexp_replace(F.trim(n), r"[ \t;].*$", "")))))
    other = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^[ \t]*(?:import|from)[ \t]")), "\n")
    words = F.array_distinct(F.regexp_extract_all(other, F.lit(r"\.?[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    rows = files.where("code is not null").select("file_id", names.alias("names"), words.alias("words"))
    return rows.select("file_id", F.explode("names").alias("name"), "words").where("name <> ''").select("file_id", "name", F.array_contains("words", F.col("name")).alias("used"))


#: Words that split the flow of a script, and its words that count as operators.
DECISIONS = ("if", "for", "while", "case", "catch", "?", "&&", "||", "??")
OPERATOR_WORDS = ("if", "else", "for", "while", "do", "switch", "case", "default", "return", "break", "continue", "new", "delete", "typeof", "instanceof", "in", "of", "void", "throw", "try", "catch", "finally", "function", "class", "extends", "const", "let", "var", "async", "await", "yield", "import", "export", "from")
_SIGNS = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|===|!==|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^!~<>=?:.,;(){}\[\]]"


def script_metrics(files: DataFrame, language: str = "javascript") -> DataFrame:
    """EX3: cyclomatic complexity, Halstead measures and maintainability of script files.

    Operands are names and numbers, operators the signs and words of the language, closing brackets
    aside. A file without tokens has zeros everywhere. Columns: file_id, sloc, complexity, volume,
    difficulty, effort, maintainability.
    """
    clean = bare(F.col("code"), language)
    tokens = F.regexp_extract_all(clean, F.lit(_SIGNS), F.lit(0))
    named = files.where("code is not null").select("file_id", tokens.alias("t"), F.size(F.filter(F.split(clean, "\n"), lambda x: F.trim(x) != "")).alias("sloc"))
    words = F.array(*map(F.lit, OPERATOR_WORDS))
    operand = lambda x: x.rlike("^[A-Za-z0-9_$]") & ~F.array_contains(words, x)
    parts = named.select(
        "file_id", "sloc", F.filter("t", operand).alias("b"), F.filter("t", lambda x: ~operand(x) & ~x.isin(")", "]", "}")).alias("a"), (F.size(F.filter("t", lambda x: x.isin(*DECISIONS))) + 1).alias("complexity")
    )
    sizes = parts.select("file_id", "sloc", "complexity", *[F.size(x).alias(n) for x, n in (("a", "n1"), ("b", "n2"))], *[F.size(F.array_distinct(x)).alias(n) for x, n in (("a", "d1"), ("b", "d2"))])
    some = (F.col("n1") + F.col("n2")) > 0
    volume = F.when(some, (F.col("n1") + F.col("n2")) * F.log2((F.col("d1") + F.col("d2")).cast("double"))).otherwise(0.0)
    difficulty = F.when(F.col("d2") > 0, F.col("d1") / 2 * F.col("n2") / F.col("d2")).otherwise(0.0)
    measured = sizes.withColumns({"complexity": F.when(some, F.col("complexity")).otherwise(0), "volume": volume, "difficulty": difficulty})
    index = 171 - 5.2 * F.log(F.greatest("volume", F.lit(1.0))) - 0.23 * F.col("complexity") - 16.2 * F.log(F.greatest("sloc", F.lit(1)).cast("double"))
    return measured.select(
        "file_id", "sloc", "complexity", F.round("volume", 4).alias("volume"), F.round("difficulty", 4).alias("difficulty"), F.round(F.col("volume") * F.col("difficulty"), 3).alias("effort"),
        F.when(some, F.round(F.greatest(F.lit(0.0), index * 100 / 171), 4)).otherwise(0.0).alias("maintainability"),
    )


STRUCTURE = "file_id bigint, kind string, name string, line int, end_line int, args array<string>, detail string"
_FIELDS = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("args", pa.list_(pa.string())), ("detail", pa.string())])


def _walk(code: str) -> Iterator[tuple]:
    import ast

    try:
        tree = ast.parse(code.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        yield "error", None, 0, 0, [], "syntax"
        return
    imported: dict[str, int] = {}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            args = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if x.arg != "self"]
            yield "function", node.name, node.lineno, node.end_lineno, args, "async" if isinstance(node, ast.AsyncFunctionDef) else None
        elif isinstance(node, ast.ClassDef):
            yield "class", node.name, node.lineno, node.end_lineno, [ast.unparse(b) for b in node.bases], None
        elif isinstance(node, ast.Raise) and node.exc is not None:
            x = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
            if isinstance(x, ast.Name):
                yield "raises", x.id, node.lineno, node.end_lineno, [], None
        elif isinstance(node, ast.Import):
            for alias in node.names:
                imported[alias.asname or alias.name] = node.lineno
                yield "import", alias.name, node.lineno, node.end_lineno, [], alias.asname
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                yield "import", f"{node.module or ''}.{alias.name}", node.lineno, node.end_lineno, [], alias.asname
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    yield "constant" if target.id.isupper() else "variable", target.id, node.lineno, node.end_lineno, [], type(node.value).__name__
    for name in sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id in imported}):
        yield "uses", name, imported[name], imported[name], [], None


def python_structure(files: DataFrame) -> DataFrame:
    """EX1, EX9-EX11, GR1: functions, classes, imports, constants, variables, raised names and the plain
    imports that are read (``uses``). A file that does not parse has one row of kind ``error``."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *r) for f, code in zip(*(x.to_pylist() for x in batch.columns), strict=True) if code and code.strip() for r in _walk(code)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)

    return files.select(F.col("file_id").cast("bigint"), F.col("code").cast("string")).mapInArrow(visit, STRUCTURE)


#: How a language writes a comment before a declaration: what begins, and what ends it.
COMMENT = {"python": ("# ", ""), "javascript": ("/** ", " */"), "typescript": ("/** ", " */"), "java": ("/** ", " */"), "go": ("// ", ""), "cpp": ("/// ", ""), "css": ("/* ", " */"), "html": ("<!-- ", " -->")}
#: What stands before the name where it is declared.
DECLARED_BY = {
    "python": r"(?:async )?(?:def|class)\s+", "javascript": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const)\s+", "typescript": r"(?:export\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|const|type)\s+",
    "java": r"(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+", "go": r"(?:func|type)\s+(?:\([^()\n]*\)\s*)?", "cpp": r"(?:class|struct|enum)\s+", "css": r"\.", "html": "<",
}


def insert_comment(code: Column, name: Column, comment: Column, language: str = "python") -> Column:
    """IN2: puts a comment line, as the language writes it, before each declaration of a name that begins
    a line; other code stays as it is."""
    begins, ends = COMMENT[language]
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?m)^([ \t]*)(" + DECLARED_BY[language]), quoted, F.lit(r")(?![\w$])"))
    text = F.regexp_replace(F.regexp_replace(comment, r"[\r\n]+", " "), r"([\\$])", r"\\$1")
    lines = F.concat(F.lit("$1" + begins), text, F.lit(ends + "\n$1$2"))
    return F.when(name.isNotNull() & comment.isNotNull(), F.regexp_replace(code, pattern, lines)).otherwise(code)


def insert_docstring(code: Column, name: Column, text: Column) -> Column:
    """IN1: puts a docstring into the body of each function or class of a name that has none yet: below
    the head, which may go over lines inside its brackets, and indented by four more."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    head = F.concat(F.lit(r"(?m)^([ \t]*)((?:async[ ]+)?(?:def|class)[ ]+"), quoted, F.lit(r"(?:\[[^\[\]]*\])?(?:\((?:[^()]|\([^()]*\))*\))?[^:\n]*:[ \t]*(?:#[^\n]*)?)\n(?![ \t]*[rRuU]?(?:\"\"\"|'''))"))
    safe = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit("'"))
    body = F.concat(F.lit('$1$2\n$1    """'), F.regexp_replace(safe, r"([\\$])", r"\\$1"), F.lit('"""\n'))
    return F.when(name.isNotNull() & text.isNotNull(), F.regexp_replace(code, head, body)).otherwise(code)
