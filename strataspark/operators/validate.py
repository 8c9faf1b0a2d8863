"""Constraint checks that report every violation (VA*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE_NAME = r"^[A-Za-z_][A-Za-z0-9_.]*(\[.*\])?$"
#: The pattern of exception names, and Python's own exceptions that it does not match.
BUILT_IN = ("BaseException", "BaseExceptionGroup", "Exception", "ExceptionGroup", "GeneratorExit", "KeyboardInterrupt", "StopAsyncIteration", "StopIteration", "SystemExit", "Warning")
EXCEPTION_NAME = r"^[A-Z][a-zA-Z0-9]*(Error|Exception|Warning)$"


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, in order; a check that is null fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda v: v.isNotNull())


def document_violations(docs: DataFrame) -> DataFrame:
    """VA1: required fields, names of classes and functions, and the types of methods."""

    def named(items: str) -> Column:
        return F.forall(F.coalesce(items, F.slice(items, 1, 0)), lambda x: x.isNull() | x["name"].isNotNull())

    kinds = F.flatten(F.transform(F.filter("classes", lambda c: c["methods"].isNotNull()), lambda c: F.transform(F.filter(c["methods"], lambda m: m.isNotNull()), lambda m: m["type"])))
    checks = {
        "project_id": F.col("project_id").isNotNull(),
        "file_path": F.col("file_path").isNotNull(),
        "version": F.col("version").isNotNull(),
        "language": F.col("language").isNotNull(),
        "classes.name": F.coalesce(named("classes"), F.lit(True)),
        "functions.name": F.coalesce(named("functions"), F.lit(True)),
        "methods.type": F.coalesce(F.forall(F.array_compact(kinds), lambda t: t.isin("instance", "class", "static")), F.lit(True)),
    }
    return docs.withColumn("violations", violations(checks))


def exception_name(name: Column) -> Column:
    """VA6: whether a name is one of an exception."""
    return name.rlike(EXCEPTION_NAME) | name.isin(*BUILT_IN)


def summary_quality(text: Column) -> Column:
    """VA5: three words, a capital first, a stop at the end."""
    return violations(
        {"words": F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) >= 3, "capital": text.rlike(r"^[A-Z]"), "stop": text.rlike(r"[.?!]\s*$"), "length": F.length(text) >= 10}
    )


#: What a function of a service's answer must have, and the type of each.
FUNCTION_SCHEMA = {"name": ("STRING",), "docstring": ("STRING",), "args": ("ARRAY",), "async": ("BOOLEAN",)}
#: The same for the metrics of a script file.
METRICS_SHAPE = {"complexity": ("BIGINT", "DECIMAL", "DOUBLE"), "maintainability_index": ("BIGINT", "DECIMAL", "DOUBLE"), "halstead": ("OBJECT",)}


def shape_errors(value: Column, schema: dict[str, tuple[str, ...]]) -> Column:
    """VA2, VA8: what a JSON object (variant) lacks of a schema, or has of another type: array<path, message>."""

    def kind(field: str) -> Column:
        return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")), "^[A-Z]+", 0)

    checks = []
    for field, kinds in schema.items():
        k = kind(field)
        message = F.when(k.isNull(), "required").when(~k.isin(*kinds), "type")
        checks.append(F.when(message.isNotNull(), F.struct(F.lit(field).alias("path"), message.alias("message"))))
    return F.array_compact(F.array(*checks))
