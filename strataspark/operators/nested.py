"""Deeply nested records to flat tables that keep their parent links (problem 1).

One pass over each record emits rows of one shape for every table: a tag (``class``, ``method``,
``arg``), the row's own key, its parent's key, its place, and the row's own fields as JSON. The
tagged rows are written once, partitioned by tag; each table is then read from its partition and
given its schema.

Typed records (``documentation.classes``) are walked by Spark's own higher-order functions.
Payloads whose shape varies from record to record are walked by a depth-first visitor in Arrow
batches. Both give the same rows.

Defined cases
    * A null record, a null array or an absent one: no rows.
    * A null element keeps its position and gives no row; neither do its children.
    * An empty name or docstring is kept as it is; a null one stays null.
    * Unreadable, empty or null payloads, and payloads that are no object: no rows.
    * Any number of wrappers around a record is opened; nesting has no limit.
    * Redelivered records (same key, all columns alike) count once.
    * Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .payload import dumps, loads

TAGS = ("class", "method", "arg")

EMITTED = "tag string, origin string, record_id bigint, class_pos int, method_pos int, arg_pos int, payload string"

CLASS_SCHEMA = "name string, docstring string, decorators array<string>, superclass string, file_path string, line_number int"
METHOD_SCHEMA = "name string, docstring string, async boolean, complexity double, type string, decorators array<string>"
ARG_SCHEMA = "name string, type string, default string"
SCHEMAS = {"class": CLASS_SCHEMA, "method": METHOD_SCHEMA, "arg": ARG_SCHEMA}
PLACES = {"class": ["class_pos"], "method": ["class_pos", "method_pos"], "arg": ["class_pos", "method_pos", "arg_pos"]}
WRITTEN = "origin string, record_id bigint, class_pos int, method_pos int, arg_pos int, payload string, pk string, parent_pk string, tag string"

CLASS_FIELDS = ("name", "docstring", "decorators", "superclass", "file_path", "line_number", "methods")
METHOD_FIELDS = ("name", "docstring", "async", "complexity", "type", "decorators", "args")

#: Keys under which a service wraps the record that it sends.
WRAPPERS = ("data", "results", "result", "payload", "response", "documentation", "record")
RECORD_FIELDS = ("classes", "functions", "file_path", "project_id")

ARROW_EMITTED = pa.schema(
    [
        ("tag", pa.string()),
        ("origin", pa.string()),
        ("record_id", pa.int64()),
        ("class_pos", pa.int32()),
        ("method_pos", pa.int32()),
        ("arg_pos", pa.int32()),
        ("payload", pa.string()),
    ]
)


# --- typed records: built-in expressions only -------------------------------------------------


def _arg_struct(arg: Column) -> Column:
    """``name: type = default`` as its three parts."""
    head = F.trim(F.regexp_extract(arg, r"^([^:=]*)", 1))
    kind = F.nullif(F.trim(F.regexp_extract(arg, r"^[^:=]*:([^=]*)", 1)), F.lit(""))
    default = F.nullif(F.trim(F.regexp_extract(arg, r"=(.*)$", 1)), F.lit(""))
    return F.struct(head.alias("name"), kind.alias("type"), default.alias("default"))


def _row(tag: str, c: Column, m: Column, a: Column, payload: Column) -> Column:
    return F.struct(
        F.lit(tag).alias("tag"),
        c.cast("int").alias("class_pos"),
        m.cast("int").alias("method_pos"),
        a.cast("int").alias("arg_pos"),
        payload.alias("payload"),
    )


def emit_typed(df: DataFrame, key: str, classes: str = "classes", origin: str = "documentation", payloads: bool = True) -> DataFrame:
    """Tagged rows of records whose classes are a typed array. ``payloads=False`` leaves the fields out."""
    none = F.lit(-1)

    def body(fields: list[Column]) -> Column:
        return F.to_json(F.struct(*fields)) if payloads else F.lit(None).cast("string")

    def own(x: Column, schema: str) -> list[Column]:
        return [x[f.name].alias(f.name) for f in T.StructType.fromDDL(schema)]

    def of_arg(c: Column, m: Column) -> object:
        def make(arg: Column, a: Column) -> Column:
            payload = F.to_json(_arg_struct(arg)) if payloads else F.lit(None).cast("string")
            return F.when(arg.isNotNull(), _row("arg", c, m, a, payload))

        return make

    def of_method(c: Column) -> object:
        def make(method: Column, m: Column) -> Column:
            head = F.array(_row("method", c, m, none, body(own(method, METHOD_SCHEMA))))
            rest = F.transform(F.coalesce(method["args"], F.array().cast("array<string>")), of_arg(c, m))
            return F.when(method.isNotNull(), F.concat(head, rest))

        return make

    def of_class(cls: Column, c: Column) -> Column:
        head = F.array(_row("class", c, none, none, body(own(cls, CLASS_SCHEMA))))
        methods = F.filter(F.transform(cls["methods"], of_method(c)), lambda x: x.isNotNull())
        return F.when(cls.isNotNull(), F.concat(head, F.coalesce(F.flatten(methods), F.slice(head, 1, 0))))

    rows = F.flatten(F.filter(F.transform(F.col(classes), of_class), lambda x: x.isNotNull()))
    return (
        df.select(F.col(key).cast("bigint").alias("record_id"), F.explode(rows).alias("r"))
        .where("r is not null")
        .select("r.tag", F.lit(origin).alias("origin"), "record_id", "r.class_pos", "r.method_pos", "r.arg_pos", "r.payload")
    )


# --- payloads of varying shape: depth-first visitor --------------------------------------------


def split_args(text: str) -> list[str]:
    """Parts of an argument list; commas inside brackets or quotes do not part."""
    parts, depth, start, quote = [], 0, 0, ""
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([{<":
            depth += 1
        elif ch in ")]}>":
            depth = max(0, depth - 1)
        elif ch == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def arg_fields(text: str) -> dict:
    head, _, default = text.partition("=")
    name, _, kind = head.partition(":")
    return {"name": name.strip(), "type": kind.strip() or None, "default": default.strip() or None}


def unwrap(value: object) -> dict | None:
    """The record inside a payload: text that is itself JSON, wrappers and one-element maps are opened,
    however many there are."""
    while True:
        if isinstance(value, str):
            try:
                value = loads(value)
            except ValueError:
                return None
        elif isinstance(value, list):
            value = next((x for x in value if isinstance(x, (dict, str))), None)
        elif isinstance(value, dict):
            if any(f in value for f in ("classes", "functions")):
                return value
            inner = next((value[w] for w in WRAPPERS if isinstance(value.get(w), (dict, list, str))), None)
            if inner is None:
                if any(f in value for f in RECORD_FIELDS) or len(value) != 1:
                    return value
                (inner,) = value.values()
                if not isinstance(inner, (dict, list)):
                    return value
            value = inner
        else:
            return None


def members(value: object, fields: tuple[str, ...]) -> list[tuple[int, dict]]:
    """The objects of a list, of a map by name, or of a single object, with their positions."""
    if isinstance(value, str):
        try:
            value = loads(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        by_name = value and all(x is None or isinstance(x, dict) for x in value.values())
        if not value:
            return []
        if by_name and not ("name" in value or "docstring" in value):
            value = [None if x is None else {"name": k, **x} for k, x in value.items()]
        elif any(f in value for f in fields):
            value = [value]
        else:
            return []
    if not isinstance(value, list):
        return []
    return [(i, x) for i, x in enumerate(value) if isinstance(x, dict)]


def arg_members(value: object) -> list[tuple[int, dict]]:
    """Arguments given as a list of texts or objects, as one text, or as a map of name to type."""
    if isinstance(value, str):
        return [(i, arg_fields(x)) for i, x in enumerate(split_args(value))]
    if isinstance(value, dict):
        if isinstance(value.get("name"), str) and set(value) <= {"name", "type", "default", "nested", "description"}:
            return [(0, value)]
        return [(i, {"name": k, "type": v if isinstance(v, str) else None}) for i, (k, v) in enumerate(value.items())]
    if not isinstance(value, list):
        return []
    out = []
    for i, x in enumerate(value):
        if isinstance(x, dict):
            out.append((i, x))
        elif x is not None:
            out.append((i, arg_fields(x if isinstance(x, str) else dumps(x))))
    return out


def visit(record_id: int, payload: str | None, origin: str, payloads: bool = True) -> Iterator[tuple]:
    """Depth-first walk of one payload; yields rows of ``EMITTED``."""
    if not payload or not payload.strip():
        return
    record = unwrap(payload)
    if record is None:
        return

    def body(x: dict, schema: str) -> str | None:
        return dumps({f: x[f] for f in schema if x.get(f) is not None}) if payloads else None

    for c, cls in members(record.get("classes"), CLASS_FIELDS):
        yield "class", origin, record_id, c, -1, -1, body(cls, CLASS_FIELDS[:-1])
        for m, method in members(cls.get("methods"), METHOD_FIELDS):
            yield "method", origin, record_id, c, m, -1, body(method, METHOD_FIELDS[:-1])
            for a, arg in arg_members(method.get("args")):
                yield "arg", origin, record_id, c, m, a, body(arg, ("name", "type", "default"))


def emit_payloads(df: DataFrame, key: str, payload: str = "payload", origin: str = "doc_responses", payloads: bool = True) -> DataFrame:
    """Tagged rows of records that arrive as JSON of varying shape."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                row
                for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if k is not None
                for row in visit(k, p, origin, payloads)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(ARROW_EMITTED)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW_EMITTED, strict=True)], schema=ARROW_EMITTED)

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(payload).cast("string").alias("payload")).mapInArrow(walk, EMITTED)


# --- tables -------------------------------------------------------------------------------------


def keyed(emitted: DataFrame) -> DataFrame:
    """Adds ``pk`` and ``parent_pk`` and drops redelivered rows."""
    record = F.concat(F.col("origin"), F.lit(":"), F.col("record_id"))
    cls = F.concat(record, F.lit("/"), F.col("class_pos"))
    method = F.concat(cls, F.lit("/"), F.col("method_pos"))
    arg = F.concat(method, F.lit("/"), F.col("arg_pos"))
    by_tag = F.when(F.col("tag") == "class", F.array(cls, record)).when(F.col("tag") == "method", F.array(method, cls)).otherwise(F.array(arg, method))
    return emitted.withColumns({"pk": by_tag[0], "parent_pk": by_tag[1]}).dropDuplicates(["pk"])


def write_tables(emitted: DataFrame, path: str) -> None:
    """All tables in one job and one walk of the records, partitioned by tag."""
    keyed(emitted).write.partitionBy("tag").mode("overwrite").parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tables`` wrote, all tags, with keys and places."""
    return spark.read.schema(WRITTEN).parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One table of what ``write_tables`` wrote; only its partition is read."""
    rows = read_rows(spark, path).where(F.col("tag") == tag)
    return rows.withColumn("f", F.from_json("payload", SCHEMAS[tag])).select("pk", "parent_pk", "origin", "record_id", *PLACES[tag], "f.*")
