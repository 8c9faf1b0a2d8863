"""Schemas that drift between the files of a producer (problem 2).

Tagged-union inference. Every record is walked to its leaves; each leaf carries the tag of its JSON
type. Fusing the records of a file gives, for each path, the union of tags seen there (a bit mask,
so the fusion is an associative ``bit_or`` that Spark combines before the shuffle). Parallel
schemas of consecutive files are then compared path by path: what comes, what goes, what changes
its alternatives, and what merely moved. Conflicting types end in typed branches beside one
canonical value.

Defined cases
    * Unreadable, empty and null payloads and payloads that are no object have no leaves; their
      file still counts as a file of the stream.
    * A path whose value is null everywhere in a file is absent from the file.
    * Numbers with and without a fraction are one type; objects are walked into; arrays, also
      empty ones, are leaves; an empty object has no leaves.
    * Redelivered records count once. Rows without stream_id or file_no are left out.
    * Of several paths with one measure in a record, the first by name gives the value.
    * Of several equally good renames, the one with the same last name is taken, then the first by
      name; each field takes part in one rename at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .payload import dumps, loads

#: JSON types of a leaf; a union of types is a sum of these.
NUMBER, STRING, BOOLEAN, ARRAY = 1, 2, 4, 8

SCHEMAS = "stream_id bigint, file_no int, path string, kinds int"
SCHEMA_FIELDS = pa.schema([("stream_id", pa.int64()), ("file_no", pa.int32()), ("path", pa.string()), ("kinds", pa.int32())])

LEAVES = "stream_id bigint, file_no int, record_id bigint, path string, kind int, text string, number double"
LEAF_FIELDS = pa.schema(
    [("stream_id", pa.int64()), ("file_no", pa.int32()), ("record_id", pa.int64()), ("path", pa.string()), ("kind", pa.int32()), ("text", pa.string()), ("number", pa.float64())]
)

VALUES = "stream_id bigint, at int, source string, path string, event string, kind int, text string"
VALUE_FIELDS = pa.schema(
    [("stream_id", pa.int64()), ("at", pa.int32()), ("source", pa.string()), ("path", pa.string()), ("event", pa.string()), ("kind", pa.int32()), ("text", pa.string())]
)

#: The measures of the consistent table and the names that they are known by, in
#: lower-case letters and without the objects around them (``metrics``, ``halstead``).
MEASURES = {
    "volume": ("volume", "vol", "v"),
    "difficulty": ("difficulty", "diff", "d"),
    "effort": ("effort", "e"),
    "bugs": ("bugs", "b"),
    "time": ("time", "t"),
    "length": ("length", "n"),
    "maintainability_index": ("maintainabilityindex", "maintainability", "mi"),
    "complexity": ("complexity", "cyclomaticcomplexity", "cyclomatic", "cc"),
    "cognitive_complexity": ("cognitivecomplexity", "cognitive"),
    "class_count": ("classcount",),
    "function_count": ("functioncount",),
}


def walk(value: dict) -> Iterator[tuple[str, object]]:
    """Leaves of an object, depth first: path and value; nesting has no limit."""
    todo = [("", iter(value.items()))]
    while todo:
        prefix, items = todo[-1]
        for key, x in items:
            if x is None:
                continue
            if isinstance(x, dict):
                todo.append((f"{prefix}{key}.", iter(x.items())))
                break
            yield prefix + key, x
        else:
            todo.pop()


def kind_of(x: object) -> int:
    """Type tag of a leaf."""
    if isinstance(x, bool):
        return BOOLEAN
    if isinstance(x, (int, float)):
        return NUMBER
    return STRING if isinstance(x, str) else ARRAY


def content(x: object) -> tuple[int, str, float | None]:
    """Type tag, content as text, and the number if it is one."""
    kind = kind_of(x)
    if kind == NUMBER:
        try:
            number = float(x)
        except OverflowError:
            return kind, str(x), None
        return kind, repr(number), number
    if kind == BOOLEAN:
        return kind, "true" if x else "false", None
    return kind, x if kind == STRING else dumps(x, sort_keys=True), None


def _read(payload: str | None) -> dict | None:
    """The object that a payload holds, if it is readable."""
    if not payload:
        return None
    try:
        value = loads(payload)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def _known(records: DataFrame) -> DataFrame:
    return records.where("stream_id is not null and file_no is not null").select(
        F.col("stream_id").cast("bigint").alias("stream_id"),
        F.col("file_no").cast("int").alias("file_no"),
        F.col("record_id").cast("bigint").alias("record_id"),
        F.when(F.col("file_path").isNotNull() & F.col("content_hash").isNotNull(), F.concat_ws("\u0000", "file_path", "content_hash")).alias("source"),
        F.col("payload").cast("string").alias("payload"),
    )


def fused(records: DataFrame) -> DataFrame:
    """The schema of each file: its paths, each with the union of its types. Records are fused as they
    are read, batch by batch, so only schemas are shuffled."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for stream, file_no, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for path, x in walk(_read(payload) or {}):
                    at = (stream, file_no, path)
                    seen[at] = seen.get(at, 0) | kind_of(x)
            yield _batch([(*at, kinds) for at, kinds in seen.items()], SCHEMA_FIELDS)

    rows = _known(records).select("stream_id", "file_no", "payload").mapInArrow(visit, SCHEMAS)
    return rows.groupBy("stream_id", "file_no", "path").agg(F.bit_or("kinds").alias("kinds"))


def leaves(records: DataFrame) -> DataFrame:
    """One row for each leaf of each readable record."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream, file_no, record, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(stream, file_no, record, path, *content(x)) for path, x in walk(_read(payload) or {})]
            yield _batch(rows, LEAF_FIELDS)

    return _known(records).select("stream_id", "file_no", "record_id", "payload").mapInArrow(visit, LEAVES)


def files(records: DataFrame) -> DataFrame:
    """The files of each stream, each with the file before and after it."""
    w = Window.partitionBy("stream_id").orderBy("file_no")
    known = records.where("stream_id is not null and file_no is not null")
    return (
        known.select(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("file_no").cast("int").alias("file_no"))
        .distinct()
        .withColumns({"prev_no": F.lag("file_no").over(w), "next_no": F.lead("file_no").over(w)})
    )


def _steps(schemas: DataFrame, file_rows: DataFrame) -> DataFrame:
    """Fields beside their state in the file before and after."""
    w = Window.partitionBy("stream_id", "path").orderBy("file_no")
    return schemas.join(file_rows, ["stream_id", "file_no"]).withColumns(
        {"seen_no": F.lag("file_no").over(w), "seen_kinds": F.lag("kinds").over(w), "later_no": F.lead("file_no").over(w)}
    )


def _events(schemas: DataFrame, file_rows: DataFrame) -> DataFrame:
    """What comes, goes or changes its types: stream_id, at (the later file), held_no (the file that
    has the field), path, kind, old, new."""
    was_there = F.col("seen_no").eqNullSafe(F.col("prev_no"))
    events = F.array(
        F.when(
            F.col("prev_no").isNotNull() & ~was_there,
            F.struct(F.lit("added").alias("kind"), F.col("file_no").alias("at"), F.lit(0).alias("old"), F.col("kinds").alias("new")),
        ),
        F.when(
            F.col("prev_no").isNotNull() & was_there & (F.col("seen_kinds") != F.col("kinds")),
            F.struct(F.lit("retyped").alias("kind"), F.col("file_no").alias("at"), F.col("seen_kinds").alias("old"), F.col("kinds").alias("new")),
        ),
        F.when(
            F.col("next_no").isNotNull() & ~F.col("later_no").eqNullSafe(F.col("next_no")),
            F.struct(F.lit("removed").alias("kind"), F.col("next_no").alias("at"), F.col("kinds").alias("old"), F.lit(0).alias("new")),
        ),
    )
    return (
        _steps(schemas, file_rows)
        .select("stream_id", "file_no", "path", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
        .select("stream_id", F.col("e.at").alias("at"), F.col("file_no").alias("held_no"), "path", "e.kind", "e.old", "e.new")
    )


def changes(records: DataFrame) -> DataFrame:
    """Every change from a file to the next of its stream, with the types before and after.

    Columns: stream_id, file_no, change_kind, field, new_field, old_kinds, new_kinds.
    """
    # kept: the changes are few beside the records, and both the renames and the result need them
    found = kept(_events(fused(records), files(records)))
    moved = _renames(records, found)
    gone = moved.select("stream_id", "at", F.col("old_path").alias("path"), F.lit("removed").alias("kind"), "new_path")
    come = moved.select("stream_id", "at", F.col("new_path").alias("path"), F.lit("added").alias("kind"), F.lit("").alias("new_path"))
    partner = found.join(gone.unionByName(come), ["stream_id", "at", "path", "kind"], "left")
    renamed = (F.col("kind") == "removed") & F.col("new_path").isNotNull()
    return partner.where(~((F.col("kind") == "added") & F.col("new_path").isNotNull())).select(
        "stream_id",
        F.col("at").alias("file_no"),
        F.when(renamed, "renamed").otherwise(F.col("kind")).alias("change_kind"),
        F.col("path").alias("field"),
        F.coalesce("new_path", F.lit("")).alias("new_field"),
        F.col("old").alias("old_kinds"),
        F.when(renamed, F.col("old")).otherwise(F.col("new")).alias("new_kinds"),
    )


def _last(path: str) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def _moving_values(records: DataFrame, found: DataFrame) -> DataFrame:
    """Content of the fields that come or go, in the files on both sides of a change that has both.

    Each file gets its own short list of such fields, so payloads are only read where one is needed.
    """
    moving = found.where("kind <> 'retyped'").select("stream_id", "at", F.col("held_no").alias("file_no"), "path", F.col("kind").alias("event"))
    both = moving.groupBy("stream_id", "at").agg(F.countDistinct("event").alias("n")).where("n = 2").select("stream_id", "at")
    # the fields of one file: bounded by its schema
    wanted = moving.join(both, ["stream_id", "at"], "left_semi").groupBy("stream_id", "file_no").agg(F.collect_list(F.struct("at", "path", "event")).alias("wanted"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream, source, payload, fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = _read(payload)
                if value is None:
                    continue
                have = dict(walk(value))
                rows += [(stream, w["at"], source, w["path"], w["event"], *content(have[w["path"]])[:2]) for w in fields if w["path"] in have]
            yield _batch(rows, VALUE_FIELDS)

    chosen = _known(records).where("source is not null").join(wanted, ["stream_id", "file_no"])
    return chosen.select("stream_id", "source", "payload", "wanted").mapInArrow(visit, VALUES)


def _renames(records: DataFrame, found: DataFrame) -> DataFrame:
    """Fields that go and come in one file with the same content in every source file both know."""
    # the moving fields of one source file on both sides of a change: bounded by its schema
    each = _moving_values(records, found).groupBy("stream_id", "at", "source").agg(F.array_sort(F.collect_set(F.struct("event", "path", F.struct("kind", "text").alias("value")))).alias("fields"))
    fields = F.col("fields")
    # redelivered records and a source file measured twice: the least value of each path
    once = F.filter(fields, lambda x, i: (i == 0) | (F.get(fields, i - 1)["path"] != x["path"]) | (F.get(fields, i - 1)["event"] != x["event"]))
    old = F.filter("once", lambda x: x["event"] == "removed")
    new = F.filter("once", lambda x: x["event"] == "added")
    pairs = (
        each.select("stream_id", "at", once.alias("once"))
        .select("stream_id", "at", F.explode(old).alias("o"), new.alias("new"))
        .select("stream_id", "at", "o", F.explode("new").alias("n"))
        .groupBy("stream_id", "at", F.col("o.path").alias("old_path"), F.col("n.path").alias("new_path"))
        .agg(F.count("*").alias("n"), F.sum((F.col("o.value") == F.col("n.value")).cast("bigint")).alias("same"))
        .where("same = n")
    )
    alike = (_last("old_path") == _last("new_path")).cast("int")
    by_old = Window.partitionBy("stream_id", "at", "old_path").orderBy(F.desc("n"), F.desc("alike"), "new_path")
    by_new = Window.partitionBy("stream_id", "at", "new_path").orderBy(F.desc("n"), F.desc("alike"), "old_path")
    return (
        pairs.withColumn("alike", alike)
        .withColumns({"r1": F.row_number().over(by_old), "r2": F.row_number().over(by_new)})
        .where("r1 = 1 and r2 = 1")
        .select("stream_id", "at", "old_path", "new_path")
    )


def branches(records: DataFrame) -> DataFrame:
    """Every leaf once, its value in the branch of its type, beside one canonical number.

    A text that spells a number and an array of one number have that number as canonical value;
    true and false are 1 and 0.
    """
    rows = leaves(records.dropDuplicates(["record_id"]))
    inner = F.get(F.from_json("text", "array<double>"), F.lit(0))
    one = F.size(F.from_json("text", "array<string>")) == 1
    return rows.select(
        "stream_id",
        "file_no",
        "record_id",
        "path",
        F.col("number").alias("number_value"),
        F.when(F.col("kind") == STRING, F.col("text")).alias("string_value"),
        F.when(F.col("kind") == BOOLEAN, F.col("text") == "true").alias("boolean_value"),
        F.when(F.col("kind") == ARRAY, F.col("text")).alias("array_value"),
        F.when(F.col("kind") == NUMBER, F.col("number"))
        .when(F.col("kind") == STRING, F.col("text").try_cast("double"))
        .when(F.col("kind") == BOOLEAN, (F.col("text") == "true").cast("double"))
        .when((F.col("kind") == ARRAY) & one, inner)
        .alias("canonical"),
    )


def measure_name(path: Column) -> Column:
    """The measure that a path is known to name, or null."""
    letters = F.lower(F.regexp_replace(path, "[^A-Za-z]", ""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(letters, "^metrics", ""), "^halstead", ""), "value$", "")
    return F.coalesce(*[F.when(bare.isin(*names), F.lit(m)) for m, names in MEASURES.items()])


def field_measures(records: DataFrame) -> DataFrame:
    """The measure of every field of every file: stream_id, file_no, path, measure.

    The times that a field is there without a break are one node; a rename links two nodes. Going
    back along the renames (doubling the stride, so that a chain of n takes log n joins) gives every
    node the first name of its field. The measure is the one that this name or the present one is
    known by, else the first name itself.
    """
    schemas, file_rows = kept(fused(records)), files(records)
    found = kept(_events(schemas, file_rows))
    along = Window.partitionBy("stream_id", "path").orderBy("file_no").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(F.col("prev_no").isNull() | ~F.col("seen_no").eqNullSafe(F.col("prev_no")), F.col("file_no"))
    nodes = kept(_steps(schemas, file_rows).select("stream_id", "file_no", "path", F.last(begins, ignorenulls=True).over(along).alias("since")))
    held = found.where("kind = 'removed'").select("stream_id", "at", F.col("path").alias("old_path"), F.col("held_no").alias("file_no"))
    back = (
        _renames(records, found)
        .join(held, ["stream_id", "at", "old_path"])
        .join(nodes.withColumnRenamed("path", "old_path"), ["stream_id", "old_path", "file_no"])
        .select("stream_id", F.col("new_path").alias("path"), F.col("at").alias("since"), F.col("old_path").alias("first_path"), F.col("since").alias("first_since"))
    )
    back = kept(back)
    while True:
        earlier = back.select("stream_id", F.col("path").alias("first_path"), F.col("since").alias("first_since"), F.col("first_path").alias("p"), F.col("first_since").alias("s"))
        stepped = back.join(earlier, ["stream_id", "first_path", "first_since"], "left")
        if stepped.where("p is not null").isEmpty():
            break
        back = kept(stepped.select("stream_id", "path", "since", F.coalesce("p", "first_path").alias("first_path"), F.coalesce("s", "first_since").alias("first_since")))
    first = F.coalesce("first_path", "path")
    return nodes.join(back, ["stream_id", "path", "since"], "left").select(
        "stream_id", "file_no", "path", F.coalesce(measure_name(first), measure_name(F.col("path")), first).alias("measure")
    )


def measures(records: DataFrame) -> DataFrame:
    """The consistent table: one row for each readable record, whatever its file called the measures.

    Measures that no name is known for stand in ``other``, under the first name of their field.
    """
    named = field_measures(records).groupBy("stream_id", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("path", "measure"))).alias("names"))
    schema = pa.schema(
        [("stream_id", pa.int64()), ("file_no", pa.int32()), ("record_id", pa.int64()), *((m, pa.float64()) for m in MEASURES), ("other", pa.map_(pa.string(), pa.float64()))]
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream, file_no, record, payload, names in zip(*(c.to_pylist(maps_as_pydicts="strict") for c in batch.columns), strict=True):
                value = _read(payload)
                if value is None:
                    continue
                got: dict[str, float] = {}
                for path, x in sorted(walk(value), key=lambda leaf: leaf[0]):
                    measure = names[path]  # the file's schema holds every path of its records
                    number = _canonical(x)
                    if number is not None and measure not in got:
                        got[measure] = number
                other = sorted((m, v) for m, v in got.items() if m not in MEASURES)
                rows.append((stream, file_no, record, *map(got.get, MEASURES), other))
            yield _batch(rows, schema)

    chosen = _known(records.dropDuplicates(["record_id"])).join(named, ["stream_id", "file_no"], "left")
    out = "stream_id bigint, file_no int, record_id bigint, " + ", ".join(f"{m} double" for m in MEASURES) + ", other map<string, double>"
    return chosen.select("stream_id", "file_no", "record_id", "payload", "names").mapInArrow(visit, out)


def _canonical(x: object) -> float | None:
    """The number that a leaf stands for: itself, a text that spells one, or an array of one number."""
    if isinstance(x, list):
        if len(x) != 1 or isinstance(x[0], bool) or not isinstance(x[0], (int, float)):
            return None
        x = x[0]
    if isinstance(x, str) and "_" in x:
        return None
    try:
        return float(x)
    except (ValueError, OverflowError):
        return None
