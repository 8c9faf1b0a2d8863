"""Problem 1 on small records."""

import json

from strataspark.operators import nested, payload


def rows(*payloads):
    return {(k, r[3], r[4], r[5]) for k, p in enumerate(payloads) for r in nested.visit(k, p, "x")}


def test_shapes_of_args():
    def one(args):
        return rows(json.dumps({"classes": [{"name": "A", "methods": [{"name": "m", "args": args}]}]}))

    full = {(0, 0, -1, -1), (0, 0, 0, -1), (0, 0, 0, 0), (0, 0, 0, 1)}
    assert one(["a", "b: int = 3"]) == full
    assert one("a, b: dict[str, int] = 3") == full
    assert one([{"name": "a"}, {"name": "b", "nested": {"args": ["inner"]}}]) == full
    assert one({"a": None, "b": "int"}) == full
    assert one(["a", None, "b"]) == full - {(0, 0, 0, 1)} | {(0, 0, 0, 2)}
    assert one("") == one([]) == one(None) == one({}) == {(0, 0, -1, -1), (0, 0, 0, -1)}


def test_wrappings_are_opened():
    record = {"project_id": "p", "file_path": "f", "classes": [{"name": "A", "methods": {"m": {"args": []}}}], "functions": []}
    want = {(0, 0, -1, -1), (0, 0, 0, -1)}
    for payload in (record, {"data": record, "error": None}, json.dumps(record), {"task_id": "t", "results": {"f": record}, "errors": []}):
        assert rows(json.dumps(payload)) == want


def test_any_number_of_wrappers():
    record = {"classes": [{"name": "A", "methods": []}]}
    for depth in (7, 8, 9, 40):
        wrapped = record
        for i in range(depth):
            wrapped = {("data", "result", "payload")[i % 3]: wrapped}
        assert rows(json.dumps(wrapped)) == {(0, 0, -1, -1)}
    text = json.dumps(record)
    for _ in range(5):
        text = json.dumps(text)
    assert rows(text) == {(0, 0, -1, -1)}
    deep = '{"data":' * 150_000 + json.dumps(record) + "}" * 150_000
    assert rows(deep) == {(0, 0, -1, -1)}
    inside = json.dumps({"classes": [{"name": "A", "methods": [{"name": "m", "args": [0]}]}]}).replace("[0]", "[" * 200_001 + "1" + "]" * 200_001)
    assert rows(inside) == {(0, 0, -1, -1), (0, 0, 0, -1), (0, 0, 0, 0)}
    assert rows("[" * 200_000, "[" * 200_000 + "]" * 199_999, '{"data":' * 200_000) == set()


def test_deep_reader_is_the_usual_one():
    for text in ('{"a": [1, -2.5e3, true, null, "x\\n\u00e9"], "b": {}, "c": [], "d": {"e": [[{}]]}}', "[]", '"x"', " 3 ", "[1, [2, [3]]]", '{"a": 1, "a": 2}'):
        assert payload._deep(text) == json.loads(text)
        assert json.loads(payload._written(json.loads(text), True)) == json.loads(text)
        assert payload._written(json.loads(text), True) == payload.dumps(json.loads(text), True)
    for text in ("", "{", "[1,]", '{"a"}', '{"a":1,}', "[1] 2", "{1:2}", "[1 2]", "nul"):
        try:
            payload._deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_single_objects_and_maps():
    assert rows(json.dumps({"classes": {"name": "A", "methods": {"name": "m", "args": ["a"]}}})) == {(0, 0, -1, -1), (0, 0, 0, -1), (0, 0, 0, 0)}
    assert rows(json.dumps({"classes": {"A": {"methods": []}, "B": None, "C": {}}})) == {(0, 0, -1, -1), (0, 2, -1, -1)}


def test_unreadable_payloads_have_no_rows():
    assert rows(None, "", " ", "null", "[1", "3", '"x"', "{}", '{"classes": null}', '{"classes": [null, 3]}') == set()


def test_typed_and_payload_emission_agree(spark):
    ddl = "id bigint, classes array<struct<name string, docstring string, methods array<struct<name string, docstring string, args array<string>, async boolean, complexity double, type string, decorators array<string>>>, decorators array<string>, superclass string, file_path string, line_number int>>, extra string, tag string"
    m = ("m", None, ["a", None, "b: int = 2"], True, 1.0, None, None)
    data = [(1, [("A", "d", [m, None], None, None, None, 3), None, (None, None, None, None, None, None, None)], "x", "clash"), (1, None, "x", "clash"), (2, [], "y", None), (3, None, None, None)]
    df = spark.createDataFrame(data, ddl)
    typed = {tuple(r)[:6] for r in nested.emit_typed(df, "id", origin="o").collect()}
    text = df.selectExpr("id", "to_json(struct(classes)) as payload", "extra")
    assert typed == {tuple(r)[:6] for r in nested.emit_payloads(text, "id", origin="o").collect()}
    assert ("arg", "o", 1, 0, 0, 2) in typed and ("class", "o", 1, 2, -1, -1) in typed and len(typed) == 5


def test_tables_keep_links(spark, tmp_path):
    payload = json.dumps({"classes": [{"name": "A", "methods": [{"name": "m", "complexity": 2, "args": ["b: int = 2"]}]}]})
    df = spark.createDataFrame([(7, payload), (7, payload)], "id bigint, payload string")
    emitted = nested.emit_payloads(df, "id", origin="o")
    nested.write_tables(emitted, str(tmp_path / "t"))
    arg = nested.read_table(spark, str(tmp_path / "t"), "arg").collect()
    assert [(r.pk, r.parent_pk, r["name"], r["type"], r["default"]) for r in arg] == [("o:7/0/0/0", "o:7/0/0", "b", "int", "2")]
    assert nested.read_rows(spark, str(tmp_path / "t")).count() == 3
    assert [r.complexity for r in nested.read_table(spark, str(tmp_path / "t"), "method").collect()] == [2.0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, payload string")
    assert nested.emit_payloads(df, "id").count() == 0
