"""Problem 2 on small streams."""

import json

from strataspark.operators import drift

DDL = "stream_id bigint, file_no int, record_id bigint, file_path string, content_hash string, payload string, text string"


def frame(spark, files):
    rows, n = [], 0
    for no, records in files.items():
        for path, record in records:
            n += 1
            rows.append((1, no, n, path, "h", record if isinstance(record, str) or record is None else json.dumps(record), "clash"))
    return spark.createDataFrame(rows + rows[:1], DDL)


def found(spark, files):
    return {tuple(r)[1:5] for r in drift.changes(frame(spark, files)).collect()}


def test_kinds(spark):
    files = {
        1: [("a", {"mi": 1.5, "h": {"vol": 3}, "old": 1, "flag": True}), ("b", {"mi": 2.5, "h": {"vol": 4.5}, "old": None})],
        3: [("a", {"idx": 1.5, "h": {"vol": "3"}, "new": [1]}), ("b", {"idx": 2.5, "h": {"vol": "4.5"}}), ("c", "{broken")],
    }
    assert found(spark, files) == {
        (3, "renamed", "mi", "idx"),
        (3, "retyped", "h.vol", ""),
        (3, "removed", "old", ""),
        (3, "removed", "flag", ""),
        (3, "added", "new", ""),
    }


def test_moved_object_and_swap_of_unlike_fields(spark):
    a = {1: [("a", {"h": {"v": 1, "d": 2}}), ("b", {"h": {"v": 3, "d": 4}})], 2: [("a", {"m": {"h": {"v": 1, "d": 2}}}), ("b", {"m": {"h": {"v": 3, "d": 4}}})]}
    assert found(spark, a) == {(2, "renamed", "h.v", "m.h.v"), (2, "renamed", "h.d", "m.h.d")}
    b = {1: [("a", {"x": 1})], 2: [("a", {"y": 9})]}
    assert found(spark, b) == {(2, "removed", "x", ""), (2, "added", "y", "")}
    c = {1: [("a", {"x": 1})], 2: [("other", {"y": 1})]}
    assert found(spark, c) == {(2, "removed", "x", ""), (2, "added", "y", "")}


def test_null_everywhere_is_absent_and_number_is_one_type(spark):
    files = {1: [("a", {"x": 1, "y": None})], 2: [("a", {"x": 1.5, "y": None})], 5: [("a", {"x": 2, "y": 1})]}
    assert found(spark, files) == {(5, "added", "y", "")}


def test_file_without_readable_record_counts(spark):
    files = {1: [("a", {"x": 1})], 2: [("a", "[1]"), ("b", None), ("c", "")], 3: [("a", {"x": 1})]}
    assert found(spark, files) == {(2, "removed", "x", ""), (3, "added", "x", "")}


def test_branches_and_measures(spark):
    df = frame(spark, {1: [("a", {"halstead": {"vol": "12.5", "diff": [3]}, "mi": 7, "complexity": True})]})
    row = drift.measures(df).collect()[0]
    assert (row.volume, row.difficulty, row.effort, row.maintainability_index, row.complexity) == (12.5, 3.0, None, 7.0, 1.0)


def test_measures_follow_renames(spark):
    unknown = {
        1: [("a", {"halstead": {"vol": 1.5}, "zz": 5}), ("b", {"halstead": {"vol": 2.5}, "zz": 6})],
        2: [("a", {"m1": 1.5, "q": "5"}), ("b", {"m1": 2.5, "q": 6})],
        3: [("a", {"deep": {"m2": ["1.5"]}, "q": 5}), ("b", {"deep": {"m2": 2.5}, "q": 6})],
        4: [("a", {"mi": 1, "x": {"m3": 1.5}}), ("b", {"mi": 2, "x": {"m3": 2.5}})],
    }
    unknown[3][0][1]["deep"]["m2"] = 1.5
    got = {(r.file_no, r.record_id): (r.volume, r.maintainability_index, r.other) for r in drift.measures(frame(spark, unknown)).collect()}
    assert got == {
        (1, 1): (1.5, None, {"zz": 5.0}), (1, 2): (2.5, None, {"zz": 6.0}),
        (2, 3): (1.5, None, {"q": 5.0}), (2, 4): (2.5, None, {"q": 6.0}),
        (3, 5): (1.5, None, {"q": 5.0}), (3, 6): (2.5, None, {"q": 6.0}),
        (4, 7): (1.5, 1.0, {}), (4, 8): (2.5, 2.0, {}),
    }
    assert {(r.measure) for r in drift.field_measures(frame(spark, unknown)).where("path in ('m1', 'deep.m2', 'x.m3')").collect()} == {"volume"}


def test_two_names_of_a_measure_and_deep_payloads(spark):
    deep = '{"a":' * 50_000 + '{"cc": 3}' + "}" * 50_000
    files = {1: [("a", {"vol": 2, "halstead": {"V": 1}}), ("b", "{}")], 2: [("c", deep)]}
    got = {r.record_id: (r.volume, r.complexity) for r in drift.measures(frame(spark, files)).collect()}
    assert got[1] == (1.0, None) and got[2] == (None, None) and got[3][0] is None
    assert drift.leaves(frame(spark, files)).where("length(path) > 100000").count() == 1


def test_empty(spark):
    assert drift.changes(spark.createDataFrame([], DDL)).count() == 0
