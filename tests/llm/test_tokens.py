"""Problem 6 against the public library, and problem 7 against its invariants."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataspark.llm import packing, tokens

PATH = f"{tokens.VOCABULARIES}/{tokens.VOCABULARY}"
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids(text):
    packed = tokens.encoder(PATH).packed(text)
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst '._\n\tABZ019éß中文字한국กา<|>", max_size=120)))
def test_ids_are_those_of_the_library(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_and_odd_texts():
    for text in ("a" * 3000, "ab" * 900, " " * 999, "=-" * 500, "<|endoftext|>", "\x00\x01", "😀👍🏽" * 40, "Ünïcödé naïve " * 200):
        assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    e = tokens.Encoder(PATH)
    text = "one two three four five six seven one two"
    assert len(e.packed(text)) // 4 == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, " ", None)], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(df, "doc_id").collect())
    assert got == [(1, ids("hello")), (2, []), (3, []), (3, []), (4, ids(" "))]
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.counts(df, "doc_id").collect())[0] == (1, len(ids("hello")))
    assert tokens.encode(df.limit(0), "doc_id").count() == 0


def test_plan_keeps_every_item_and_no_container_overflows():
    random.seed(7)
    for capacity in (1, 2, 3, 10, 97, 512, 4096):
        for n in (0, 1, 7, 400, 5000):
            counts = Counter(random.randint(1, capacity) if random.random() < 0.5 else random.randint(1, max(1, capacity // 6)) for _ in range(n))
            load, placed = Counter(), Counter()
            for size, start, number, container, each in packing.plan(counts, capacity):
                for r in range(start, start + number):
                    load[container + (r - start) // each] += size
                placed[size] += number
            assert placed == counts and all(v <= capacity for v in load.values())
            assert len(load) == (max(load) + 1 if load else 0)
            total = sum(s * k for s, k in counts.items())
            if total > 40 * capacity:
                assert len(load) <= 1.35 * total / capacity


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 7), (2, 3), (3, 0), (4, 25), (5, 5), (6, 5), (7, 10)], "doc_id bigint, n_tokens int")
    budgets = spark.createDataFrame([(1, 10), (2, 100)], "budget_id int, capacity int")
    rows = packing.pack(sizes, budgets).collect()
    for budget, capacity, least in ((1, 10, 6), (2, 100, 1)):
        mine = [r for r in rows if r.budget_id == budget]
        load = Counter()
        for r in mine:
            if r.size:
                load[r.container_id] += r.size
            else:
                assert r.container_id is None
        assert max(load.values()) <= capacity and len(load) == least and sum(load.values()) == 55
        assert [(r.piece_no, r.first_token, r["size"]) for r in sorted((r for r in mine if r.doc_id == 4), key=lambda r: r.piece_no)] == ([(0, 0, 10), (1, 10, 10), (2, 20, 5)] if budget == 1 else [(0, 0, 25)])
    assert packing.pack(sizes.limit(0), budgets).count() == 0


def test_any_capacity_and_plans_too_large_to_broadcast(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, 1 + i * 7919 % 400_000) for i in range(300)], "doc_id bigint, n_tokens int")
    budgets = spark.createDataFrame([(1, 262_144), (2, 1_000)], "budget_id int, capacity int")
    want = sorted(map(tuple, packing.pack(sizes, budgets).collect()))
    load = Counter()
    for budget, _, _, _, size, container in want:
        load[budget, container] += size
    assert all(n <= {1: 262_144, 2: 1_000}[b] for (b, _), n in load.items())
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, packing.pack(sizes, budgets).collect())) == want


def test_decode_and_batch_counts(spark):
    rows = [(1, "héllo wörld 日本"), (2, ""), (3, None), (4, "x" * 50)]
    df = spark.createDataFrame(rows, "id int, text string")
    back = tokens.decode(tokens.encode(df, "id"), "id")
    assert {r.id: r.text for r in back.collect()} == {i: t or "" for i, t in rows}
    odd = spark.createDataFrame([(1, None), (2, [10**8])], "id int, ids array<int>")
    assert {r.id: r.text for r in tokens.decode(odd, "id").collect()} == {1: None, 2: "\ufffd"}
    parts = spark.createDataFrame([(1, ["hello", "world"]), (2, []), (3, None)], "id int, ts array<string>")
    assert {r.id: (r.n_tokens, r.error) for r in tokens.batch_counts(parts, "id", "ts").collect()} == {1: (len(ids("hello world")), None), 2: (0, "empty"), 3: (0, "empty")}
    got = tokens.batch_counts(parts, "id", "ts").select("id", tokens.within(tokens.F.col("n_tokens"), tokens.F.col("error"), tokens.F.lit(2)).alias("ok")).collect()
    assert {r.id: r.ok for r in got} == {1: True, 2: False, 3: False}
