"""Operators against brute force on small inputs."""

import itertools
import random

from datetime import datetime, timedelta
from pyspark.sql import functions as F

from strataspark.functions import text
from strataspark.operators import chunking, extract, graph, joins, metrics, store
from strataspark.sources import files
from strataspark.streaming import windows


def test_running_latency_is_the_fold(spark):
    random.seed(1)
    rows = [(random.choice("ab"), i, random.random() * 9 if random.random() > 0.1 else None, random.random() > 0.3) for i in range(300)]
    want = {}
    for key in "ab":
        avg = n = 0
        for _, _, x, ok in (r for r in rows if r[0] == key):
            n += 1
            if ok and x is not None:
                avg = (avg * (n - 1) + x) / n
        want[key] = round(avg, 4)
    df = spark.createDataFrame(rows, "k string, seq bigint, latency double, success boolean")
    for block in (7, 50_000):
        assert {r.k: r.running_latency for r in metrics.running_latency(df, "k", "seq", block).collect()} == want


def test_numbered_over_blocks(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(100)], "k string, seq bigint")
    got = metrics.numbered(df, "k", "seq", 9).toPandas().sort_values(["k", "seq"])
    assert all(list(g.n) == list(range(1, len(g) + 1)) for _, g in got.groupby("k"))


def test_overlaps_against_all_pairs(spark):
    random.seed(2)
    rows = [(random.choice("xy"), s := random.randint(0, 200), s + random.randint(0, 40), i) for i in range(120)]
    want = {(a[3], b[3]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]}
    df = spark.createDataFrame(rows, "k string, s int, e int, id int")
    got = [(r.a_id, r.b_id) for r in joins.overlaps(df, "k", "s", "e", "id", 25).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_containing(spark):
    t = spark.createDataFrame([(1, "xUserRepo"), (2, "user"), (3, ""), (4, "ab")], "id int, t string")
    n = spark.createDataFrame([("User",), ("ab",), ("Repo",)], "n string")
    assert {(r.id, r.n) for r in joins.containing(t, "t", n, "n").collect()} == {(1, "User"), (1, "Repo"), (4, "ab")}


def test_containing_against_all_pairs(spark):
    random.seed(8)
    texts = [(i, "".join(random.choices("abc ", k=random.randint(0, 9)))) for i in range(80)] + [(98, None)]
    names = [("".join(random.choices("abc", k=random.randint(0, 4))),) for _ in range(40)] + [(None,), ("",)]
    want = sorted((i, n) for i, t in texts for (n,) in names if t is not None and n is not None and n in t)
    got = joins.containing(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(names, "n string"), "n").collect()
    assert sorted((r.id, r.n) for r in got) == want


def test_sharers_against_all_pairs(spark):
    random.seed(9)
    rows = [(i, random.sample("abcdefgh", random.randint(0, 2))) for i in range(60)] + [(90, None), (91, [])]
    want = {i: n for i, a in rows if (n := sum(1 for j, b in rows if i != j and set(a or []) & set(b or [])))}
    df = spark.createDataFrame(rows, "id int, a array<string>").selectExpr("id", "coalesce(a, array()) a")
    assert {r.id: r.n for r in joins.sharers(df, "a", "id").where("n > 0").collect()} == want


def test_later_sharers_against_all_pairs(spark):
    random.seed(11)
    rows = [(i, random.sample("abcdefgh", random.randint(0, 3)) + ["z"] * (i % 3 == 0)) for i in range(80)] + [(90, None), (91, []), (None, ["a", "z"])]
    want = {i: n for i, a in rows if i is not None and (n := sum(1 for j, b in rows if j is not None and i < j and set(a or []) & set(b or [])))}
    df = spark.createDataFrame(rows, "id bigint, a array<string>")
    for often in (0, 15, 25, 1000):
        got = joins.later_sharers(df, "a", "id", often, 2, 7).collect()
        assert len(got) == len(want) and {r.id: r.n for r in got} == want


def test_exploded_rows_are_not_broadcast(spark):
    # far more elements than the file behind them lets Spark expect
    df = spark.range(50).select("id", F.array(F.lit("a"), F.col("id").cast("string")).alias("a"))
    pairs = joins.sharing(df, df.withColumnRenamed("id", "other"), "a", "id", "other")
    assert pairs.count() == 2500
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("zz",)], "node string")
    assert {tuple(r) for r in graph.reach(edges, seeds).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "d", 1), ("a", "c", 2), ("zz", "zz", 0)}
    assert {r.node for r in graph.reach(edges, seeds, 1).collect()} == {"a", "b", "d", "zz"}


def test_reach_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)], "src string, dst string")
    assert graph.reach(edges, spark.createDataFrame([("0",)], "node string")).count() == 61


def test_context_is_the_queue(spark):
    random.seed(10)
    for _ in range(4):
        n = 30
        nodes = {str(i): (random.choice("xxy"), random.choice((0, 1, 3, 7, 20))) for i in range(n)}
        edges = [(str(i), str(j)) for i in range(n) for j in random.sample(range(n), 3)]
        seeds = [(f"s{i}", str(random.randrange(n + 2)), "x", random.choice((0, 5, 25, 90))) for i in range(6)]
        want = set()
        for seed, start, language, budget in seeds:
            queue, seen, used, pos = [(start, 0)], set(), 0, 0
            while queue and used < budget:
                node, depth = queue.pop(0)
                if node in seen or node not in nodes:
                    continue
                seen.add(node)
                if nodes[node][0] == language and used + nodes[node][1] <= budget:
                    want.add((seed, pos, node, depth, nodes[node][1]))
                    used, pos = used + nodes[node][1], pos + 1
                    queue += [(d, depth + 1) for s, d in edges if s == node]
        got = graph.context(
            spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node string, language string, tokens int"),
            spark.createDataFrame([(s, d, i) for i, (s, d) in enumerate(edges)], "src string, dst string, pos bigint"),
            spark.createDataFrame(seeds, "seed string, node string, language string, budget bigint"),
        )
        assert {tuple(r) for r in got.collect()} == want


def test_line_chunks_and_budget(spark):
    df = spark.createDataFrame([(1, "\n".join(["x" * 8] * 5)), (2, ""), (3, "y" * 400)], "id int, t string")
    got = {(r.id, r.chunk_no): (r.start_line, r.end_line) for r in chunking.line_chunks(df, "id", "t", 4).collect()}
    assert got == {(1, 0): (1, 2), (1, 1): (3, 4), (1, 2): (5, 5), (2, 0): (1, 1), (3, 0): (1, 1)}


def test_python_structure(spark):
    code = 'import os\nimport a.b as q\nfrom m import n\nX = 1\nclass A(B):\n    @d\n    def f(self, u, *v):\n        raise ValueError("x")\nos.x\n'
    df = spark.createDataFrame([(1, code), (2, "def ("), (3, None), (4, "")], "file_id bigint, code string")
    rows = {(r.file_id, r.kind, r.name) for r in extract.python_structure(df).collect()}
    assert rows == {(1, "import", "os"), (1, "import", "a.b"), (1, "import", "m.n"), (1, "constant", "X"), (1, "class", "A"), (1, "function", "f"), (1, "raises", "ValueError"), (1, "uses", "os"), (2, "error", None)}
    chunks = [(r.start_line, r.end_line, r.kind) for r in chunking.python_chunks(df).orderBy("file_id", "start_line").collect()]
    assert chunks == [(1, 4, "module"), (5, 8, "class"), (9, 9, "module")]


def test_store(spark):
    s = spark.createDataFrame([("p", "a", 1, "h"), ("p", "b", 2, "i")], "project_id string, file_path string, v int, hash string")
    c = spark.createDataFrame([("p", "a", 9, "h"), ("p", "z", 3, "k"), ("p", "b", None, "j")], "project_id string, file_path string, v int, hash string")
    assert [r.file_path for r in store.insert_absent(s, c, ["project_id", "file_path"]).collect()] == ["z"]
    assert sorted(r.v for r in store.update_matched(s, c, ["project_id", "file_path"], ["v"]).collect()) == [2, 9]
    assert {(r.file_path, r.change) for r in store.changed(s, c, "file_path", "hash").collect()} == {("z", "added"), ("b", "changed")}
    assert store.lookup(s, None).count() == 0 and store.lookup(s, "p", "a").count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("one two three",), ("",), (None,), ("abcdefghijk",)], "t string")
    assert [r[0] for r in df.select(text.truncate(F.col("t"), 9)).collect()] == ["one two...", "", None, "abcdefghi..."]
    assert [r[0] for r in df.select(text.escape_markdown(F.lit("a_b\r\n *c*"))).limit(1).collect()] == ["a\\_b \\*c\\*"]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / ".hid").mkdir()
    (tmp_path / ".hid" / "b.py").write_text("y")
    (tmp_path / "c.lock").write_text("")
    got = files.scan(spark, str(tmp_path)).where(files.visible(F.col("path"), ("node_modules",), (".lock",), ("*.md",)))
    assert [(r.path, r.content) for r in got.collect()] == [("src/a.py", "x = '�'\n")]


def test_streams_agree_with_batch(spark, tmp_path):
    base = datetime(2025, 1, 1)
    rows = [(i, "k" if i % 3 else "l", base + timedelta(minutes=i), i % 4 != 0, i) for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, provider string, called_at timestamp, success boolean, tokens bigint")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    windows.run_totals(windows.cumulative(stream, "provider"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {tuple(r) for r in windows.cumulative(df, "provider").collect()}
    q = windows.rate_windows(stream, "called_at", "provider", 4).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from rates").collect()} == {tuple(r) for r in windows.rate_windows(df, "called_at", "provider", 4).collect()}
    g = windows.quota_gate(stream, "provider", 10).writeStream.outputMode("update").format("memory").queryName("gate").start()
    g.processAllAvailable()
    g.stop()
    assert {r.provider: r.waits for r in spark.sql("select * from gate").collect()} == {"k": 30, "l": 10}


def test_debounce(spark):
    t = datetime(2025, 1, 1)
    rows = [(t, "u", "a"), (t + timedelta(milliseconds=200), "u", "ab"), (t + timedelta(milliseconds=900), "u", "abc"), (t, "v", " ")]
    df = spark.createDataFrame(rows, "ts timestamp, user string, q string")
    assert sorted((r.user, r.q) for r in windows.debounced(df, "ts", "user", "q").collect()) == [("u", "ab"), ("u", "abc")]


def test_python_chunks_of_every_depth(spark):
    long = "    " + "x" * 40
    code = "\n".join(["import os", "@d", "class A:", long, "    def f(self):", "        return 1", "    async def g(self):", "        def h(): yield 2", "        return h", "    def k(self):", "        pass", "y = 1", "def m():", "    if a:", "        return 1", long, "    return 2"])
    df = spark.createDataFrame([(1, code), (2, "def ("), (3, None)], "file_id bigint, code string")
    got = sorted((r.start_line, r.end_line, r.kind, r.name or "") for r in chunking.python_chunks(df, 15).collect())
    assert got == sorted([(1, 1, "module", ""), (12, 12, "module", ""), (2, 4, "class", "A"), (5, 7, "class", "A"), (8, 9, "class", "A"), (10, 11, "class", "A"), (5, 6, "function", "f"), (7, 9, "function", "g"), (8, 8, "function", "h"), (10, 11, "function", "k"), (13, 15, "function", "m"), (16, 17, "function", "m")])
    defs = {r.name for r in chunking.python_chunks(df, 10**6).collect() if r.name}
    assert defs == {"A", "f", "g", "h", "k", "m"}
