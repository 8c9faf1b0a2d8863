"""Chunks, declarations, inserted comments and ignore patterns on small inputs."""

import ast
import random

from pyspark.sql import functions as F

from __spark_entry__ import queries
from strataspark.operators import chunking, extract
from strataspark.sources import files

QUERIES = queries()


def test_materialised(spark):
    df = spark.createDataFrame([(1, "\n".join(["x" * 8] * 5)), (2, ""), (3, "y" * 400)], "id int, t string")
    content = {(r.id, r.chunk_no): (r.content, r.tokens) for r in chunking.materialised(df, "id", "t", 4).collect()}
    assert content[1, 0] == ("xxxxxxxx\nxxxxxxxx", 4) and content[2, 0] == ("", 0) and len(content) == 5


def test_fitting_against_the_fold(spark):
    random.seed(12)
    rows = [(random.choice("ab"), i, i, random.choice((0, 1, 2, 5, 9))) for i in range(80)]
    want = set()
    for key in "ab":
        used = 0
        for k, _, i, t in rows:
            if k == key and used + t <= 17:
                used += t
                want.add((k, i))
    got = chunking.fitting(spark.createDataFrame(rows, "k string, `order` int, id int, tokens int"), ["k"], 17)
    assert {(r.k, r.id) for r in got.collect()} == want


def test_split_and_merge(spark):
    c = spark.createDataFrame([(1, 0, 1, 3, "a\nb\nc", ""), (1, 1, 4, 4, "d", "n")], "id int, chunk_no int, start_line int, end_line int, content string, name string")
    got = sorted(tuple(r) for r in chunking.split_chunks(c, F.lit(1)).select("chunk_no", "part", "start_line", "end_line", "content").collect())
    assert got == [(0, 0, 1, 1, "a"), (0, 1, 2, 3, "b\nc")]
    (m,) = chunking.merge_contents(c, "id").collect()
    assert (m.start_line, m.end_line, m.name, m.content) == (1, 4, "n", "a\nb\nc\nd")
    lines = spark.createDataFrame([("function", ["def f():", "  return 1", "x"]), ("function", ["def f():", "  return 1"]), ("class", ["class A:", "  def f(self):"]), ("class", ["def f():"])], "kind string, ls array<string>")
    assert [r[0] for r in lines.select(chunking.split_after(F.col("kind"), F.col("ls"))).collect()] == [2, None, 1, None]


def test_insert_comment(spark):
    df = spark.createDataFrame([("x = 1\n  def f(a):\n    pass\n", "f", "cost $1"), ("def g(): 0", "f", "z")], "c string, n string, t string")
    out = [r[0] for r in df.select(extract.insert_comment(F.col("c"), F.col("n"), F.col("t"))).collect()]
    assert out == ["x = 1\n  # cost $1\n  def f(a):\n    pass\n", "def g(): 0"]
    for language, code, name, want in [
        ("javascript", "export async function f(a) {}\nfs()", "f", "/** says */\nexport async function f(a) {}\nfs()"),
        ("java", "package a;\npublic final class A {\n}", "A", "package a;\n/** says */\npublic final class A {\n}"),
        ("go", "func (t *T) f() {}\nfunc g() {}", "f", "// says\nfunc (t *T) f() {}\nfunc g() {}"),
        ("cpp", "struct A {};\nstruct AB {};", "A", "/// says\nstruct A {};\nstruct AB {};"),
        ("css", ".a { }\n.ab { }", "a", "/* says */\n.a { }\n.ab { }"),
        ("html", "<b>x</b>\n  <a>y</a>", "a", "<b>x</b>\n  <!-- says -->\n  <a>y</a>"),
        ("typescript", "interface A {}", "A", "/** says */\ninterface A {}"),
    ]:
        df = spark.createDataFrame([(code, name)], "c string, n string")
        assert df.select(extract.insert_comment(F.col("c"), F.col("n"), F.lit("says"), language)).head()[0] == want


def test_insert_docstring(spark):
    code = "class A:\n    def f(self, a=(1, 2),\n          b=3) -> int:  # c\n        return a\n\n    def g(self):\n        '''has'''\n"
    for name in ("f", "g", "A", "zz"):
        df = spark.createDataFrame([(code, name)], "c string, n string")
        out = df.select(extract.insert_docstring(F.col("c"), F.col("n"), F.lit('It costs $1 and "more".'))).head()[0]
        nodes = {n.name: ast.get_docstring(n) for n in ast.walk(ast.parse(out)) if isinstance(n, (ast.FunctionDef, ast.ClassDef))}
        assert nodes == {"A": None, "f": None, "g": "has"} | ({name: "It costs $1 and 'more'."} if name in "fA" else {}), out


#: Code of each language and its declarations, found by eye; what stands in comments and texts is none.
DECLARED = {
    "python": ("def f():\n    'def no(): pass'\n    raise E('x')  # class N\nclass C(B):\n  async def g(self): '''\ndef no2():\n'''\n", {("function", "f"), ("function", "g"), ("class", "C"), ("raises", "E")}),
    "javascript": ("// function no() {}\nfunction f() {}\nclass A extends B {}\nconst g = async (a, b) => a, h = 1;\nx = 'class No {'; /* const no = () => 1 */ `function no()`", {("function", "f"), ("class", "A"), ("arrow", "g")}),
    "typescript": ("interface I<T> {}\nexport class A {}\nfunction f(a: string) {} // interface No", {("interface", "I"), ("class", "A"), ("function", "f")}),
    "java": ('/** class No */\npublic class A { private static Map<String, List<Integer>> f(int a) { return "enum No"; } public A() {} record R(int a) {} }', {("class", "A"), ("class", "R"), ("method", "f")}),
    "go": ("package a\nfunc f() {}\nfunc (t *T) g(a int) {}\ntype T struct {}\ntype I interface {}\n// func no() {}\nvar x = `func no() {}`", {("function", "f"), ("function", "g"), ("struct", "T")}),
    "cpp": ("#define A 1\nclass B : public C {};\nstruct D final {};\nclass E;\n// struct No {}\n", {("macro", "A"), ("class", "B"), ("class", "D")}),
    "css": (":root { --a: 1px; --b-c: red }\n/* --no: 1 */ .x { color: var(--a) }", {("variable", "--a"), ("variable", "--b-c")}),
}


def test_declarations_by_eye(spark):
    for language, (code, want) in DECLARED.items():
        df = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, '"' + "x" * 300_000), (5, "'" + "\\n" * 50_000 + "'")], "file_id int, code string")
        assert {(r.kind, r["name"]) for r in extract.declarations(df, language).collect()} == want, language
    df = spark.createDataFrame([(i, f"a.{extract.SUFFIXES[k][0]}", DECLARED[k][0]) for i, k in enumerate(DECLARED)] + [(99, "a.txt", "x")], "file_id int, file_path string, code string")
    assert {(r.language, r.kind, r["name"]) for r in extract.structure(df).collect()} == {(k, *d) for k in DECLARED for d in DECLARED[k][1]}


def test_ignore_patterns(spark):
    paths = ["a/b.py", "b.py", "build/x", "a/build/x", "build", "docs/a.md", "docs/a/b.md", "x/gen/y.c", "k.log", "a/k.log", "keep.log", "src/k1.c", "src/kx.c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")

    def hit(*globs):
        return {r.p for r in df.where(files.ignored(F.col("p"), list(globs))).collect()}

    assert hit("build/") == {"build/x", "a/build/x"} and hit("/build") == {"build/x", "build"}
    assert hit("docs/*.md") == {"docs/a.md"} and hit("docs/**/*.md") == {"docs/a.md", "docs/a/b.md"}
    assert hit("*.log", "!keep.log") == {"k.log", "a/k.log"} and hit("**/gen/*") == {"x/gen/y.c"} and hit("k[0-9].c") == {"src/k1.c"} and hit("k[!0-9].c") == {"src/kx.c"}


def test_order_of_the_store(spark, small):
    rows = QUERIES["so1_latest_first"](spark, small).collect()
    at = {r.record_id: r.last_updated for r in spark.read.parquet(f"{small}/documentation.parquet").collect()}
    assert [r.record_id for r in rows] == sorted((r.record_id for r in rows), key=lambda i: (-at[i].timestamp() if at[i] else float("inf"), i))
