"""Problem 3: grammars on small texts, and against Python's own parser and JSON reader."""

import ast
import json
import random
import re
import warnings
from pathlib import Path

import duckdb
import pytest

from strataspark.llm import parsing

CHECK = parsing.Checker().check
warnings.simplefilter("ignore")

GOOD = {
    "python": ["", "x = 1\n", "def f(a, /, b: int = 2, *c, d, **e) -> int:\n    return a if b else c\n", "async def g():\n\tasync with x as y, z:\n\t\tawait y\n", "match x:\n    case [1, *r] if r: pass\n    case A(b=2) | {'k': v}: pass\n    case _: pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse: pass\nfinally: pass\n", "x = [i async for i in y if i], {**a, 'b': lambda *p, q=1: q}, f'{x!r:>{w}}', 0x_ff, 1_000.5e-3j\n", "type T[A: int] = list[A]\n", "@d(1)\nclass C[B](metaclass=M): x: int = 3\n", "if (y := f(x)) > 1: print(y); del y\n", "x = (1,\n  2)  # c\n\n# tail"],
    "javascript": ["", "import a, { b as c } from 'x';\nexport default function* f() { yield* g(); }\n", "const f = async (a, { b = 1, ...c }, [d]) => { await a?.b?.[c]?.(d) ?? e; };\nlet x = y\nfoo()\n", "class A extends (b, C) { static #p = 1; get q() { return this.#p } static { x() } async *[k]() {} }", "for (const [k, v] of Object.entries(o)) if (k) continue; else break\nlabel: while (1) { do x++; while (x < 5) }", "a = b ? c => d : { e, f() {}, ['g']: 1, ...h }\nvar r = /[/]\\/x/gi.test(s) || `t${`u${v}`}`", "switch (x) { case 1: case 2: y(); break\n default: z() }\ntry { a() } catch { b() } finally { c() }", "#!/usr/bin/env node\nx"],
    "typescript": ["interface A<T extends B = C> extends D { readonly a?: string; [k: string]: any; m(x: number): void; new (): A }", "type X = { [K in keyof T]?: T[K] } | (a: string, ...b: number[]) => Promise<Map<string, Array<number>>>;", "export abstract class A<T> implements B { constructor(private readonly x: number, public y?: string) { super(); } abstract m<U>(u: U): asserts u is T; }", "enum E { A = 1, B }\ndeclare const z: unique symbol;\nconst g = <T,>(x: T): x is T => x as unknown as T;", "let v = f<string>(w!) satisfies W;\nfunction h(this: X, a: number): void;\nfunction h(a) {}"],
    "java": ["package a.b;\nimport static java.util.*;\n@A(x = {1, 2}) public sealed interface I<T extends Comparable<T> & X> permits Y { default <U> void m(List<? super U>... a) throws E {} }", "record R(int a, String... b) { R { if (a < 0) throw new X(); } }\nenum Q implements I { A(1) { void f() {} }, B; int x; }", "class C { int[] a = {1, 2}; Map<String, List<int[]>> m = new HashMap<>(); { for (int i = 0, j; i < 3; i++) a[i] >>>= (int) 2L; } void f() { var r = (Runnable & S) () -> {}; int k = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; if (o instanceof Foo f && f.g() > 1) return; String t = \"\"\"\n a\"\"\"; xs.stream().map(C::new).toList(); } }"],
    "go": ["package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K, V]) f(a, b int, c ...string) (x int, err error) {\n\tif v, ok := t.m[a]; ok && v > 1 {\n\t\treturn\n\t} else if x == 2 {\n\t}\n\tfor i := range xs {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}, &T{A: 1}\n}\n"],
    "cpp": ["#include <a>\ntemplate <typename T, int N = 3> class A : public B<T> { public: explicit A(int x) : x_(x), y_{1} {} ~A() = default; int f() const override { return x_ * 2; } private: int x_ = 0; };\n", "namespace a::b { using V = std::vector<std::map<int, std::string>>; static const char* s = R\"(x\"y)\"; enum class E : int { A = 1, B }; }\n", "int main(int argc, char** argv) { auto f = [&, x = 1](int y) mutable -> int { return x + y; }; for (const auto& [k, v] : m) if (v > 2) continue; std::cout << static_cast<int>(m.size()) << \"a\" \"b\"; try { throw std::runtime_error(\"x\"); } catch (const E& e) {} return {}; }\n"],
    "json": ['{"a": [1, -2.5e3, null, {"b": "\\u00e9"}]}', "3", "[]"],
    "css": ["", "/* <<<<<<< */ @media (max-width: 3em) { .a > b:not(.c)::before { color: #fff; width: calc(1% + 2px) } }\n@import url(x.css);\n:root { --a: {b}; }"],
    "html": ["<!DOCTYPE html><html><body><p>a<br>b<ul><li>x<li>y</ul><script>if (a < b) {}</script><img src='a>b'></body></html>", "<p>1 < 2</p>"],
}
BAD = {
    "python": ["def f(:\n", "x = 1\n  y = 2\n", "if x:\npass\n", "<<<<<<< HEAD\nx = 1\n", "print 'a'\n", "x = (1,\n", "'''abc", "else:\n    pass\n", "try:\n    pass\n", "x = 1 +\n", "    return 1\n  x\n", "012\n"],
    "javascript": ["function f( {", "let x = ;", "}", "if (x) { else }", "<<<<<<< a\nx\n", "const a = 'b", "import x from y", "a b", "class { x }}", "{ \"a\": 1, \"b\": 2 }"],
    "typescript": ["interface A { a: }", "let x: = 1", "package a;\npublic class B {}", "type = ;", "foo<<<"],
    "java": ["class A {", "class A { int f( { } }", "int x = 1;;}", "import a.b", "x + 1;", "class A { void f() { 1 + 2; } }", "def f(): pass"],
    "go": ["func f() {}", "package a\nfunc f( {}\n", "package a\n\nfunc f() {\n\tx :=\n}\n", "package a\n<<<<<<< x\n"],
    "cpp": ["int f( {", "class A { int x; ", "import os\n\ndef f():\n    pass\n", "<!DOCTYPE html><p>", "int x = 1 2;"],
    "json": ["{", '{"a": 1,}', "{'a': 1}", "404 x", '{"a" 1}', "01"],
    "css": [".a { color: red;", "}", "/* a", ".a { content: \"x }", "<<<<<<< a\n.b {}\n", "404 Not Found now", "import x from 'y';\nfoo();"],
    "html": ["<div><p>a</p>", "a</div>", "<!-- x", "404 gone", "<div>\n<<<<<<< a\n</div>", "import os\nx = 1", "<div class=\"a></div>"],
}


@pytest.mark.parametrize("language", GOOD)
def test_good(language):
    for code in GOOD[language]:
        assert CHECK(language, code) is None, code


@pytest.mark.parametrize("language", BAD)
def test_bad(language):
    for code in BAD[language]:
        found = CHECK(language, code)
        assert found is not None, code
        assert 0 <= found[0] <= len(code) and found[1]


def python_parses(code):
    try:
        ast.parse(code)
    except (SyntaxError, ValueError):
        return False
    return True


def test_python_forms():
    """Small texts, parted by bars, of every kind of statement and of what is none."""
    for code in (Path(__file__).parent / "python_probes.txt").read_text(encoding="utf-8").rstrip("\n").split("|"):
        if code.strip():
            assert (CHECK("python", code) is None) == python_parses(code), code


def test_mutated_python_and_json():
    """Valid texts with a token dropped, put in, doubled or exchanged, or cut off."""
    random.seed(11)
    base = GOOD["python"][2:] + [c for c in (Path(__file__).parent / "python_probes.txt").read_text(encoding="utf-8").split("|") if python_parses(c)]
    whole = "\n".join(c for c in GOOD["python"][2:-1] if "match" not in c)
    signs = ["(", ")", "[", "]", "{", "}", ":", ",", "=", "*", "**", ".", "if ", "else ", "for ", " in ", "lambda ", "not ", "1", "x", '"a"', "f'{x}'", ":=", "->", "await ", "yield ", "import ", " as ", ";", "|", "+=", "b'x'", "return ", "del "]
    for n in range(1500):
        tokens = re.findall(r"\w+|\s+|.", random.choice([*base, whole]), re.DOTALL)
        for _ in range(random.choice((1, 1, 2))):
            at = random.randrange(len(tokens) + 1)
            how = random.randrange(5)
            tokens = tokens[:at] + ([[], [random.choice(signs)], tokens[at : at + 1] * 2, [random.choice(signs)], []][how]) + (tokens[at + (how != 1) :] if how < 4 else [])
        code = "".join(tokens)
        if code.strip():
            assert (CHECK("python", code) is None) == python_parses(code), (n, code)
    text = json.dumps({"a": [1, -2.5e3, None, True, {"b": "\u00e9\n"}], "c": {}, "d": [], "e": "x"})
    for n in range(1500):
        tokens = re.findall(r"\w+|\s+|.", text, re.DOTALL)
        at = random.randrange(len(tokens))
        tokens[at : at + random.choice((0, 1, 1, 2))] = random.choice(([], ["["], ["]"], ["{"], ["}"], [","], [":"], ['"'], ["0"], ["1."], ["-"], ["nul"], ["'"], ["e5"], ["\\"]))
        code = "".join(tokens)
        try:
            json.loads(code)
            valid = True
        except ValueError:
            valid = False
        if code.strip():
            assert (CHECK("json", code) is None) == valid, (n, code)


@pytest.mark.parametrize(
    ("language", "good", "bad"),
    [
        ("go", ["package a\nvar x = []int{\n1,\n}\n", "package a\nfunc f() { g(1,\n2,\n) }\n", "package a\ntype T struct {\na int\n}\n"], ["package a\nvar x = []int{\n1\n}\n", "package a\nfunc f() { g(1,\n2\n) }\n", "package a\nfunc f(a int,\nb int\n) {}\n"]),
        (
            "javascript",
            ["const x = 1;", "for (const x of y) {}", "a.b[0] = 2", "[a, b] = c", "({a = 1, c: d.e} = b)", "(a ?? b) || c", "(-a) ** b", "a ** -b", "0n", "let {a} = b", "a.b++", "(a) = 1", "({a = 1}) => a", "a = b = c"],
            ["const x;", "1 = 2", "f() = 2", "({a = 1})", "a ?? b || c", "-a ** b", "08n", "a + 1 = 2", "let [a];", "const {a};", "f()++", "for (const i; ;) {}", "({a: 1} = d)", "new f() = 1"],
        ),
        ("cpp", ["#if 1\n#elif 2\n#else\n#endif\n", '#include <a>\n#include "b"\n#include X\n#pragma once\n'], ["#include <a\nint x;\n", "#if 1\nint x;\n", "#endif\n", "#if 1\n#else\n#else\n#endif\n", "#include\nint x;"]),
    ],
)
def test_rules_beyond_brackets(language, good, bad):
    assert [c for c in good if CHECK(language, c)] == [] and [c for c in bad if not CHECK(language, c)] == []


def test_furthest_place():
    assert CHECK("python", "x = 1 if 2")[0] == 10
    assert CHECK("python", "y = 0\nimport a.b as c.d\n")[0] == 21
    assert CHECK("python", "f(a, b c)\n")[0] == 7
    assert CHECK("json", '{"a": [1, 2 3]}')[0] == 12


def test_no_cases():
    assert all(CHECK(g, c) is None for g, c in (("yaml", "{"), ("ini", "["), ("dotenv", "="), ("java", " \n"), ("json", "﻿"), (None, "x"), ("cobol", "x")))
    assert CHECK("json", '﻿{"a": 1}') is None


def test_against_python_and_json(small):
    rows = duckdb.sql(f"select language, file_path, code from '{small}/source_files.parquet' where code is not null").fetchall()
    for language, path, code in rows:
        body = code.lstrip("﻿")
        if not body.strip():
            continue
        if path.endswith(".py") and (language or "py").strip().lower() in ("py", "python", "python3"):
            read = ast.parse
        elif path.endswith(".json") and (language or "json").strip().lower() == "json":
            read = json.loads
        else:
            continue
        try:
            read(body)
            valid = True
        except ValueError:
            valid = False
        except SyntaxError:
            valid = False
        assert (CHECK("python" if path.endswith(".py") else "json", code) is None) == valid, path


def test_frame(spark):
    rows = [(1, "p", "a.py", None, "x = ("), (1, "p", "a.py", None, "x = ("), (2, "p", "b.txt", " JS ", "x("), (3, None, None, None, None), (4, "q", "c.json", "json", "{}")]
    df = spark.createDataFrame(rows, "file_id bigint, project_id string, file_path string, language string, code string").selectExpr("*", "'x' as parses", "1 as position")
    aliases = {"py": "python", "js": "javascript", "json": "json"}
    got = {r.file_id: r.parses for r in parsing.check_files(df, aliases).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}
    assert {(r.project_id, r.language): (r.n_files, r.n_invalid) for r in parsing.rates(parsing.check_files(df, aliases)).collect()} == {("p", "python"): (1, 1), ("p", "javascript"): (1, 1), (None, None): (1, 0), ("q", "json"): (1, 0)}
    assert parsing.check_files(df.limit(0), aliases).count() == 0
