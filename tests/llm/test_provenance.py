"""Problem 5: the grammar, the signs of single files, copies between projects, and requests."""

import random

from strataspark.llm import provenance

HAND = "import os\n\ndef load(path, limit):\n    rows = []\n    for line in open(path):\n        if len(rows) > limit:\n            break\n        rows.append(line.strip())\n    return rows\n\nclass Box:\n    def size(self):\n        return self.n or 0\n"


def signs(code, path="a/b.py"):
    says_tool, minified, data, says_copy, _, reused, _, _ = provenance.features(code, path)
    return says_tool or reused, minified, data, says_copy


def test_grammar_derives_its_input():
    random.seed(3)
    for _ in range(200):
        seq = [random.randint(1, random.choice((2, 4, 30))) for _ in range(random.randint(0, 300))]
        rules, start = provenance.grammar(seq)
        assert provenance.derived(rules, start) == seq
        assert 2 * len(rules) + len(start) <= len(seq)
    rules, start = provenance.grammar([1, 2] * 200)
    assert len(start) + len(rules) < 25 and provenance.derived(rules, start) == [1, 2] * 200


def test_grammars_of_many_texts_at_once():
    random.seed(2)
    texts = [[random.randint(0, random.choice((1, 3, 8, 30))) for _ in range(random.choice((0, 1, 2, 7, 60, 300)))] for _ in range(400)] + [[5] * n for n in range(12)] + [[1, 2, 1, 2, 2, 1] * 50]
    want = [(len(rules), len(start)) for rules, start in map(provenance.grammar, texts)]
    assert provenance.grammar_sizes(texts) == want
    assert [provenance.grammar_sizes([x])[0] for x in texts] == want
    assert provenance.grammar_sizes([]) == []


def test_files_judged_together_are_judged_alike(monkeypatch):
    random.seed(7)
    rows = [(HAND * random.randint(1, 4) + "".join(f"    field_{i} = Field({i}, kind='int', default={i % n})\n" for i in range(n)), f"a/{n}.{random.choice(('py', 'js', 'html', 'json'))}") for n in range(1, 80)] + [("x", "y"), ("<a>", "b.xml"), ("٣ " * 80, "c.py")]
    alone = [provenance.features(*x) for x in rows]
    for together in (1, 700, 10**9):
        monkeypatch.setattr(provenance, "TOGETHER", together)
        assert provenance.features_of(rows) == alone
    assert provenance.features_of([]) == []


def test_equal_stretches_give_equal_rules():
    random.seed(5)
    lines = [f"call_{i}({random.random()})" for i in range(200)]
    own = [f"other_{i} = {random.random()}" for i in range(120)]
    whole = {h for h, _ in provenance.line_rules("\n".join(lines))[1]}
    inside = {h for h, _ in provenance.line_rules("\n".join(own[:60] + lines + own[60:]))[1]}
    assert len(whole & inside) >= 0.95 * len(whole)
    patched = [x if i % 20 else "patched()" for i, x in enumerate(lines)]
    after = {h for h, _ in provenance.line_rules("\n".join(patched))[1]}
    assert 0.4 * len(whole) <= len(whole & after) < len(whole)
    n, rules = provenance.line_rules("\n".join(lines))
    assert n == 200 and all(2 <= k <= 8 for _, k in rules)
    assert provenance.line_rules("") == (0, []) and provenance.line_rules("only one line") == (1, [])


def test_literals_that_do_not_get_shorter():
    random.seed(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    assert provenance.bits("".join(random.choices(alphabet, k=4000))) > 4
    assert provenance.bits("".join(random.choices("0123456789", k=4000))) > 2.5
    assert provenance.bits("abcd" * 1000) < 0.5
    blob = "".join(random.choices(alphabet, k=4000))
    assert signs("# (c) someone, " + "many words of a licence " * 40 + f'\nDATA = "{blob}"\n')[2]
    assert not signs(f'DATA = "{"abcd" * 1000}"\n')[2]
    assert not signs('"""' + "some prose about what this module does and why it is there\n" * 40 + '"""\nx = 1\n')[2]


def test_signs():
    assert signs(HAND) == (False, False, False, False)
    assert signs("# Code generated by x 1.2.3. DO NOT EDIT.\n" + HAND)[0]
    assert signs("# Not generated: change by hand when rules change.\n" + HAND) == (False, False, False, False)
    assert not signs(HAND + "# generated by hand, do not edit the order\n")[0]
    rows = "".join(f"    field_{i} = Field({i}, kind='int', default=None)\n" for i in range(40))
    assert signs(f"class A(Message):\n{rows}")[0]
    random.seed(1)
    assert signs("DATA = [\n" + "".join("    " + ", ".join(str(random.randint(0, 65535)) for _ in range(12)) + ",\n" for _ in range(40)) + "]\n")[2]
    assert signs("".join(f"function f{i}(a,b){{return a*b+{i}}}" for i in range(60)), "x.js")[1]
    assert signs("/*\n * quill 1.2.3 - a small toolkit\n */\n" + HAND)[3]
    assert signs("") == (False, False, False, False)


def test_copies_and_requests(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    shapes = ["{} = {}({}, 3)", "if {} > {}: return {}", "{}.{}[{}] = None", "for {} in {}: {}()", "assert {} and not {}, {}", "x[{}] += {} - {}", "del {}, {}, {}", "{} = [{} for {} in y]", "raise {}({}) from {}", "print({}, {} * 2, {!r})"]
    own = lambda: "".join(random.choice(shapes).format(*random.sample(words, 3)) + "\n" for _ in range(30))
    library = own()
    patched = library.replace("\n", "\npatched = 1\n", 1)
    files = [(1, "p", "lib/x.py", library), (2, "q", "src/y.py", patched), (3, "p", "src/a.py", own()), (4, "q", "src/b.py", own()), (4, "q", "src/b.py", None), (5, "p", "src/c.py", None), (6, "p", "src/d.PY", "# @generated by z\n")]
    df = spark.createDataFrame(files, "file_id bigint, project_id string, file_path string, code string").where("not (file_id = 4 and code is null)")
    df = df.unionByName(df)  # everything delivered twice
    got = {r.file_id: r.reason for r in provenance.verdicts(provenance.judge_files(df)).collect()}
    assert got == {1: "vendored", 2: "vendored", 3: None, 4: None, 5: None, 6: "generated"}
    requests = [(1, "p", [" ./lib\\x.py", "lib//x.py", None, "", "gone.py", "src/a.py"], None), (2, "p", ["lib/x.py", "src/d.PY"], [" .Py ", None, ".tar.gz"]), (3, "q", ["lib/x.py"], []), (4, "q", ["/src/y.py", "src/y.py"], ["py.txt"])]
    req = spark.createDataFrame(requests, "request_id bigint, project_id string, file_paths array<string>, skip_types array<string>")
    assert {(r.request_id, r.file_id) for r in provenance.found(req, df).collect()} == {(1, 1), (4, 2)}
    assert provenance.found(req.limit(0), df).count() == 0 and provenance.verdicts(provenance.judge_files(df.limit(0))).count() == 0
