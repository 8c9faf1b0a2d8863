"""Problem 8: blocks and stops on small texts, learning on a small corpus."""

from strataspark.llm import sentences


def model(*abbreviations, starters=(), collocations=()):
    m = sentences.Model()
    m.abbreviations |= set(abbreviations)
    m.starters |= set(starters)
    m.collocations |= set(collocations)
    return m


def cut(text, m=None):
    return [text[s:e] for s, e in sentences.units(text, m or model())]


def test_blocks():
    text = "# Title #\n\nOne here.\nTwo there\n\nNext\n====\n\n- item one. And more\n- item two\n\n1. first\n2) second\n\nArgs:\n    a (int): The first. It counts.\n    b: The second\n\n```py\nx. Y.\n```\n~~~\nZ. W.\n~~~\nLast"
    assert cut(text) == ["Title", "One here.", "Two there", "Next", "item one.", "And more", "item two", "first", "second", "Args:", "a (int): The first.", "It counts.", "b: The second", "Last"]


def test_stops():
    m = model("e.g", "dr", "etc", "p.m", starters=("the",), collocations=(("##", "tag"), ("no", "##")))
    assert cut("See e.g. the file a.b.py v1.2 now. It is 3.5 ms. Dr. Reed left, etc. The end!", m) == ["See e.g. the file a.b.py v1.2 now.", "It is 3.5 ms.", "Dr. Reed left, etc.", "The end!"]
    assert cut("Am 3. Tag neu. See No. 7 here. x_y() ends. z_w() goes", m) == ["Am 3. Tag neu.", "See No. 7 here.", "x_y() ends.", "z_w() goes"]
    assert cut('It says "None left. Retrying." and stops. "Is it?" is asked. You ask: "Why?" This is it.') == ['It says "None left. Retrying." and stops.', '"Is it?" is asked.', 'You ask: "Why?"', "This is it."]
    assert cut("(The old one works.) Next one ... but slow. What?! Yes") == ["(The old one works.)", "Next one ... but slow.", "What?!", "Yes"]
    assert cut("It ends here.The next begins. a.B stays") == ["It ends here.", "The next begins.", "a.B stays"]


def test_scripts():
    assert cut("每个任务？不要调用！日志显示“没有。重试。”，然后继续。") == ["每个任务？", "不要调用！", "日志显示“没有。重试。”，然后继续。"]
    assert cut("値は（空も含む。）有効です。次。") == ["値は（空も含む。）有効です。", "次。"]
    assert cut("यह है। वह क्यों? ठीक") == ["यह है।", "वह क्यों?", "ठीक"]
    assert cut("هل هذا؟ نعم. الحد 1.5 هنا") == ["هل هذا؟", "نعم.", "الحد 1.5 هنا"]
    assert cut("เก็บไว้ 475 นาที ดูแฟ้ม a.md ได้") == ["เก็บไว้ 475 นาที", "ดูแฟ้ม a.md ได้"]
    assert cut("¿Qué es? ¡Sí! Fin") == ["¿Qué es?", "¡Sí!", "Fin"]


def test_edges():
    assert cut("") == cut(" \n\r\n﻿") == []
    assert cut("﻿  Only one \xa0") == ["Only one"]
    assert cut("a\r\nb.\r\n\r\nC") == ["a\r\nb.", "C"]
    long = "Word one. " * 5000
    assert len(cut(long)) == 5000


def test_learning_and_frames(spark):
    texts = ["The ca. value is set. The box holds ca. nine parts. Each part is new."] * 6 + ["Fig. 3 shows it. See Fig. 4 for more. The end of it."] * 6 + ["set it new, new set for it as a set of more parts it has"] * 6
    rows = [(i, t, "EN_x", "c") for i, t in enumerate(texts)] + [(98, None, None, "c"), (99, "", "de", "c"), (100, "One. Two", None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start_pos string")
    learned = {(r["kind"], r["first"]) for r in sentences.learn(sentences.count_types(df)).collect()}
    assert ("abbreviation", "ca") in learned and not {("abbreviation", "it"), ("abbreviation", "set")} & learned
    got = sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences.split(df).collect())
    assert [x for x in got if x[0] == 0] == [(0, 0, 21), (0, 22, 51), (0, 52, 69)]
    assert [x for x in got if x[0] >= 98] == [(100, 0, 4), (100, 5, 8)]
    joined = sentences.MODEL_ROWS
    try:
        sentences.MODEL_ROWS = 0  # the way for statistics that are too large to go with the tasks
        assert sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences.split(df).collect()) == got
    finally:
        sentences.MODEL_ROWS = joined
    assert sentences.split(df.limit(0)).count() == 0


def test_every_word_of_every_text_is_counted(spark):
    texts = ["¿Por qué? ¡No! f(list[str]): a.b/c.d one[two] cafe\u0301 e.g. x_y Mr.", "and/or (see) —dash— 3rd Dr.\xa0Who किताब", "Donaudampfschifffahrtsgesellschaftskapitän. Достопримечательностями\u3000next"]
    rows = [(t, lang) for t in texts for lang in ("es", None, "und", "not known", "")]
    got = sentences.count_types(spark.createDataFrame(rows, "text string, lang string")).where("kind = 'word'").collect()
    old = sentences.re.compile(r"[^\W\d_](?:[^\W\d_]|['’.-](?=[^\W\d_]))*\.?(?![\w])")
    want = sentences.Counter()
    for w in (w for t in texts for w in old.findall(t)):
        bare = w.lower().rstrip(".")
        bare = bare if len(bare) < 3 or bare[0].islower() else ""
        want[bare, "n"] += 1
        want[bare, "stopped"] += w.endswith(".")
        want[bare, "lower"] += not w[0].isupper()
    assert {(x, "n") for x in ("donaudampfschifffahrtsgesellschaftskapitän", "достопримечательностями", "por", "no", "list", "c.d", "two")} <= want.keys()
    for lang, times in (("es", 1), ("", 5)):
        assert {(r["first"], x): r[x] for r in got if r.lang == lang for x in ("n", "stopped", "lower")} == {k: n * times for k, n in want.items()}


def test_long_words_are_learned(spark):
    long = "verwaltungsgerichtsbarkeitsentscheidungen"
    texts = [f"Hier ist es. {long.capitalize()} sind da. Das Haus ist alt. {long.capitalize()} gelten."] * 60 + [f"die {i} alten Sachen und das Haus ist es neu da hier alt" for i in range(60)]
    df = spark.createDataFrame([(t, "de") for t in texts], "text string, lang string")
    assert ("starter", long) in {(r.kind, r["first"]) for r in sentences.learn(sentences.count_types(df)).collect()}
    pairs = sentences.count_types(spark.createDataFrame([(f"a {long}. B. {long.capitalize()} x", "de")], "text string, lang string")).where("kind = 'pair' and lang = 'de'")
    assert {(r["first"], r["second"]) for r in pairs.collect()} == {(long, "^b"), ("b", "^" + long)}
    assert sentences._before("x" * 500 + " " + "y" * 500, 1001, 0) == "y" * 500


def test_texts_without_language_are_learned_from(spark):
    texts = ["The qv. value is set. The box holds qv. nine parts. Each part is new."] * 6 + ["set it new, new set for it as a set of more parts it has"] * 6
    df = spark.createDataFrame([(i, t, (None, "und", "??")[i % 3]) for i, t in enumerate(texts)] + [(50, "See qv. Reed now", "xx")], "doc_id bigint, text string, lang string")
    assert ("", "abbreviation", "qv") in {(r.lang, r.kind, r["first"]) for r in sentences.learn(sentences.count_types(df)).collect()}
    got = {(r.doc_id, r.start_pos, r.end_pos) for r in sentences.split(df).collect()}
    assert {x for x in got if x[0] == 50} == {(50, 0, 16)}


def test_few_texts_without_language_are_read_beside_all_others(spark):
    rows = [("xo yes. Nine goes zu. Each part is new.", None)] * 4 + [("part of zu new or zu set is zu part", "xx")] * 40
    learned = sentences.learn(sentences.count_types(spark.createDataFrame(rows, "text string, lang string"))).collect()
    assert "zu" not in {r["first"] for r in learned if r.kind == "abbreviation"}


def test_joined_statistics_give_the_same_units(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(sentences.F.col("doc_id").cast("string"), "text", "lang")
    made = ["The qv. value is set. The box holds qv. nine parts. Each part is new."] * 20 + ["set it new, new set for it as a set of more parts it has. Das gilt am 3. Tag"] * 6
    forms = ["So foo-qv. Reed left", "See (qv. Reed) and x/qv. Reed", '"It is qv." Reed', "ends etc.Next one", "seen qv.Reed so", "As of 3. Each on", "on qv. The box"]
    rows = [(f"m{i}", t, "en") for i, t in enumerate(made)] + [(f"{lang}{i}", t, lang) for lang in ("en", "de", "qq", "und", None) for i, t in enumerate(forms)]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    cut = lambda: sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences.split(df).collect())
    want = cut()
    bare = [(f"qq{i}", s, e) for i, t in enumerate(forms) for s, e in sentences.units(t, sentences.Model())]
    assert [x for x in want if x[0].startswith("qq")] != bare
    monkeypatch.setattr(sentences, "MODEL_ROWS", 0)
    assert cut() == want
