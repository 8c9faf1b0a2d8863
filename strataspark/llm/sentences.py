"""Sentence boundaries across languages and scripts (problem 8).

Two passes. The first learns, for each language and without labels: abbreviations (types that keep
company with a period more than chance and length allow, by a log-likelihood ratio), collocations
(pairs that hang together across a period) and sentence starters (types that follow a sure end more
often than chance). Spark counts types and pairs around periods in all texts; the ratios are column
expressions over these counts. The second pass cuts every text into blocks (paragraphs, headings,
list items, docstring entries), and each block at its stops, every period being classified by the
learned statistics.

Defined cases
    * Null, empty and blank texts have no units, and neither has fenced code.
    * An unknown, null or differently spelt language is read with the statistics of all languages.
    * Repeated rows give repeated units; positions count code points of the text as it is.
    * Whole texts are read, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

BLANK = " \t\r\n\x0b\x0c\xa0            ​    　﻿"
_B = "[" + BLANK.replace("\r", "").replace("\n", "") + "]"

#: Thresholds of the published method (ratio of abbreviations, starters, collocations).
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Occurrences below which nothing is learned of a type or pair.
SUPPORT = 3

#: The learned statistics go with the tasks up to this many entries; beyond it they are joined to the texts.
MODEL_ROWS = 200_000
#: Parts into which the rows of an entry are cut where it is joined.
SALTS = 8

# --- blocks --------------------------------------------------------------------------------------

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
FENCE = re.compile(r"(`{3,}|~{3,})")
HEAD = re.compile(r"(#{1,6})" + _B + r"+(.*?)(?:" + _B + r"+#+)?" + _B + r"*\Z")
ITEM = re.compile(r"(?:[-*+•‣–]|\(?\d{1,9}[.)])" + _B + r"+(?=\S)")
UNDERLINE = re.compile(r"(?:={2,}|-{2,})\Z")
SECTION = re.compile(r"[A-Z][A-Za-z]*(?: [A-Za-z]+)?:\Z")
ENTRY = re.compile(r"[*`\w.\[\]-]+(?:" + _B + r"*\([^()]*(?:\([^()]*\)[^()]*)*\))?" + _B + r"*:(?=" + _B + r"|\Z)")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """Spans that no sentence crosses: start, end, and whether the span is one unit as it stands."""
    out: list[tuple[int, int, bool]] = []
    start = end = -1  # the open block
    fence = ""
    listed = section = False
    last_line = (-1, -1)
    at = 0

    def close() -> None:
        nonlocal start
        if start >= 0:
            out.append((start, end, False))
            start = -1

    for line in LINE.findall(text):
        line_at, at = at, at + len(line)
        body = line.strip(BLANK)
        if not body:
            close()
            if not fence:
                listed = section = False
            continue
        first = body[0]
        inner = line_at + line.index(first) if line[0] != first else line_at
        stop = inner + len(body)
        if first in "`~" and (m := FENCE.match(body)):
            if not fence:
                close()
                fence = m[1]
            elif body.startswith(fence) and not body.strip(fence[0]):
                fence = ""
            continue
        if fence:
            continue
        if first == "#" and (m := HEAD.match(body)):
            close()
            if m[2]:
                out.append((inner + m.start(2), inner + m.end(2), True))
            listed = section = False
            continue
        if first in "=-" and UNDERLINE.match(body):
            if start >= 0:
                if last_line[0] > start:
                    out.append((start, last_line[0], False))
                out.append((last_line[0], last_line[1], True))
                start = -1
            listed = section = False
            continue
        if (first in "-*+•‣–(" or first.isdigit()) and (listed or start < 0) and (m := ITEM.match(body)):
            close()
            start, end = inner + m.end(), stop
            listed, section = True, False
            last_line = (start, stop)
            continue
        if start < 0 and first.isupper() and body[-1] == ":" and SECTION.match(body):
            out.append((inner, stop, True))
            section = True
            continue
        if section and inner > line_at and ENTRY.match(body):
            close()
            start, end = inner, stop
            last_line = (inner, stop)
            continue
        if start < 0:
            start = inner
        end = stop
        last_line = (inner, stop)
    close()
    return out


# --- stops ---------------------------------------------------------------------------------------

OPEN_STOPS = "。！？｡؟۔।॥"
CLOSERS = "\"'”’»›)\\]）」』】］"
TOKEN = re.compile(
    r"`[^`]*`"
    r'|"[^"]*"|“[^”“]*”|„[^“”„]*[“”]|«[^»«]*»|‹[^›‹]*›|「[^」「]*」|『[^』『]*』'
    r"|\((?:[^()]|\([^()]*\))*\)|（[^（）]*）|【[^【】]*】"
    rf"|[{OPEN_STOPS}][{OPEN_STOPS}.!?…]*[{CLOSERS}]*"
    rf"|[.!?…]+[{CLOSERS}]*(?=\s|\Z|﻿|[^\W\d_])"
)
QUOTES = '"“„«‹「『'
BRACKETS = "(（【"
WORD_BEFORE = re.compile(r"[^\s(（\[«„“\"「,;:/]*\Z")
NEXT = re.compile(r"[\s﻿]*([\"'“„«‹「『(（\[¿¡`]*)([^\s]*)")
CODE = re.compile(r"[_(./\\\d]|[a-z][A-Z]")
CASELESS = re.compile(r"[֐-ࣿऀ-෿฀-໿ᄀ-ᇿ぀-ヿ㐀-鿿가-힯豈-﫿]")
THAI_GAP = re.compile(r"(?<=[ก-ฮะ-ฺเ-ๅ็-๎])[ \t\r\n\xa0]+(?=[ก-ฮเ-ไ])")
FUSED = re.compile(r"[^\W\d_]{2,}|\d\Z|[)`%”\"]\Z")
NUMBER = re.compile(r"[\d.,:/%-]*\d[\d.,:/%-]*\Z")


class Model:
    """What was learned of one language: abbreviations, starters and collocations."""

    __slots__ = ("abbreviations", "collocations", "starters")

    def __init__(self) -> None:
        self.abbreviations: set[str] = set()
        self.starters: set[str] = set()
        self.collocations: set[tuple[str, str]] = set()

    def add(self, kind: str, first: str, second: str) -> None:
        if kind == "abbreviation":
            self.abbreviations.add(first)
        elif kind == "starter":
            self.starters.add(first)
        else:
            self.collocations.add((first, second))


def _before(text: str, at: int, floor: int) -> str:
    """The word before ``at``, however long."""
    width = 60
    while True:
        low = max(floor, at - width)
        word = WORD_BEFORE.search(text, low, at)[0]
        if len(word) < at - low or low == floor:
            return word
        width *= 4


def _type(word: str) -> str:
    return "##" if NUMBER.match(word) else word.lower()


def _starts(text: str, at: int, end: int) -> tuple[str, str]:
    """What follows: 'end', 'upper', 'lower', 'digit', 'code' or 'caseless', and the word itself."""
    m = NEXT.match(text, at, end)
    opening, word = m[1], m[2]
    if not word:
        return ("end" if not opening else "upper"), ""
    c = word[0]
    if "`" in opening:
        return "code", word
    if c.isupper() or c.istitle():
        return "upper", word
    if CASELESS.match(c):
        return "caseless", word
    if c.isdigit():
        return "digit", word
    if c.islower():
        return ("code" if CODE.search(word.rstrip(".,;:!?)\"'")) else "lower"), word
    return ("upper" if opening else "other"), word


def sentences(text: str, start: int, end: int, model: Model) -> list[tuple[int, int]]:
    """Units of one block."""
    out: list[tuple[int, int]] = []
    begin = start

    def cut(at: int) -> None:
        nonlocal begin
        s, e = begin, at
        while s < e and text[s] in BLANK:
            s += 1
        while e > s and text[e - 1] in BLANK:
            e -= 1
        if s < e:
            out.append((s, e))
        begin = at

    for m in TOKEN.finditer(text, start, end):
        j = m.end()
        if j >= end:
            break
        run = m[0]
        c = run[0]
        if c == "`":
            continue
        if c in QUOTES or c in BRACKETS:
            if run[-2:-1] not in ".!?…。！？؟۔।॥" or len(run) < 3:
                continue
            kind, word = _starts(text, j, end)
            spaced = text[j] in BLANK
            whole = not text[begin : m.start()].strip(BLANK)
            if c in BRACKETS:
                if whole and (spaced and kind != "lower" or kind == "caseless"):
                    cut(j)
                elif spaced and kind in ("upper", "code") and run[-2] in "!?":
                    pass
            elif spaced and kind in ("upper", "code"):
                before = run[1:-1].rsplit(None, 1)[-1]
                if run[-2] != "." or _type(before[:-1]) not in model.abbreviations:
                    cut(j)
            continue
        if c in OPEN_STOPS:
            cut(j)
            continue
        stops = run.rstrip(CLOSERS.replace("\\", ""))
        spaced = text[j] in BLANK
        if not spaced:
            # a blank is missing after the stop: a word before it, and a word in upper case after it
            before = _before(text, m.start(), start)
            after = text[j : j + 2]
            if CASELESS.match(after):
                if stops[-1] in "!?":
                    cut(j)
            elif after[:1].isupper() and stops != "…" and _sure(before, after, text, j, end):
                if len(before) > 3 or _type(before) not in model.abbreviations:
                    cut(j)
            continue
        kind, word = _starts(text, j, end)
        if "!" in stops or "?" in stops:
            if kind != "lower" and kind != "other" or len(run) == len(stops) and kind == "other":
                cut(j)
            continue
        if len(stops) > 1 or stops == "…":
            if kind == "upper":
                cut(j)
            continue
        if kind == "lower" or kind == "end":
            continue
        before = _type(_before(text, m.start(), start))
        following = word.strip(".,;:!?()\"'»”").lower()
        if before == "##":
            if (before, following) not in model.collocations and kind != "digit":
                cut(j)
            continue
        known = before in model.abbreviations or len(before) == 1 and before.isalpha() or before.rpartition("-")[2] in model.abbreviations
        if not known:
            if kind != "other" and (kind != "digit" or (before, "##") not in model.collocations):
                cut(j)
        elif kind == "upper" and following in model.starters and (before, following) not in model.collocations:
            cut(j)
    cut(end)
    if CASELESS.search(text, start, end) and THAI_GAP.search(text, start, end):
        return [part for s, e in out for part in _thai(text, s, e)]
    return out


def _sure(before: str, after: str, text: str, at: int, end: int) -> bool:
    word = NEXT.match(text, at, end)[2]
    if not FUSED.search(before) or not before:
        return False
    return len(word) > 1 and word[1].islower() or len(word.rstrip(".,")) == 1 or word[:1] in "ÀÁÂÄÇÈÉÊÍÎÓÔÖÚÜ"


def _thai(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Thai writes a blank between sentences and none inside a phrase."""
    at = start
    for m in THAI_GAP.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def units(text: str, model: Model) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end, single in blocks(text):
        if single:
            out.append((start, end))
        else:
            out += sentences(text, start, end, model)
    return out


# --- learning ------------------------------------------------------------------------------------

WORDS = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[^\W\d_]|['’.-](?=[^\W\d_]))*+\.?(?!\w)")
AFTER = re.compile(r"\.[)\"”»]*[ \xa0\r\n]+[\"“„«(]?([^\W_][^\s.,;:!?()\"'»”`]*)")
LAST = re.compile(r"(?:(?<![\w.])(\d+)|(?<!\w)([^\W\d_](?:[^\W\d_]|['’.-](?=[^\W\d_]))*+))\Z")
WORDLIKE = re.compile(r"[\w'’.-]+")


def _last_word(text: str, at: int) -> re.Match | None:
    """The word or number that ends at ``at``, however long."""
    width = 18
    while True:
        low = max(0, at - width)
        if low == 0 or not WORDLIKE.fullmatch(text, low, at):
            return LAST.search(text, low, at)
        width *= 4


#: Distinct spellings that a task gathers before it passes them on.
GATHERED = 400_000

COUNTS = "lang string, kind string, first string, second string, n bigint, stopped bigint, lower bigint"
COUNT_FIELDS = pa.schema([(x, pa.string()) for x in ("lang", "kind", "first", "second")] + [(x, pa.int64()) for x in ("n", "stopped", "lower")])


def language(column: Column) -> Column:
    """Two-letter language of a spelling such as ``EN``, ``en_XX`` or `` en-xx ``; '' if unknown."""
    short = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(short.isin("und", "unk", "mul", "zxx"), "").otherwise(F.coalesce(short, F.lit("")))


#: Languages written in other scripts; Latin words in their texts count as English ones.
OTHER_SCRIPTS = {"ru", "ja", "zh", "ko", "hi", "ar", "th"}


def _home(lang: str, word: str) -> str:
    return "en" if lang in OTHER_SCRIPTS and "a" <= word[:1] <= "z" else lang


def _counted(words: dict[str, Counter], pairs: dict[str, Counter]) -> pa.RecordBatch:
    """Counts under each language, and under '' those of all texts together."""
    rows = []
    whole: dict[str, list[int]] = {}
    for name, counter in words.items():
        folded: dict[tuple[str, str], list[int]] = {}
        for piece, n in counter.items():
            for w in WORDS.findall(piece):
                low = w.lower()
                bare = low.rstrip(".")
                if len(bare) > 2 and not bare[0].islower():
                    bare = ""  # letters without case: counts as a word, and can be neither abbreviation nor starter
                stopped = n if low[-1] == "." else 0
                small = 0 if w[0].isupper() else n
                home = _home(name, low)
                at = folded.get((home, bare))
                if at is None:
                    folded[home, bare] = [n, stopped, small]
                else:
                    at[0] += n
                    at[1] += stopped
                    at[2] += small
        for (home, word), (n, stopped, small) in folded.items():
            at = whole.setdefault(word, [0, 0, 0])
            at[0] += n
            at[1] += stopped
            at[2] += small
            if home:
                rows.append((home, "word", word, "", n, stopped, small))
    rows += [("", "word", word, "", *ns) for word, ns in whole.items()]
    across: Counter = Counter()
    for name, counter in pairs.items():
        seen: Counter = Counter()
        for (a, after), n in counter.items():
            # upper-case starts are kept apart from others by the mark in front
            mark = "^" if after[0].isupper() else "_"
            b = "##" if after[0].isdigit() else after.lower()
            home = _home(name, b if a == "##" else a)
            # of words in lower case it counts only that there was one
            seen[home, a, mark + (b if mark == "^" or b == "##" else "")] += n
        for (home, a, b), n in seen.items():
            across[a, b] += n
            if home:
                rows.append((home, "pair", a, b, n, 0, 0))
    rows += [("", "pair", a, b, n, 0, 0) for (a, b), n in across.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNT_FIELDS)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, COUNT_FIELDS, strict=True)], schema=COUNT_FIELDS)


def count_types(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """How often each type stands with and without a period, and each pair across a period.

    No word holds a blank, so the words of a text are those of its pieces between blanks, and each
    distinct piece is searched once. Under '' stand the counts of all texts, with those of no known language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        pairs: dict[str, Counter] = {}
        for batch in batches:
            for name, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t:
                    words.setdefault(name, Counter()).update(t.split())
                    counter = pairs.setdefault(name, Counter())
                    for m in AFTER.finditer(t):
                        before = _last_word(t, m.start())
                        counter[(before[2].lower() if before[2] else "##") if before else "", m[1]] += 1
            if sum(map(len, words.values())) + sum(map(len, pairs.values())) > GATHERED:
                yield _counted(words, pairs)
                words, pairs = {}, {}
        yield _counted(words, pairs)

    parts = docs.select(language(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "kind", "first", "second").agg(*[F.sum(x).alias(x) for x in ("n", "stopped", "lower")])


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log(F.greatest(y, F.lit(1e-12)))).otherwise(F.lit(0.0))


def _ratio(count_a: Column, count_b: Column, count_ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that b follows a more often than it follows anything."""
    p = count_b / n
    p1 = count_ab / count_a
    p2 = (count_b - count_ab) / F.greatest(n - count_a, F.lit(1.0))

    def likelihood(k: Column, of: Column, prob: Column) -> Column:
        return _xlogy(k, prob) + _xlogy(of - k, 1 - prob)

    rest, others = count_b - count_ab, n - count_a
    return -2 * (likelihood(count_ab, count_a, p) + likelihood(rest, others, p) - likelihood(count_ab, count_a, p1) - likelihood(rest, others, p2))


def learn(counts: DataFrame) -> DataFrame:
    """Rows (lang, kind, first, second): abbreviations, starters and collocations of each language,
    and under '' those of all texts together, with those of no known language among them."""
    words = counts.where("kind = 'word'").select("lang", F.col("first").alias("word"), *[F.col(c).cast("double").alias(x) for c, x in (("stopped", "stopped"), ("lower", "lower"), ("n", "total"))])
    whole = words.groupBy("lang").agg(F.sum("total").alias("words"), F.sum("stopped").alias("stops"))
    typed = words.where("word <> ''").join(F.broadcast(whole), "lang")  # one row for each language
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    periods = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."))) + 1
    p_stop = F.col("stops") / F.col("words")
    plain = F.col("total") - F.col("stopped")
    null = _xlogy(F.col("stopped"), p_stop) + _xlogy(plain, 1 - p_stop)
    sure = _xlogy(F.col("stopped"), F.lit(0.99)) + _xlogy(plain, F.lit(0.01))
    score = -2 * (null - sure) * F.exp(-letters) * periods * F.pow(letters.cast("double"), -plain)
    # letters without case say nothing about what follows, so only the shortest of their types count
    cased = F.col("word").rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}.'’-]+$") | (letters <= 2)
    short = typed.where((F.col("stopped") >= SUPPORT) & cased).withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("lang", "word")
    pairs = counts.where("kind = 'pair'").select("lang", "first", F.substr("second", F.lit(2)).alias("second"), F.col("second").startswith("^").alias("upper"), F.col("n").cast("double").alias("n"))

    # an abbreviation stands inside sentences: what follows is not always in upper case
    inside = pairs.groupBy("lang", F.col("first").alias("word")).agg(
        F.sum(F.when(F.col("upper"), 0.0).otherwise(F.col("n"))).alias("inner"), F.sum("n").alias("all")
    )
    title = pairs.where("upper").groupBy("lang", F.col("first").alias("word")).agg(F.max("n").alias("top"), F.sum("n").alias("uppers"))
    abbreviations = (
        short.join(inside, ["lang", "word"], "left")
        .join(title, ["lang", "word"], "left")
        .where("all is null or inner >= 0.1 * all or top >= 0.5 * uppers or length(word) <= 2")
        .select("lang", "word")
    )

    marked = pairs.join(abbreviations.withColumnRenamed("word", "first").withColumn("short", F.lit(True)), ["lang", "first"], "left")
    is_short = F.col("short").isNotNull() | ((F.length("first") == 1))
    sure_end = marked.where(~is_short & (F.col("first") != "##") & F.col("upper"))
    ends = sure_end.groupBy("lang").agg(F.sum("n").alias("ends"))
    after = sure_end.groupBy("lang", F.col("second").alias("word")).agg(F.sum("n").alias("n"))
    starters = (
        after.join(typed.select("lang", "word", "total", "words"), ["lang", "word"])
        .join(F.broadcast(ends), "lang")
        .where((F.col("n") / F.col("ends") > F.col("total") / F.col("words")) & (F.col("total") >= F.col("n")))
        .where(_ratio(F.col("ends"), F.col("total"), F.col("n"), F.col("words")) >= STARTER)
        .select("lang", "word")
    )

    across = marked.where((is_short | (F.col("first") == "##")) & F.col("upper")).groupBy("lang", "first", "second").agg(F.sum("n").alias("n"))
    # a word also written in lower case is in upper case only because a sentence begins with it
    uncommon = typed.where("lower = 0 or lower < 0.02 * total")
    common = typed.where("lower >= 0.02 * total").select("lang", "word")
    openers = across.where((F.col("first") != "##")).select("lang", F.col("second").alias("word")).distinct().join(common, ["lang", "word"])
    firsts = across.groupBy("lang", "first").agg(F.sum("n").alias("n_first"))
    collocations = (
        across.where(F.col("n") >= SUPPORT)
        .join(firsts, ["lang", "first"])
        .join(uncommon.select("lang", F.col("word").alias("second"), "total", "words"), ["lang", "second"])
        .join(starters.withColumnRenamed("word", "second"), ["lang", "second"], "left_anti")
        .where((F.col("n") / F.col("n_first") > F.col("total") / F.col("words")) & (F.col("total") >= F.col("n")))
        .where(_ratio(F.col("n_first"), F.col("total"), F.col("n"), F.col("words")) >= COLLOCATION)
        .select("lang", "first", "second")
    )
    # types whose period is followed by a number more often than chance: "No. 7"
    total = pairs.groupBy("lang").agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("second") == "##", F.col("n")).otherwise(0.0)).alias("numbers"))
    numbered = (
        pairs.where("first <> '' and first <> '##'")
        .groupBy("lang", "first")
        .agg(F.sum("n").alias("n_first"), F.sum(F.when(F.col("second") == "##", F.col("n")).otherwise(0.0)).alias("n"))
        .where(F.col("n") >= SUPPORT)
        .join(F.broadcast(total), "lang")
        .where((F.col("n") / F.col("n_first") > F.col("numbers") / F.col("pairs")) & (F.col("n") >= 0.5 * F.col("n_first")))
        .where(_ratio(F.col("n_first"), F.col("numbers"), F.col("n"), F.col("pairs")) >= COLLOCATION)
        .select("lang", F.lit("collocation").alias("kind"), "first", F.lit("##").alias("second"))
    )
    none = F.lit("").alias("second")
    return (
        abbreviations.select("lang", F.lit("abbreviation").alias("kind"), F.col("word").alias("first"), none)
        .unionByName(starters.select("lang", F.lit("starter").alias("kind"), F.col("word").alias("first"), none))
        .unionByName(openers.select("lang", F.lit("starter").alias("kind"), F.col("word").alias("first"), none))
        .unionByName(collocations.select("lang", F.lit("collocation").alias("kind"), "first", "second"))
        .unionByName(numbered)
        .distinct()
    )


# --- splitting -----------------------------------------------------------------------------------

UNITS = "start_pos bigint, end_pos bigint"


def models(rows: list[tuple[str, str, str, str]]) -> dict[str, Model]:
    """A model for each language, and '' for texts of no known one; English is read in all of them."""
    by: dict[str, Model] = {"": Model()}
    for lang, kind, first, second in rows:
        by.setdefault(lang, Model()).add(kind, first, second)
        if lang:
            by[""].add(kind, first, second)
    english = [r for r in rows if r[0] == "en"]
    for lang, model in by.items():
        if lang not in ("", "en"):
            for _, kind, first, second in english:
                model.add(kind, first, second)
    return by


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Sentence units of every text: key, start_pos, end_pos."""
    # the counts are needed three times over, and are small beside the texts
    learned = learn(kept(count_types(docs, text, lang)))
    kind = docs.schema[key].dataType.simpleString()
    rows = learned.limit(MODEL_ROWS + 1).collect()
    chosen = docs.select(F.col(key).alias("key"), language(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("text"))
    if len(rows) <= MODEL_ROWS:
        by = models([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, starts, ends = [], [], []
                for i, (name, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    if t:
                        found = units(t, by.get(name) or by[""])
                        keys += [i] * len(found)
                        starts += [s for s, _ in found]
                        ends += [e for _, e in found]
                yield pa.record_batch([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "start_pos", "end_pos"])

        return chosen.mapInArrow(run, f"`{key}` {kind}, {UNITS}")
    return _split_joined(chosen, learned, key, kind)


class _Asked(set):
    """Stands for a set of a model: notes what it is asked for, and always gives the same answer."""

    def __init__(self, answer: bool) -> None:
        super().__init__()
        self.answer = answer

    def __contains__(self, item: object) -> bool:
        self.add(item)
        return self.answer


def asked(text: str) -> set[tuple[str, str, str]]:
    """Every entry (kind, first, second) that cutting the text can look up in any model.

    What is looked up at a stop depends on the answers at that stop alone. What a no leads to is met
    when all answers are no, what a yes leads to when all are yes; no lookup needs one of each.
    """
    found: set[tuple[str, str, str]] = set()
    for answer in (False, True):
        model = Model()
        model.abbreviations, model.starters, model.collocations = _Asked(answer), _Asked(answer), _Asked(answer)
        units(text, model)
        found |= {("abbreviation", w, "") for w in model.abbreviations} | {("starter", w, "") for w in model.starters}
        found |= {("collocation", a, b) for a, b in model.collocations}
    return found


def _split_joined(chosen: DataFrame, learned: DataFrame, key: str, kind: str) -> DataFrame:
    """The same for statistics too large to go with the tasks: each text gets those it can ask for,
    of the languages that :func:`models` gives it."""
    learned = kept(learned)
    named = learned.where("lang <> ''").select(F.col("lang").alias("name"), F.lit(True).alias("named")).distinct()
    # one row for each language; the others are read with the statistics of all
    tagged = (
        chosen.join(F.broadcast(named), F.col("lang") == F.col("name"), "left")
        .select("key", "text", F.when(F.col("named"), F.col("lang")).otherwise("").alias("model"))
        .withColumn("row", F.xxhash64("key", "model", "text"))
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, entries = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                found = asked(t) if t else ()
                at += [i] * len(found)
                entries += found
            kinds, firsts, seconds = zip(*entries, strict=True) if entries else ((), (), ())
            taken = [batch.column(c).take(pa.array(at, pa.int32())) for c in (0, 1)]
            yield pa.record_batch([*taken, *(pa.array(x, pa.string()) for x in (kinds, firsts, seconds))], names=["row", "model", "kind", "first", "second"])

    needs = tagged.select("row", "model", "text").mapInArrow(ask, "row bigint, model string, kind string, first string, second string")
    # a text's own language and English, or all of them
    read = needs.select("*", F.explode(F.when(F.col("model").isin("", "en"), F.array("model")).otherwise(F.array("model", F.lit("en")))).alias("lang"))
    # the rows of an entry are cut by text, so that one which very many texts ask for is not one task
    read = read.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    known = learned.where("lang <> ''").unionByName(learned.withColumn("lang", F.lit(""))).distinct()
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    entry = F.struct("kind", "first", "second").alias("entry")
    entries = read.join(known, ["lang", "kind", "first", "second", "salt"], "left_semi").groupBy("row", "model").agg(F.collect_set(entry).alias("entries"))
    joined = tagged.join(entries, ["row", "model"], "left").select("key", "text", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for i, (t, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if t:
                    model = Model()
                    for x in found or ():
                        model.add(x["kind"], x["first"], x["second"])
                    cut = units(t, model)
                    keys += [i] * len(cut)
                    starts += [s for s, _ in cut]
                    ends += [e for _, e in cut]
            yield pa.record_batch([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "start_pos", "end_pos"])

    return joined.mapInArrow(run, f"`{key}` {kind}, {UNITS}")
