"""Generated, minified and vendored source files, and data kept as code (problem 5).

Re-Pair grammars. The tokens of a file, names and literals reduced to their kind, are paired round
by round: every round replaces the pairs that occur most often by a rule, until no pair occurs four
times or a round hardly shortens the text any more. The size of the grammar beside the length of the file tells how often its rules are reused:
what a tool writes reuses a few rules all over. Where a file is little but literals, the same grammar
over their characters tells how many bits each of them takes: literals that hardly get shorter are data.

For copies between repositories the terminals are lines, and which pairs become rules is decided
alike in every file: in each round a pair of symbols is replaced where its hash is the least among
its neighbours. A rule is named by the hash of what it derives, so a stretch of lines that stands in
two files gives the same rules in both, without a table of rules that all tasks would share. Spark
counts the rules over the whole corpus, with only the least and the greatest project of each, so the
count combines before the shuffle and the files of a rule are gathered nowhere. The share of a file's
lines below rules that another project has decides on vendoring; a patch breaks the rules around it
and no others.

What a file says of itself in its head and what its path says is reported beside the verdict. Signs
of a copy decide nothing. Signs of a tool do, beside the grammar, as the output of many tools has no
more rule reuse than what people write; the README says how many files they alone decide.

Defined cases
    * Null and blank code is hand-written. Files of no rule at all are judged by their head alone.
    * Rule reuse is judged from ``TOKENS`` tokens on; below, a plain list would pass for a tool's work.
    * Redelivered files and requests count once.
    * Paths that are null, empty or name no file are no cases; several spellings of a path are one.
    * Skip types are read without case and with or without the dot; null ones and those of more
      than one suffix drop nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .batches import sliced

#: Rounds of pairing over lines whose rules are compared between projects; their rules derive three
#: to eight lines, so that two lines that any project may write make no copy.
ROUNDS = (2, 3)
#: Share of the lines below rules of another project that makes a copy.
SHARED = 0.35
#: Letters in words beside literals, as a share of the literals' signs, up to which a file can be data;
#: bits that a sign of its literals takes at least.
DATA_WORDS, DATA_BITS = 0.1, 2.0
#: Occurrences of a pair that make a rule, and what remains of the text after a round that is the last one.
OFTEN, HARDLY = 4, 0.95
#: Tokens from which on rule reuse is judged.
TOKENS = 60
#: Tokens of files whose grammars are found together, a file more at most.
TOGETHER = 50_000
#: Parts into which the rows of a rule are cut where they meet the shared rules.
SALTS = 8

#: Grammar size beside length under which a file of a language is taken as written by a tool.
REUSE = {"py": 0.42, "js": 0.45, "mjs": 0.45, "ts": 0.45, "java": 0.36, "go": 0.40, "cpp": 0.34, "cc": 0.34, "cxx": 0.34, "h": 0.34, "hpp": 0.34, "css": 0.3, "html": 0.2, "htm": 0.2}
#: The same for all other suffixes.
REUSE_OTHER = 0.2
TOOL_PATH = re.compile(r"(?:^|/)(?:gen|generated|autogen|__generated__)/|\.(?:g|pb|gen|generated|designer)\.\w+$|_pb2?\.\w+$|_generated\.\w+$")
CONFIGURATION = {"json", "yaml", "yml", "ini", "cfg", "conf", "toml", "properties", "env", "xml", "md", "txt"}
_TEXTS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
COMMENT = {"py": re.compile(_TEXTS + r"|(#[^\r\n]*)"), "css": re.compile(_TEXTS + r"|(/\*[\s\S]*?\*/)"), "html": re.compile(r"(<!--[\s\S]*?-->)"), "": re.compile(_TEXTS + r"|(//[^\r\n]*|/\*[\s\S]*?\*/)")}
MINIFIABLE = {"js", "mjs", "ts", "css", "html", "htm"}

TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\sA-Za-z0-9_]")
TEXT = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
NUMBER = re.compile(r"\d[\w.]*")
DIGITS = re.compile(r"\d(?<![\w$]\d)")
KEYWORDS = frozenset(
    "if else for while return function class def import from const let var public private static void int new in of not and or is None self this try except catch finally "
    "switch case default break continue func package type struct interface map range go defer nil throw throws with as async await lambda yield pass raise match export extends final".split()
)
#: Ways in which a head says that a tool wrote the file, and that it is a copy of something released.
SAYS_TOOL = re.compile(
    r"(?i)\bauto-?(?:matically )?generated\b|@generated\b|\bmachine[- ](?:made|generated|written|produced)\b|\b(?:re)?(?:generated|built|compiled|produced|emitted) (?:automatically )?(?:by|from)\b|\bgenerated on\b"
    r"|\bdo not (?:edit|modify|touch)\b(?! the)|\b(?:edits?|changes)\b[^.\n]{0,60}\b(?:lost|overwritten|vanish|discarded|undone)\b"
    r"|automatisch (?:erzeugt|generiert)|généré(?:e)? automatiquement|generado automáticamente|создан автоматически|自动生成|自動生成"
)
SAYS_COPY = re.compile(r"(?i)\b(?:part of|this is) [\w-]+,? (?:release |version )?v?\d+\.\d+(?:\.\d+)?\b|\bupstream\b|redistribution in source|(?:^|\W)[\w-]+ v?\d+\.\d+\.\d+ (?:\||- an? )|copyright \(c\) \d{4} the [\w-]+ (?:contributors|authors)")
COPY_PATH = re.compile(r"(?:^|/)(?:vendor|vendored|_vendor|third_?party|3rdparty|extern|external|deps|node_modules|bower_components|site-packages)/.+/|/[A-Za-z][\w-]*-\d+\.\d+\.\d+/")
COMMON = re.compile(r"#\s*(?:include|pragma)\b|import\b|from\b.*\bimport\b|package\b|using\b|\"[a-z/]+\"$|\} (?:else|catch|finally)\b|else\b|return\b.{0,12}$|default:|break;|continue;|<(?:!doctype|/?(?:html|head|body|ul|ol|div|section|table|tr)\b[^>]*>$|meta\b)", re.IGNORECASE)
HEAD = re.compile(r"(?:\s|﻿|<!DOCTYPE[^>]*>|#![^\n]*\n|//[^\r\n]*|#(?!include|define|pragma|if|import)[^\r\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|--[^\r\n]*)*", re.IGNORECASE)

FEATURES = (
    "file_id bigint, project_id string, file_path string, says_tool boolean, minified boolean, data boolean, says_copy boolean, ratio double, reused boolean, n_lines int, "
    "rules array<bigint>, sizes array<int>"
)
FIELDS = pa.schema(
    [
        ("file_id", pa.int64()),
        ("project_id", pa.string()),
        ("file_path", pa.string()),
        ("says_tool", pa.bool_()),
        ("minified", pa.bool_()),
        ("data", pa.bool_()),
        ("says_copy", pa.bool_()),
        ("ratio", pa.float64()),
        ("reused", pa.bool_()),
        ("n_lines", pa.int32()),
        ("rules", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
    ]
)


class _Kinds(dict):
    """Kinds of tokens: 1 for texts, 2 for numbers, 3 for names; keywords and signs have their own."""

    signs = 4

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c in "\"'`" and len(token) > 1:
            return 1
        if c.isdigit():
            kind = 2
        elif (c.isalpha() or c in "_$") and token not in KEYWORDS:
            kind = 3
        else:
            kind = self.signs = self.signs + 1
        self[token] = kind
        return kind


_KINDS = _Kinds()
#: Spellings whose kind is remembered; kinds are compared within one file only.
KINDS = 200_000


def grammar(kinds: list[int]) -> tuple[dict[tuple[int, int], int], list[int]]:
    """A Re-Pair grammar, several rules found in each round: rules by the pair that they derive (their
    symbols are negative), and the start string."""
    rules: dict[tuple[int, int], int] = {}
    seq = kinds
    while len(seq) > 1:
        pairs = list(zip(seq, seq[1:]))
        counted = Counter(pairs)
        often = list(map(counted.__getitem__, pairs))
        if max(often) < OFTEN:
            break
        # of two pairs that overlap the one that is more frequent, or else the first
        chosen = [i for i, n, after in zip(range(len(pairs)), often, [*often[1:], 0]) if n >= OFTEN and after <= n]
        out: list[int] = []
        at = 0
        for i in chosen:
            if i < at:
                continue
            if i > at:
                out += seq[at:i]
            pair = pairs[i]
            rule = rules.get(pair)
            if rule is None:
                rule = rules[pair] = -1 - len(rules)
            out.append(rule)
            at = i + 2
        if not at:
            break
        out += seq[at:]
        hardly = len(out) > HARDLY * len(seq)
        seq = out
        if hardly:
            break
    return rules, seq


def derived(rules: dict[tuple[int, int], int], start: list[int]) -> list[int]:
    """What a grammar derives."""
    right = {symbol: pair for pair, symbol in rules.items()}
    out, todo = [], start[::-1]
    while todo:
        symbol = todo.pop()
        if symbol in right:
            todo += right[symbol][::-1]
        else:
            out.append(symbol)
    return out


def grammar_sizes(texts: list[list[int]]) -> list[tuple[int, int]]:
    """Of each text the number of rules and the length of the start string that ``grammar`` finds; the
    rounds of all texts are made at once, each on one array that holds the texts one after the other.
    Kinds are not negative."""
    n = len(texts)
    start = np.fromiter(map(len, texts), np.int64, n)
    seq = np.fromiter(chain.from_iterable(texts), np.int64, start.sum())
    owner = np.repeat(np.arange(n), start)
    # symbols are told apart by text, so a pair is one of its text
    spread = int(seq.max(initial=0)) + 1
    seq += owner * spread
    fresh = n * spread
    base = fresh + len(seq)
    rules = np.zeros(n, np.int64)
    pairs_of, symbols_of = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(seq) > 1:
        code, pairs = pd.factorize(seq[:-1] * base + seq[1:])
        often = np.bincount(code)[code]
        often[owner[1:] != owner[:-1]] = 0
        # of two pairs that overlap the one that is more frequent, or else the first
        chosen = np.flatnonzero((often >= OFTEN) & (np.append(often[1:], 0) <= often))
        # and of a run of them every other one
        place = np.arange(len(chosen))
        chosen = chosen[(place - np.maximum.accumulate(np.where(np.diff(chosen, prepend=-2) != 1, place, 0))) % 2 == 0]
        if not len(chosen):
            break
        code, at = code[chosen], owner[chosen]
        symbol = np.full(len(pairs), -1, np.int64)
        symbol[code] = at
        used = np.flatnonzero(symbol >= 0)
        # a pair that was a rule in an earlier round is the same rule
        there = np.searchsorted(pairs_of, pairs[used])
        known = np.append(pairs_of, -1)[there] == pairs[used]
        rules += np.bincount(symbol[used[~known]], minlength=n)
        new = pairs[used[~known]]
        symbol[used[known]] = symbols_of[there[known]]
        symbol[used[~known]] = np.arange(fresh, fresh + len(new))
        pairs_of, symbols_of = np.append(pairs_of, new), np.append(symbols_of, symbol[used[~known]])
        order = np.argsort(pairs_of)
        pairs_of, symbols_of, fresh = pairs_of[order], symbols_of[order], fresh + len(new)
        seq[chosen] = symbol[code]
        taken = np.bincount(at, minlength=n)
        going = (taken > 0) & (start - taken <= HARDLY * start)
        start -= taken
        keep = going[owner]
        keep[chosen + 1] = False
        seq, owner = seq[keep], owner[keep]
    return list(zip(rules.tolist(), start.tolist()))


def bits(text: str) -> float:
    """Bits that a character takes when a text is written as its grammar."""
    [(rules, start)] = grammar_sizes([[*map(ord, text)]])
    symbols = rules + len(set(text))
    return (start + 2 * rules) * math.log2(max(symbols, 2)) / max(len(text), 1)


def line_rules(code: str) -> tuple[int, list[tuple[int, int]]]:
    """Lines that count, and the rules over them of ROUNDS: the hash of what a rule derives and the
    number of its lines. Lines of signs alone and imports, which files of any project share, are passed over.

    Hashes of pairs are those of tuples of integers, which are the same in every worker."""
    hashed, common = xxhash.xxh3_64_intdigest, COMMON.match
    seq = [hashed(x) for x in map(str.strip, code.splitlines()) if len(x) > 3 and not common(x)]
    sizes = [1] * len(seq)
    lines = len(seq)
    out: list[tuple[int, int]] = []
    for level in range(1, max(ROUNDS) + 1):
        last = len(seq) - 1
        if last < 1:
            break
        pairs = [*map(hash, zip(seq, seq[1:]))]
        # a pair is replaced where it is the least among its neighbours, so no two overlap
        chosen = [i for i, h, before, after in zip(range(last), pairs, [pairs[0] + 1, *pairs], [*pairs[1:], pairs[-1]]) if h < before and h <= after]
        new: list[int] = []
        size: list[int] = []
        at = 0
        for i in chosen:
            if i < at:
                continue
            new += seq[at:i]
            size += sizes[at:i]
            new.append(pairs[i])
            size.append(sizes[i] + sizes[i + 1])
            at = i + 2
        seq, sizes = new + seq[at:], size + sizes[at:]
        if level in ROUNDS:
            replaced = {pairs[i] for i in chosen}
            out += [(h, n) for h, n in zip(seq, sizes) if h in replaced]
    return lines, out


def _has_literals(tokens: list[str]) -> bool:
    """Whether there are so many numbers, or so much in long literals, that a file may be data at all."""
    return sum(t[0].isdigit() for t in tokens) >= TOKENS or sum(len(t) for t in tokens if len(t) >= 60) >= 10 * TOKENS


def _is_data(code: str, kind: str) -> bool:
    """Hardly a word beside literals, and literals that hardly get shorter by a grammar; comments do not count."""
    pattern = COMMENT.get("html" if kind == "htm" else kind, COMMENT[""])
    code = pattern.sub(lambda m: " " if m[1] else m[0], code)
    solid = len(code) - sum(map(code.count, " \t\r\n"))
    if sum(map(len, NUMBER.findall(code))) + sum(map(len, TEXT.findall(code))) < 0.5 * solid:
        return False
    tokens = TOKEN.findall(code)
    # prose in quotes is no data
    literals = [t for t in tokens if t[0] in "\"'`0123456789" and (len(t) > 1 or t.isdigit()) and t.count(" ") * 15 <= len(t)]
    size = sum(map(len, literals))
    if not literals or size < 0.5 * solid:
        return False
    if sum(len(t) for t in tokens if t[0].isalpha() or t[0] in "_$") > DATA_WORDS * size:
        return False
    return _has_literals(literals) and bits("".join(literals)) >= DATA_BITS


def _many_digits(code: str) -> bool:
    """Whether TOKENS numbers begin in a text."""
    return (not code.isascii() or sum(map(code.count, "0123456789")) >= TOKENS) and len(DIGITS.findall(code)) >= TOKENS


def _signs(code: str, kind: str) -> tuple[bool, bool, bool, bool, list[int]]:
    """says_tool, minified, data and says_copy of one file, and the kinds of its tokens where rule reuse is judged."""
    head = HEAD.match(code)[0]
    says_tool = SAYS_TOOL.search(head) is not None
    says_copy = SAYS_COPY.search(head) is not None
    minified, data = False, False
    kinds: list[int] = []
    markup = kind in ("html", "htm")
    if markup or not code.lstrip("﻿ \t\r\n").startswith("<"):
        tokens = TOKEN.findall(code)
        if len(tokens) >= TOKENS:
            if len(_KINDS) > KINDS:
                _KINDS.clear()
            kinds = [*map(_KINDS.__getitem__, tokens)]
        if kind not in CONFIGURATION and (_many_digits(code) or max(map(len, tokens), default=0) >= 60):
            data = _is_data(code, kind)
        if kind in MINIFIABLE:
            bare = TEXT.sub('""', code)  # a long text in a line makes no minified file
            long = sum(len(x) for x in bare.splitlines() if len(x) > 300)
            blanks = sum(map(bare.count, " \t\n"))
            minified = long > 0.6 * len(bare) and blanks < 0.12 * len(bare)
    return says_tool, minified, data, says_copy, kinds


def features_of(files: list[tuple[str, str]]) -> list[tuple[bool, bool, bool, bool, float, bool, int, list[tuple[int, int]]]]:
    """says_tool, minified, data, says_copy, ratio, reused, n_lines and rules of each file (code, path)."""
    suffixes = [path.rsplit(".", 1)[-1].lower() for _, path in files]
    signs, ratios = [], [1.0] * len(files)
    waiting: dict[int, list[int]] = {}
    held = 0
    for i, ((code, _), kind) in enumerate(zip(files, suffixes)):
        *own, kinds = _signs(code, kind)
        signs.append(own)
        if kinds:
            waiting[i] = kinds
            held += len(kinds)
        if held >= TOGETHER or i + 1 == len(files):
            for j, (rules, start) in zip(waiting, grammar_sizes([*waiting.values()])):
                ratios[j] = (2 * rules + start) / len(waiting[j])
            waiting, held = {}, 0
    return [(*own, ratio, ratio < REUSE.get(kind, REUSE_OTHER), *line_rules(code)) for own, ratio, kind, (code, _) in zip(signs, ratios, suffixes, files)]


def features(code: str, path: str) -> tuple[bool, bool, bool, bool, float, bool, int, list[tuple[int, int]]]:
    """The same of one file."""
    return features_of([(code, path)])[0]


def judge_files(files: DataFrame) -> DataFrame:
    """Features of every row (FEATURES); redelivered files come as often as they were delivered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            delivered = list(zip(*(x.to_pylist() for x in batch.columns), strict=True))
            written = [code is not None and code.strip("﻿ \t\r\n\x0b\x0c\xa0") != "" for *_, code in delivered]
            found = iter(features_of([(code, path or "") for (*_, path, code), there in zip(delivered, written) if there]))
            for (f, project, path, _), there in zip(delivered, written):
                if there:
                    *signs, rules = next(found)
                    rows.append((f, project, path, *signs, [h for h, _ in rules], [n for _, n in rules]))
                else:
                    rows.append((f, project, path, False, False, False, False, 1.0, False, 0, [], []))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

    chosen = files.select(F.col("file_id").cast("bigint"), "project_id", "file_path", F.col("code").cast("string"))
    return chosen.mapInArrow(run, FEATURES)


def shared_rules(judged: DataFrame) -> DataFrame:
    """Rules over lines that occur in more than one project."""
    each = judged.where("project_id is not null").select(F.xxhash64("project_id").alias("project"), F.explode("rules").alias("rule"))
    return each.groupBy("rule").agg(F.min("project").alias("a"), F.max("project").alias("b")).where("a < b").select("rule")


def verdicts(judged: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """file_id, the signs, the share of lines below shared rules, and ``reason`` (null for hand-written files).

    ``wanted`` (file_id) restricts the verdicts; the shared rules are those of all files.
    """
    judged = kept(judged)
    chosen = judged if wanted is None else judged.join(wanted.distinct(), "file_id", "left_semi")
    # the rows of a rule are cut by file, so that a rule of very many files is not one task
    own = chosen.select("file_id", F.explode(F.arrays_zip("rules", "sizes")).alias("r")).select("file_id", F.col("r.rules").alias("rule"), F.col("r.sizes").alias("n"), F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).alias("salt"))
    known = shared_rules(judged).select("rule", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    hits = own.join(known, ["rule", "salt"], "left_semi").groupBy("file_id").agg(F.sum("n").alias("hits"))
    names = ["project_id", "file_path", "says_tool", "minified", "data", "says_copy", "ratio", "reused", "n_lines"]
    weight = F.aggregate("sizes", F.lit(0), lambda a, n: a + n)
    # a file that was delivered twice has its rules twice, on both sides of the share
    signs = chosen.groupBy("file_id").agg(*[F.first(c).alias(c) for c in names], F.sum(weight).alias("weight"))
    path = F.concat(F.lit("/"), F.regexp_replace("file_path", r"\\", "/"))
    share = F.coalesce(F.col("hits") / F.greatest(F.col("weight"), F.lit(1)), F.lit(0.0))
    tool_path = F.coalesce(path.rlike(TOOL_PATH.pattern), F.lit(False))
    tool = F.col("reused") | F.col("says_tool") | tool_path & (F.col("n_lines") > 0)
    reason = F.when(F.col("data"), "data").when(F.col("minified"), "minified").when(share >= SHARED, "vendored").when(tool, "generated")
    return signs.join(hits, "file_id", "left").select(
        "file_id", *names, path.rlike(COPY_PATH.pattern).alias("copy_path"), tool_path.alias("tool_path"), share.alias("share"), reason.alias("reason")
    )


def clean_path(path: Column) -> Column:
    """One spelling of a path: no outer blanks, no leading ``./``, single forward slashes."""
    even = F.regexp_replace(F.regexp_replace(path, r"^[\s﻿ ]+|[\s﻿ ]+$", ""), r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(even, r"^(?:\./)+", ""), r"/+$", "")


def asked(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests and the files that they name and do not skip: request_id, file_id."""
    skip = F.transform(
        F.filter(F.coalesce("skip_types", F.array().cast("array<string>")), lambda t: t.isNotNull()),
        lambda t: F.regexp_replace(F.lower(F.regexp_replace(t, r"^\s+|\s+$", "")), r"^\.", ""),
    )
    named = (
        requests.select("request_id", "project_id", skip.alias("skip"), F.explode("file_paths").alias("path"))
        .select("request_id", "project_id", "skip", clean_path(F.col("path")).alias("path"))
        .where("path is not null and path <> ''")
    )
    known = files.where("project_id is not null").select("file_id", "project_id", clean_path(F.col("file_path")).alias("path"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return (
        named.withColumn("suffix", suffix)
        .where(~F.array_contains("skip", F.col("suffix")) | (F.col("suffix") == ""))
        .join(known, ["project_id", "path"])
        .select("request_id", "file_id")
        .distinct()
    )


def found(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested files that are not hand-written: request_id, file_id, reason."""
    pairs = kept(asked(requests, files))
    judged = verdicts(judge_files(files), pairs.select("file_id")).where("reason is not null").select("file_id", "reason")
    return pairs.join(judged, "file_id")
