"""Credentials embedded in source code (problem 4).

Configuration formats and markup are parsed into key paths with offsets (``configs``); in code,
assignments, object members, call arguments and headers give the key of a literal. A key is tested
by its words, and with its parents where it says nothing by itself (``api: {key: ...}``,
``auth: {value: ...}``, ``name: DB_PASSWORD`` beside ``value: ...``): ``refreshToken`` opens
something, ``tokenBudget`` does not. A value is tested by its shape: placeholders, names, templates
and sentences open nothing. Some values give themselves away under any key: private keys, signed
tokens, addresses with a password, connection strings, and issued keys, which are told by their
structure (a short prefix before a long run of letters and digits that change as in a random text),
not by a list of issuers. Spans are offsets into the text as it is, of code points and of bytes;
masking splices the bytes of the spans and touches nothing else.

A text written in pieces (``"ab" + "cd"``) is read as one: the joints are taken out before the
search, and every span is translated back.

Defined cases
    * Null, empty and blank code have no credentials. Files that do not parse are read as well.
    * Redelivered files give their spans once (``found``); ``redact`` keeps every row it gets.
    * Overlapping finds are one span, that of the find which starts first and is longest.
    * Positions are code points; a mask has the length of what it covers and keeps line ends. It is
      made of the letter x, which no format reads as a sign.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import configs
from .batches import sliced
from .parsing import language_of


# Words that end the name of something that opens; "key" only after one of its own words.
OPENS = {"password", "passwd", "pass", "pwd", "pw", "passphrase", "passcode", "secret", "token", "credential", "credentials", "authorization", "auth", "apikey", "bearer", "pat"}
KEY_OF = {"api", "access", "signing", "encryption", "service", "secret", "private", "auth", "master", "session", "storage", "client", "app", "account", "shared", "ssh", "tls", "ssl", "webhook", "deploy", "license", "admin", "server", "jwt", "hmac", "crypto", "decryption", "root", "user", "subscription"}

_NAME = r"[A-Za-z_$][\w$.-]*"
SENSITIVE = re.compile(r"(?:(?<!com)pass|pwd|secret|token(?!_?bucket)|key|cred|auth|bearer)[\w$.-]*")
JOINT = re.compile(r"""(?<!["'`\\])(["'`])\)?[ \t]*(?:[+.&][ \t]*(?:\r?\n|\r)?[ \t]*|\\?(?:\r?\n|\r)[ \t]*(?:[+.&][ \t]*)?|[ \t])[rbfuRBFU]?\1(?!["'`])""")

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY( BLOCK)?-----([\s\S]*?)-----END \1PRIVATE KEY( BLOCK)?-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{24,}")
URL_USER = re.compile(r"(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"'`<>?#]*:([^\s/\"'`<>]+?)@(?=[\w\[{$%<])")
URL_QUERY = re.compile(r"(?i)[?&;](?:access[-_]?key|api[-_]?key|access[-_]?token|auth[-_]?token|token|secret|client[-_]?secret|password|passwd|pwd|sig|signature|auth|key)=([^&\s\"'`<>#;]+)")
CONNECTION = re.compile(r"(?i)(?<=[;\"'`])(?:password|pwd)=([^;\"'`\s<>()]+)(?=[;\"'`\s])")
JWT = re.compile(r"(?<![\w.-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{10,}")
#: Runs that may be issued keys: a prefix and what follows it, or letters and digits without one.
RUN = re.compile(r"(?<![\w./+-])(?<!;base64,)[A-Za-z][A-Za-z0-9]{1,11}(?:[_.:-][\w.:-]{13,}|[A-Z0-9]{8,})(?![\w/+=])")
RUN_PREFIX = re.compile(r"(?:[A-Za-z][A-Za-z0-9]{0,11}[_.:-](?:(?:live|test|prod|dev|pat|key)_)?)?")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
CONSONANTS = re.compile(r"[B-DF-HJ-NP-TV-XZ]{5,}")
SCHEME = re.compile(r"(?i)(?<=[\"'`:= ])(?:(bearer|basic)[ \t]+|(?<=[\"'`])(token|apikey|key)[ \t]+)([A-Za-z0-9+/_.=:~-]{8,})")
USER_OPTION = re.compile(r"(?<![\w-])(?:-u|--user)(?:[ \t]+|=)[\"']?[\w.@-]+:([^\s\"'`]+)")
#: The password of an account given as options of a command: ``-u bob -psecret``.
SHORT_OPTION = re.compile(r"(?<![\w-])-u[ \t]*[\w.@-]+(?:[ \t]+-(?!p)[\w-]+(?:[= \t]+[\w./:-]+)?)*[ \t]+-p([^\s\"'`]{4,})")
OPTION_VALUE = re.compile(r"(?:[ \t]+|=)([^\s\"'`<>|;&-][^\s\"'`<>|;&]*)")
WORD = re.compile(r"[A-Za-z][\w-]*\Z")
NAMED_VALUE = re.compile(r"""(?i)\b(?:name|id|key|property)\s*=\s*(["'])([\w.-]+)\1[^<>]*?\b(?:content|value)\s*=\s*(["'])([^"'<>\r\n]*)\3""")
ELEMENT = re.compile(r"<([A-Za-z][\w.-]*)>([^<>\s]{4,})</\1>")
AFTER = re.compile(
    r"""["'`]?[\])]*[ \t]*(?::[ \t]*[A-Za-z_&*][\w<>\[\], |.:*&]*?[ \t]*(?==))?(?:,[ \t]*(?:default|value|fallback)[ \t]*[=:]|=>|:=|\|\||\?\?|\bor\b|->|[=:,(])[ \t]*(?:\(?[ \t]*(?:\r?\n[ \t]*)?)(?:(?:std::)?(?:w?string|String|str|SecretStr|Secret)[ \t]*\([ \t]*)?[rbfuRBFU]?(["'`]|\"\"\"|''')"""
)
COMMENT_START = re.compile(r"(?:#|//|/\*|<!--)[^\r\n\"'`=:]*\Z|^[ \t]*(?:\*|;|--)[^\r\n\"'`=:]*\Z")
COMMENT_VALUE = re.compile(r"[ \t]*[:=][ \t]*([^\s\"'`<>][^\s\"'`<>]*)")
LOWER = {i: i + 32 for i in range(65, 91)}

PLACEHOLDER = re.compile(
    r"(?i)^(?:change[-_ ]?(?:me|it|this)|todo|fixme|tbd|none|null|nil|undefined|n/?a|true|false|empty|unset|default|x{3,}|\*+|\.{2,}|-+|_+|0+|redacted|\[.*\]|<.*>?|\{.*\}?|\$.*|%.*|#\{.*|@.*@|\{\{.*"
    r"|your.*|my[-_].*|.*[-_ ](?:here|goes[-_]here|placeholder)|insert[-_ ].*|replace[-_ ]?.*|enter[-_ ].*|example.*|dummy.*|sample.*|fake.*|test|placeholder.*|secret|password|passwd|token|key|pass|hidden|masked|removed|omitted|env:.*|vault:.*|ssm:.*|file:.*|process\.env.*|os\.environ.*|getenv.*|bearer|basic)$"
)
TEMPLATE = re.compile(r"\$\{|\{\{|%\(|%[sdv](?![A-Za-z0-9])|#\{|<%|\$\(|\{[A-Za-z_0-9.]*\}")
WORDS_ONLY = re.compile(r"[a-z]+(?:[_./ :-][a-z]+)*\Z|[A-Z]+(?:[_-][A-Z]+)+\Z|[A-Z][a-z]*(?:-[A-Z][a-z]*)+\Z|[a-z]+(?:[A-Z][a-z]+)+\Z|[A-Z][a-z]+\Z|(?:[A-Z][a-z]+){2,}\Z")
#: Words of names whose values are long and random and open nothing.
DIGEST_NAME = {"hash", "sha", "digest", "checksum", "integrity", "fingerprint", "id", "ids", "uuid", "guid", "public", "etag", "commit", "revision", "certificate", "cert"}
DIGEST = re.compile(r"(?i)(?:sha\d*|md5|blake\w*|crc\w*|etag|urn|uuid|id|ssh|commit|rev)[-_.:]")
#: Names of passwords, whose values may be a plain word, or several; and words that such a value is not.
PASSWORDS = {"password", "passwd", "pass", "pwd", "pw", "passphrase", "passcode", "secret"}
KIND_WORDS = frozenset("string text number boolean object any unknown required optional hidden input password basic bearer include omit true false null none plain encrypted invalid missing wrong new old".split())
#: Keys that say nothing of their value; their parent or the name beside them does.
GENERIC = frozenset(("value", "val", "default", "data", "content", "text", "raw", "plain", "literal", "string", "current"))
NAMING = frozenset(("name", "key", "id", "property", "header", "field"))
SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def opens(name: str) -> bool:
    """Whether a thing of this name opens something."""
    words = [w.lower() for w in SPLIT.findall(name) if not w.isdigit()]
    if not words:
        return False
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if before in ("public", "hash") or last == "key" and before == "public":
        return False
    return last in OPENS or last == "key" and before in KEY_OF or last == "keys" and before in ("api", "access")


def path_name(path: tuple[str, ...], beside: dict[tuple[str, ...], str]) -> str:
    """The name that a value of a configuration goes by, out of its key path and the names beside it."""
    at = len(path)
    listed = False
    while at and path[at - 1].isdigit():
        at, listed = at - 1, True
    if not at:
        return ""
    name = path[at - 1]
    if name.lower() in GENERIC:
        if path[: at - 1] in beside:
            return beside[path[: at - 1]]
        return path_name(path[: at - 1], {}) if at > 1 else name
    words = [w.lower() for w in SPLIT.findall(name)]
    if words in (["key"], ["keys"]) and at > 1:
        above = path_name(path[: at - 1], {})
        return f"{above}_{name}" if above else name
    if listed and len(words) and words[-1].endswith("s") and words[-1][:-1] in OPENS and not words[:-1]:
        return name[:-1]
    return name


def secret(value: str, password: bool = False) -> bool:
    """Whether a value has the shape of something that opens, under a name that says so; ``password``
    for names of passwords, which may be plain words."""
    if len(value) < 5 or PLACEHOLDER.match(value) or TEMPLATE.search(value):
        return False
    if "://" in value or "BEGIN " in value or value.startswith(("data:", "sha256-", "sha384-", "sha512-")):
        return False
    if any(c.isspace() for c in value):
        # several words: a pass phrase has a digit or a sign in it and is no sentence
        return password and "\n" not in value and value[-1] not in ".!?:," and any(c.isdigit() for c in value)
    if WORDS_ONLY.match(value):
        words = {w.lower() for w in SPLIT.findall(value)}
        return password and not words & (OPENS | KIND_WORDS) and "_" not in value and not re.search(r"[a-z][A-Z]|[./:]", value)
    if value.isdigit() and len(value) < 6:
        return False
    kinds = any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(c.islower() for c in value) + any(not c.isalnum() for c in value)
    return kinds >= 2 or len(value) >= 12


def _kind(c: str) -> int:
    return 1 if c.islower() else 2 if c.isupper() else 3


def issued(value: str) -> bool:
    """Whether a run has the structure of an issued key: behind a prefix, at least 14 letters and digits
    that change between small, capital and digit as often as random ones do."""
    if UUID.search(value) or DIGEST.match(value):
        return False
    prefix = RUN_PREFIX.match(value)[0]
    body = "".join(c for c in value[len(prefix) :] if c.isalnum() and c.isascii())
    if len(body) < 14:
        return False
    kinds = [*map(_kind, body)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / (len(body) - 1)
    digits = kinds.count(3)
    if not prefix:  # capitals and digits in one run: no word of a language has so many consonants in a row
        return digits > 0 and 1 not in kinds and (digits >= 3 and changes >= 0.25 or CONSONANTS.search(body) is not None)
    if changes >= 0.42 or digits > 1 and changes >= 0.3:
        return True
    return len(body) >= 24 and min(digits, len(body) - digits) > 2 and HEX.fullmatch(body) is not None


def joined(code: str) -> tuple[str, list[int], list[int]]:
    """The code without the joints between pieces of texts; where each stretch begins there and here."""
    parts, here, there, at, size = [], [0], [0], 0, 0
    for m in JOINT.finditer(code):
        if m[0].count("\n") == 0 and not m[0].strip("\"'`").strip(" \t"):  # two texts side by side
            continue
        parts.append(code[at : m.start()])
        size += m.start() - at
        at = m.end()
        here.append(size)
        there.append(at)
    if not parts:
        return code, here, there
    parts.append(code[at:])
    return "".join(parts), here, there


def _ending(code: str, at: int, quote: str) -> int:
    """Where the text that begins at ``at`` ends."""
    n = len(code)
    step = len(quote)
    while at < n:
        c = code[at]
        if c == "\\":
            at += 2
            continue
        if code.startswith(quote, at):
            return at
        if step == 1 and quote != "`" and c in "\r\n":
            return -1
        at += 1
    return -1


def _name_before(text: str, at: int) -> str:
    """The name to which the literal that begins at ``at`` belongs, or ''."""
    i = at - 1
    while i >= 0 and text[i] in " \t\"'`:=(,[]":
        i -= 1
    end = i + 1
    while i >= 0 and (text[i].isalnum() or text[i] in "_$-"):
        i -= 1
    return text[i + 1 : end]


def configured(code: str, language: str) -> tuple[list[tuple[int, int, str, str]], set[tuple[int, int]]]:
    """Credentials under the keys of a configuration or markup text, and all spans that were tested."""
    entries = [*configs.READERS[language](code)]
    beside = {e.path[:-1]: code[e.start : e.end] for e in entries if e.path and e.path[-1].lower() in NAMING}
    hits: list[tuple[int, int, str, str]] = []
    tested = set()
    for e in entries:
        if not e.path:
            continue
        tested.add((e.start, e.end))
        name = path_name(e.path, beside)
        header = name.lower().endswith("header")
        if not header and not opens(name):
            continue
        value = code[e.start : e.end]
        if "\n" in value or "\r" in value:
            # pieces of one value on lines of their own
            if len({*map(bool, value.split())}) == 1 and all(len(line.split()) == 1 for line in value.splitlines() if line.strip()) and secret("".join(value.split())):
                hits.append((e.start, e.end, "named", ".".join(e.path)))
            continue
        _value(hits, value, e.start, name, header, ".".join(e.path))
    return hits, tested


def search(code: str, language: str | None) -> list[tuple[int, int, str, str]]:
    """Credentials of a text: start, end, kind and key or key path."""
    text, here, there = joined(code)
    low = text.lower() if text.isascii() else text.translate(LOWER)
    hits: list[tuple[int, int, str, str]] = []

    if "PRIVATE KEY" in text:
        for m in PEM.finditer(text):
            if PEM_BODY.search(m[3]):
                hits.append((m.start(), m.end(), "private key", ""))
    shapes = []
    if "://" in low:
        shapes += [("address", URL_USER)] if "@" in text else []
        shapes += [("query", URL_QUERY)] if "?" in text else []
    if "pwd" in low or "password" in low:
        shapes.append(("connection", CONNECTION))
    if "-u" in low or "--user" in low:
        shapes.append(("user option", USER_OPTION))
        shapes += [("user option", SHORT_OPTION)] if " -p" in text else []
    for kind, pattern in shapes:
        for m in pattern.finditer(text):
            v = m[1]
            if not PLACEHOLDER.match(v) and not TEMPLATE.search(v) and len(v) > 3 and not v.isdigit() and (kind in ("address", "user option") or secret(v)):
                hits.append((m.start(1), m.end(1), kind, ""))
    if "eyJ" in text:
        for m in JWT.finditer(text):
            hits.append((m.start(), m.end(), "signed token", ""))
    if "bearer " in low or "basic " in low or "token " in low or "key " in low:
        for m in SCHEME.finditer(text):
            if secret(m[3]) and (any(c.isdigit() for c in m[3]) or len(m[3]) >= 16 and not m[3].isalpha()):
                hits.append((m.start(3), m.end(3), "scheme", (m[1] or m[2]).lower()))
    if language != "html" and "<" in text:  # markup in texts of code
        if "content" in low or "value" in low:
            for m in NAMED_VALUE.finditer(text):
                if opens(m[2]) and secret(m[4]):
                    hits.append((m.start(4), m.end(4), "attribute", m[2]))
        if "</" in text:
            for m in ELEMENT.finditer(text):
                if opens(m[1]) and secret(m[2]):
                    hits.append((m.start(2), m.end(2), "element", m[1]))
    named: list[tuple[int, int, str, str]] = []
    for m in SENSITIVE.finditer(low):
        at, end = m.span()
        begin = at
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_$.-"):
            begin -= 1
        name = text[begin:end]
        if name.lower() == "key" and begin and text[begin - 1] == " ":  # "api key": the word before belongs to the name
            first = WORD.search(text, max(text.rfind("\n", 0, begin), text.rfind("\r", 0, begin)) + 1, begin - 1)
            name = f"{first[0]}_{name}" if first else name
        if not opens(name.rstrip(".-")):
            continue
        if name.startswith("-") and (v := OPTION_VALUE.match(text, end)):  # --password x
            _value(named, v[1], v.start(1), name.lstrip("-"), False, "--" + name.lstrip("-"), False)
            continue
        after = AFTER.match(text, end)
        if after is not None:
            start = after.end()
            stop = _ending(text, start, after[1])
            if stop > start:
                line = max(text.rfind("\n", 0, begin), text.rfind("\r", 0, begin)) + 1
                alias = language == "typescript" and TYPE_ALIAS.search(text, line, begin)
                _value(named, text[start:stop], start, name, False, name, bool(ASSIGNED.match(text, end)) and not alias)
            continue
        line = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
        if COMMENT_START.search(text[line:begin]) and (v := COMMENT_VALUE.match(text, end)):
            value = v[1].rstrip(",;)")
            _value(named, value[: value.find("-->")] if "-->" in value else value, v.start(1), name, False, name, False)

    hits += named
    # a run that nothing else explains
    known = sorted(h[:2] for h in hits)
    ends = [*accumulate((e for _, e in known), max)]
    for m in RUN.finditer(text):
        v = m[0].rstrip(".:-")
        i = bisect_left(known, (m.end(), 0)) - 1
        if issued(v) and (i < 0 or ends[i] <= m.start()) and not DIGEST_NAME & {w.lower() for w in SPLIT.findall(_name_before(text, m.start()))}:
            hits.append((m.start(), m.start() + len(v), "issued key", ""))
    placed = []
    for s, e, kind, key in hits:
        i, j = bisect_right(here, s) - 1, bisect_right(here, e - 1) - 1
        placed.append((s - here[i] + there[i], e - 1 - here[j] + there[j] + 1, kind, key))
    if language in configs.READERS:
        found, tested = configured(code, language)
        # what stands under a key of the format is for its reader to judge
        placed = [h for h in placed if h[2] != "named" or (h[0], h[1]) not in tested] + found
    out: list[tuple[int, int, str, str]] = []
    last = -1
    for hit in sorted(placed, key=lambda h: (h[0], -h[1], h[3] == "")):
        if hit[0] >= last:
            last = hit[1]
            out.append(hit)
    return out


_SCHEMES = re.compile(r"(?i)(?:bearer|basic|token|apikey|digest|key)[ \t]+")
#: Between a name and its value: an assignment or a member, no list of arguments.
ASSIGNED = re.compile(r"[\"'`]?[\])]*[ \t]*(?::[^=\"'`\r\n]*)?(?::?=(?!=|>)|:)[ \t\r\n(]*[rbuRBU]?[\"'`]")
TYPE_ALIAS = re.compile(r"\b(?:type|enum|interface)\s+\Z")


def _value(hits: list, value: str, start: int, name: str, header: bool = False, key: str = "", assigned: bool = True) -> None:
    """Adds the value of a sensitive name if it is one, without scheme word and outer blanks.

    The value of a header counts only behind a scheme word; a plain word only where it is assigned to
    the name of a password."""
    body = value.strip(" \t")
    start += len(value) - len(value.lstrip(" \t"))
    if len(body) > 1 and body[0] == body[-1] and body[0] in "\"'":
        body, start = body[1:-1], start + 1
    m = _SCHEMES.match(body)
    if m:
        body, start = body[m.end() :], start + m.end()
    words = [w.lower() for w in SPLIT.findall(name) if not w.isdigit()]
    password = assigned and not m and bool(words) and (words[-1] in PASSWORDS or words[-1] == "token" and len(body) >= 12 and body.isalpha() and body.islower())
    if (m or not header) and secret(body, password):
        hits.append((start, start + len(body), "named", key or name))


def mask(code: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The code with the bytes of every span replaced, and otherwise as it was."""
    data, out, at, chars, size = code.encode("utf-8", "surrogatepass"), [], 0, 0, 0
    for s, e, _, _ in spans:
        first = size + len(code[chars:s].encode("utf-8", "surrogatepass"))
        covered = code[s:e].encode("utf-8", "surrogatepass")
        out += [data[at:first], re.sub(r"[^\r\n]", "x", code[s:e]).encode()]
        at = size = first + len(covered)
        chars = e
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def places(code: str, language: str | None) -> list[tuple[str, str, int, int, int, int]]:
    """Key path, kind, span of code points and span of bytes of every credential of a text."""
    out, chars, size = [], 0, 0
    for s, e, kind, key in search(code, language):
        first = size + len(code[chars:s].encode("utf-8", "surrogatepass"))
        size = first + len(code[s:e].encode("utf-8", "surrogatepass"))
        chars = e
        out.append((key, kind, s, e, first, size))
    return out


PLACES = "file_id bigint, key_path string, kind string, start_pos bigint, end_pos bigint, start_byte bigint, end_byte bigint"
PLACE_FIELDS = pa.schema(
    [("key_path", pa.string()), ("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())]
)
FIELDS = pa.schema([("file_id", pa.int64()), *PLACE_FIELDS])


def _chosen(files: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return files.select(F.col("file_id").cast("bigint"), language_of(F.col("language"), F.col("file_path"), aliases).alias("language"), F.col("code").cast("string"))


def find(files: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Every credential occurrence of every file (PLACES), redelivered files once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(f, *hit) for f, g, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) if c for hit in places(c, g)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)

    return _chosen(files, aliases).mapInArrow(run, PLACES).dropDuplicates(["file_id", "start_pos", "end_pos"])


def redact(files: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Every row with its code masked and what was masked: file_id, n_masked, code, report."""
    report = pa.list_(pa.struct([*PLACE_FIELDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            codes, reports = [], []
            for g, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = places(c, g) if c else []
                reports.append([dict(zip(PLACE_FIELDS.names, p, strict=True)) for p in found])
                codes.append(mask(c, [(s, e, kind, key) for key, kind, s, e, _, _ in found]) if found else c)
            yield pa.record_batch(
                [batch.column(0), pa.array([*map(len, reports)], pa.int32()), pa.array(codes, pa.string()), pa.array(reports, report)], names=["file_id", "n_masked", "code", "report"]
            )

    item = PLACES.replace("file_id bigint, ", "").replace(" string", ": string").replace(" bigint", ": bigint")
    return _chosen(files, aliases).mapInArrow(run, f"file_id bigint, n_masked int, code string, report array<struct<{item}>>")
