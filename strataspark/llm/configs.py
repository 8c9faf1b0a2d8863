"""Configuration formats as key paths with offsets (problem 4).

Each reader goes through a text once and gives its scalar values, in order: the keys that lead to
the value from the outside in (list elements by their number), and where the value begins and ends,
without quotes. The offsets are code points of the text as it is; :func:`byte_span` turns a span
into one of UTF-8 bytes. Readers never fail: what does not fit the format is passed over, and the
values before and behind it still come out, so files that do not parse are read as well.

Formats: YAML (block and flow collections, block scalars, plain and quoted scalars over several
lines), JSON, ini and properties (sections, inline comments, continued lines), dotenv (quoted values
over several lines), and markup (attributes and element texts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Entry(NamedTuple):
    path: tuple[str, ...]
    start: int
    end: int
    quoted: bool


LINE = re.compile(r"[^\r\n]*")
END = re.compile(r"\r\n|\n|\r|\Z")
STRING = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'")


def byte_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The span of code points as one of UTF-8 bytes."""
    first = len(text[:start].encode("utf-8", "surrogatepass"))
    return first, first + len(text[start:end].encode("utf-8", "surrogatepass"))


# --- flow collections: JSON, and those inside YAML ------------------------------------------------

_FLOW = re.compile(
    r"[\s﻿]+|(?P<comment>//[^\r\n]*|/\*[\s\S]*?\*/|(?<![^\s])#[^\r\n]*)|(?P<open>[{\[])|(?P<close>[}\]])|(?P<comma>,)|(?P<colon>:)"
    r"|(?P<text>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S]|'')*')|(?P<plain>[^\s,:{}\[\]\"'](?:[^,{}\[\]\r\n:]|:(?![\s,\]}]))*)|[\s\S]"
)


_OPEN = re.compile(r"[{\[]")


def flow(text: str, at: int = 0, path: tuple[str, ...] = ()) -> tuple[list[Entry], int]:
    """The values of the collection that begins at ``at``, and where it ends."""
    out: list[Entry] = []
    stack: list[list] = []  # [kind, key or None, number]
    last: tuple[int, int, bool] | None = None  # a scalar of which it is not yet known what it is
    for m in _FLOW.finditer(text, at):
        group = m.lastgroup
        if group in ("text", "plain"):
            last = (m.start() + 1, m.end() - 1, True) if group == "text" else (m.start(), m.start() + len(m[0].rstrip()), False)
            continue
        if group == "colon":
            if last and stack and stack[-1][0] == "{":
                stack[-1][1] = text[last[0] : last[1]]
                last = None
            continue
        if group not in ("open", "close", "comma"):
            continue
        if last:
            if stack:
                out.append(Entry(path + tuple(_step(s) for s in stack), *last))
            last = None
        if group == "open":
            stack.append([m[0], None, 0])
        elif group == "comma" and stack:
            stack[-1][1] = None
            stack[-1][2] += 1
        elif group == "close":
            if stack:
                stack.pop()
            if not stack:
                return out, m.end()
    if last and stack:
        out.append(Entry(path + tuple(_step(s) for s in stack), *last))
    return out, len(text)


def _step(s: list) -> str:
    return s[1] if s[1] is not None else str(s[2])


def json_entries(text: str) -> Iterator[Entry]:
    """JSON, also with comments; several values behind each other are all read."""
    at = 0
    while True:
        m = _OPEN.search(text, at)
        if m is None:
            return
        found, at = flow(text, m.start())
        yield from found


# --- YAML -----------------------------------------------------------------------------------------

_KEY = re.compile(r"(?:(\"(?:[^\"\\\r\n]|\\[^\r\n])*\"|'(?:[^'\r\n]|'')*')|([^\s\"'\[\]{}#&*!|>%@`,](?:[^\r\n:]|:(?![ \t\r\n]|\Z))*?))[ \t]*:(?=[ \t]|[\r\n]|\Z)")
_DASH = re.compile(r"-(?:[ \t]+|(?=[\r\n]|\Z))")
_PROPERTY = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)+")
_BLOCK = re.compile(r"[|>][-+0-9]*[ \t]*(?:#[^\r\n]*)?(?=[\r\n]|\Z)")
_PLAIN_END = re.compile(r"[ \t]+#")


def yaml_entries(text: str) -> Iterator[Entry]:
    """YAML: nesting by indentation, with list elements, flow collections and block scalars."""
    stack: list[list] = []  # [indent, key or None for a list, number of the element]
    at, size = 0, len(text)
    while at < size:
        line = LINE.match(text, at)[0]
        after = END.match(text, at + len(line)).end()
        body = line.lstrip(" \t﻿")
        if not body or body[0] == "#" or body.startswith(("---", "...")) and body[3:].strip() == "":
            if body[:3] in ("---", "..."):
                stack.clear()
            at = after
            continue
        pos = at + len(line) - len(body)
        indent = pos - at
        # a list may stand at the column of its key
        listed = _DASH.match(body) is not None
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not listed):
            stack.pop()
        end = at + len(line)
        # the marks of list elements, each of which opens a level of its own
        while (m := _DASH.match(text, pos)) and m.start() < end:
            column = pos - at
            if stack and stack[-1][0] == column and stack[-1][1] is None:
                stack[-1][2] += 1
            else:
                stack.append([column, None, 0])
            pos = m.end()
        if pos >= end:
            at = after
            continue
        m = _KEY.match(text, pos, end)
        keyed = m is not None
        if keyed:
            key = m[1][1:-1] if m[1] else m[2]
            column = pos - at
            while stack and stack[-1][1] is not None and stack[-1][0] >= column:
                stack.pop()
            stack.append([column, key.strip(), 0])
            pos = m.end()
            while pos < end and text[pos] in " \t":
                pos += 1
        if m := _PROPERTY.match(text, pos, end):
            pos = m.end()
        if pos >= end or text[pos] == "#":
            at = after
            continue
        path = tuple(s[1] if s[1] is not None else str(s[2]) for s in stack)
        c = text[pos]
        at = after
        if c in "{[":
            found, stop = flow(text, pos, path)
            yield from found
            at = END.match(text, stop + len(LINE.match(text, stop)[0])).end()
        elif m := _BLOCK.match(text, pos, end):
            start, stop, at = _block(text, after, stack[-1][0] if stack else -1)
            if stop > start:
                yield Entry(path, start, stop, False)
        elif c in "\"'" and (m := STRING.match(text, pos)):
            yield Entry(path, m.start() + 1, m.end() - 1, True)
            at = END.match(text, m.end() + len(LINE.match(text, m.end())[0])).end()
        else:
            cut = _PLAIN_END.search(text, pos, end)
            stop = cut.start() if cut else end
            stop = pos + len(text[pos:stop].rstrip())
            if keyed and cut is None:  # a plain scalar goes on over lines that are indented more
                stop, at = _folded(text, stop, after, stack[-1][0])
            if stop > pos:
                yield Entry(path, pos, stop, False)


def _block(text: str, at: int, parent: int) -> tuple[int, int, int]:
    """First and last sign of a block scalar, and where the line behind it begins."""
    start = stop = at
    first = True
    while at < len(text):
        line = LINE.match(text, at)[0]
        body = line.lstrip(" \t")
        if body and len(line) - len(body) <= parent:
            break
        if body:
            if first:
                start, first = at + len(line) - len(body), False
            stop = at + len(line.rstrip())
        at = END.match(text, at + len(line)).end()
    return start, stop, at


def _folded(text: str, stop: int, at: int, parent: int) -> tuple[int, int]:
    while at < len(text):
        line = LINE.match(text, at)[0]
        body = line.lstrip(" \t")
        if not body or len(line) - len(body) <= parent or body[0] in "#-" or _KEY.match(body):
            break
        stop = at + len(line.rstrip())
        at = END.match(text, at + len(line)).end()
    return stop, at


# --- ini, properties, dotenv ------------------------------------------------------------------------

_SECTION = re.compile(r"\[[ \t]*([^\]\r\n]+?)[ \t]*\]")
_SETTING = re.compile(r"(?:export[ \t]+|set[ \t]+)?(\"[^\"\r\n]+\"|'[^'\r\n]+'|[^\s=:#;\[\"'][^=:\r\n]*?)[ \t]*(=|:(?!//))[ \t]*")
_INLINE = re.compile(r"[ \t]+[#;]")


def ini_entries(text: str) -> Iterator[Entry]:
    """ini, properties and dotenv lines. A quoted value may go on over lines, and so may a plain one
    whose line ends in a backslash."""
    section: tuple[str, ...] = ()
    at, size = 0, len(text)
    while at < size:
        line = LINE.match(text, at)[0]
        end = at + len(line)
        after = END.match(text, end).end()
        pos = at + len(line) - len(line.lstrip(" \t﻿"))
        at = after
        if pos == end or text[pos] in "#;!":
            continue
        if m := _SECTION.match(text, pos, end):
            section = tuple(x.strip() for x in re.split(r"[.:/]", m[1].strip("\"' ")) if x.strip())
            continue
        m = _SETTING.match(text, pos, end)
        if m is None:
            continue
        key, pos = m[1].strip("\"'"), m.end()
        path = section + tuple(x for x in re.split(r"\.", key) if x)
        if pos < end and text[pos] in "\"'" and (q := STRING.match(text, pos)) and q.end() > pos + 1:
            yield Entry(path, pos + 1, q.end() - 1, True)
            at = END.match(text, q.end() + len(LINE.match(text, q.end())[0])).end()
            continue
        cut = _INLINE.search(text, pos, end)
        stop = cut.start() if cut else end
        while cut is None and text[pos:stop].endswith("\\") and at < size:
            more = LINE.match(text, at)[0]
            stop = at + len(more)
            at = END.match(text, stop).end()
        stop = pos + len(text[pos:stop].rstrip())
        if stop > pos:
            yield Entry(path, pos, stop, False)


# --- markup -----------------------------------------------------------------------------------------

_TAG = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<(/?)([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_@:][\w:.-]*)[ \t\r\n]*=[ \t\r\n]*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>=`]+))")
#: Elements that have no content, or whose content is no text of the document.
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))


def markup_entries(text: str) -> Iterator[Entry]:
    """Attributes and texts of elements; the path is that of the elements around them."""
    stack: list[str] = []
    end = 0
    for m in _TAG.finditer(text):
        if stack and stack[-1] not in _RAW:
            s, e = end, m.start()
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                yield Entry(tuple(stack), s, e, False)
        end = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in stack:
                while stack.pop() != name:
                    pass
            continue
        for a in _ATTRIBUTE.finditer(text, m.start(3), m.end(3)):
            group = next(g for g in (2, 3, 4) if a[g] is not None)
            # the place of the tag tells attributes of like elements apart
            yield Entry((*stack, name, str(m.start()), a[1]), a.start(group), a.end(group), True)
        if name not in _EMPTY and not m[3].endswith("/"):
            stack.append(name)


READERS = {"yaml": yaml_entries, "json": json_entries, "ini": ini_entries, "dotenv": ini_entries, "html": markup_entries}
