"""JSON payloads of any depth as Python values, and back."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()


def loads(text: str) -> object:
    """The value of a JSON text. Nesting deeper than Python's own reader allows is read without recursion.

    Raises ValueError where the text is no JSON.
    """
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def dumps(value: object, sort_keys: bool = False) -> str:
    """Compact JSON text of a value of any depth."""
    try:
        return json.dumps(value, sort_keys=sort_keys, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return _written(value, sort_keys)


def _key(text: str, at: int) -> tuple[str, int]:
    """The key of an object that begins at ``at``, and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError("key expected")
    key, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("colon expected")
    return key, _SPACE.match(text, at + 1).end()


def _deep(text: str) -> object:
    skip, at = _SPACE.match, _SPACE.match(text).end()
    boxes: list[dict | list] = []
    keys: list[str] = []
    while True:
        c = text[at : at + 1]
        value: object
        if c == "{" or c == "[":
            made: dict | list = {} if c == "{" else []
            at = skip(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                boxes.append(made)
                if c == "{":
                    key, at = _key(text, at)
                    keys.append(key)
                continue
            value, at = made, at + 1
        else:
            value, at = _DECODER.raw_decode(text, at)
        while boxes:
            box = boxes[-1]
            if isinstance(box, dict):
                box[keys[-1]] = value
            else:
                box.append(value)
            at = skip(text, at).end()
            c = text[at : at + 1]
            if c == ",":
                at = skip(text, at + 1).end()
                if isinstance(box, dict):
                    keys[-1], at = _key(text, at)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("end of a container expected")
            if isinstance(box, dict):
                keys.pop()
            value, at = boxes.pop(), at + 1
        else:
            if skip(text, at).end() != len(text):
                raise ValueError("more than one value")
            return value


class _Sign(str):
    """A piece of text that is written as it is."""


def _written(value: object, sort_keys: bool) -> str:
    out: list[str] = []
    todo: list[object] = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Sign):
            out.append(x)
        elif isinstance(x, dict):
            parts: list[object] = [_Sign("{")]
            for i, (k, v) in enumerate(sorted(x.items()) if sort_keys else x.items()):
                parts += [_Sign(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"), v]
            todo += [*parts, _Sign("}")][::-1]
        elif isinstance(x, list):
            parts = [_Sign("[")]
            for i, v in enumerate(x):
                parts += [_Sign(","), v] if i else [v]
            todo += [*parts, _Sign("]")][::-1]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
