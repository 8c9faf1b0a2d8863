"""Parsing expression grammars over token kinds, with a memo that outlives the file.

A text is cut into tokens by one pattern, and each token becomes one character: its kind. Grammars
are written over kinds: ordered choice, possessive repetition, predicates. What stands between
brackets is a nonterminal of its own: the innermost pairs are parsed first, by every rule that their
kind of bracket may hold, and are put in their parent's place as one character that names the rules
that consumed all of it. This is packrat parsing with the memo keyed by rule and content instead of
rule and position, so equal contents, of the same file or another, are parsed once per worker. The
memo is emptied at ``MEMO`` entries; that bounds memory and changes no result.

Rules are compiled to atomic patterns (no backtracking into a choice once made), which is the
semantics of the grammar, and call each other by name.
"""

from __future__ import annotations

import re

import regex

MEMO = 200_000
BRACKETS = {"P": ("(", ")"), "S": ("[", "]"), "B": ("{", "}")}
BASE = {"P": 0xE000, "S": 0xE800, "B": 0xF000}
#: Rules up to this length are written out where they are used.
INLINE = 300
_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_TOKEN = re.compile(r"\s*(<-|[PSB]:\w+|\w+|'[^']+'|[/?*+!&()]|$)")

#: Characters of kinds that no grammar names: an unknown sign, and a line end.
UNKNOWN, NEWLINE = "¿", "\n"

#: What a pair of angle brackets becomes that holds type arguments or parameters.
ANGLES = "\uF8FF"


class Grammar:
    """Rules as text, one to a line: ``name <- expression``. Names in capitals are token classes;
    quoted texts are tokens; ``P:x``, ``S:x`` and ``B:x`` are (), [] and {} that rule x consumes."""

    def __init__(self, rules: str, classes: tuple[str, ...], start: str, sequences: dict[str, tuple[tuple[str, ...], str]] | None = None, goes_on: tuple[str, ...] = (), dropped: re.Pattern | None = None) -> None:
        self.kinds: dict[str, str] = {}
        self.classes = {name: chr(0x100 + i) for i, name in enumerate(classes)}
        self.rules: dict[str, list[str]] = {}
        current = ""
        for line in rules.splitlines():
            if "<-" in line:
                current, _, line = line.partition("<-")
                current = current.strip()
                self.rules[current] = []
            if current and line.strip():
                self.rules[current] += [m for m in _TOKEN.findall(line) if m]
        self.inside: dict[str, list[str]] = {k: [] for k in BRACKETS}
        for tokens in self.rules.values():
            for t in tokens:
                if t[0] == "'" and t[1:-1] not in self.kinds:
                    self.kinds[t[1:-1]] = chr(0x200 + len(self.kinds))
                elif t[0] in "PSB" and t[1:2] == ":" and t[2:] not in self.inside[t[0]]:
                    self.inside[t[0]].append(t[2:])
        self._made: dict[str, str] = {}
        #: type arguments nest as well; where a grammar has the rule, they are put together innermost first
        #: Signs that mean nothing between brackets, such as line ends.
        self.dropped = dropped
        self._called: set[str] = set()
        self._open: set[str] = set()
        sequences = sequences or {}
        roots = {"": start} | {f"T:{r}": r for parts, _ in sequences.values() for r in parts} | {f"{k}:{r}": r for k, names in self.inside.items() for r in names}
        bodies = {k: self._rule(r) for k, r in roots.items()}
        angles = self._rule("angles") if "angles" in self.rules else ""
        for name in list(self.rules):
            self._rule(name)
        define = "(?(DEFINE)" + "".join(f"(?P<{n}>{self._made[n]})" for n in sorted(self._called)) + ")"
        self.sources = {k: define + body for k, body in bodies.items()}
        self.angle = regex.compile(define + self.kinds["<"] + angles + self.kinds[">"]) if angles else None
        #: Rules that are sequences: their content is cut into its likely parts, and each part is parsed
        #: once for each spelling. Where the parts do not add up, the content is parsed as a whole.
        # one pattern for all rules; the first sign of what it is matched against says which rule is meant
        self.select = {k: chr(0x3000 + i) for i, k in enumerate(bodies)}
        self.pattern = regex.compile(define + "(?>" + "|".join(self.select[k] + body + r"\Z" for k, body in bodies.items()) + ")")
        made = {r: _Letters(chr(97 + i), self.pattern.match, self.select[f"T:{r}"], self.alphabet(r).match) for i, r in enumerate(sorted({r for parts, _ in sequences.values() for r in parts}))}
        self.made = made
        self.sequences = {rule: ([made[r] for r in parts], re.compile(re.sub(r"\w+", lambda m: made[m[0]].letter, order) + r"\Z")) for rule, (parts, order) in sequences.items()}
        self.start_rule = _Rule(self, start, "")
        self.full = {k: [_Rule(self, r, f"{k}:{r}") for r in names] for k, names in self.inside.items()}
        body = f"{chr(BASE['B'])}-{chr(BASE['B'] + 0x7FF)}"
        semi = self.kinds.get(";", "")
        then = re.escape("".join(self.kinds[t] for t in goes_on if t in self.kinds))
        more = f"(?:[{then}][^{semi}{body}]*+[{body}])*+(?:[{then}][^{semi}{body}]*+)?" if goes_on else ""
        self.cut = re.compile(rf"[^{semi}{body}]*+(?:[{body}]{more}{semi}?|{semi}|\Z)").findall
        self.memo = _Memo(self)

    # --- compilation

    def _rule(self, name: str) -> str:
        if name not in self._made:
            self._made[name] = f"(?&{name})"  # for a rule that reaches itself
            self._open.add(name)
            tokens = [*self.rules[name], ""]
            out, at = self._choice(tokens, 0)
            assert at == len(tokens) - 1, (name, tokens[at:])
            self._made[name] = out
            self._open.discard(name)
        if name not in self._open and len(self._made[name]) <= INLINE and name not in self._called:
            return self._made[name]
        self._called.add(name)
        return f"(?&{name})"

    def _choice(self, t: list[str], at: int) -> tuple[str, int]:
        options = []
        while True:
            option, at = self._sequence(t, at)
            options.append(option)
            if t[at] != "/":
                break
            at += 1
        merged: list[str] = []
        for o in options:  # single kinds side by side become one set
            if merged and _is_set(o) and _is_set(merged[-1]):
                merged[-1] = "[" + _bare(merged[-1]) + _bare(o) + "]"
            else:
                merged.append(o)
        return (merged[0] if len(merged) == 1 else "(?>" + "|".join(merged) + ")"), at

    def _sequence(self, t: list[str], at: int) -> tuple[str, int]:
        parts = []
        while t[at] not in ("", "/", ")"):
            part, at = self._item(t, at)
            parts.append(part)
        return "".join(parts), at

    def _item(self, t: list[str], at: int) -> tuple[str, int]:
        if t[at] in "!&":
            inner, end = self._item(t, at + 1)
            return f"(?{'!' if t[at] == '!' else '='}{inner})", end
        if t[at] == "(":
            inner, at = self._choice(t, at + 1)
            assert t[at] == ")", t
            at += 1
        else:
            inner, at = self._atom(t[at]), at + 1
        if t[at] in ("?", "*", "+"):
            inner = (inner if _is_set(inner) else f"(?:{inner})") + t[at] + "+"
            at += 1
        elif not _is_set(inner):
            inner = f"(?>{inner})"
        return inner, at

    def _atom(self, t: str) -> str:
        if t[0] == "'":
            return self.kinds[t[1:-1]]
        if t[0] in "PSB" and t[1:2] == ":":
            bit, base = 1 << self.inside[t[0]].index(t[2:]), BASE[t[0]]
            n = 1 << len(self.inside[t[0]])
            runs, i = [], 0
            while i < n:
                if i & bit:
                    j = i
                    while j + 1 < n and (j + 1) & bit:
                        j += 1
                    runs.append(chr(base + i) + ("-" + chr(base + j) if j > i else ""))
                    i = j
                i += 1
            return "[" + "".join(runs) + "]"
        if t == "EOF":
            return r"\Z"
        if t == "ANYB":
            return f"[{chr(BASE['B'])}-{chr(BASE['B'] + 0x7FF)}]"
        if t == "ANYP":
            return f"[{chr(BASE['P'])}-{chr(BASE['P'] + 0x7FF)}]"
        if t == "ANYS":
            return f"[{chr(BASE['S'])}-{chr(BASE['S'] + 0x7FF)}]"
        if t == "CALLED":  # what was consumed last is a call, a body or an increment
            p, b = BASE["P"], BASE["B"]
            return f"(?<=[{chr(p)}-{chr(p + 0x7FF)}{chr(b)}-{chr(b + 0x7FF)}{self.kinds['++']}{self.kinds['--']}])"
        if t == "TARGET":  # what was consumed last is a name, a member, a pattern, or a bracketed target
            p, s, b = (f"{chr(BASE[k])}-{chr(BASE[k] + 0x7FF)}" for k in "PSB")
            names = re.escape("".join(v for k, v in self.kinds.items() if k[0].isalpha()) + self.classes["ID"] + self.classes["KEYWORD"] + self.classes["PRIVATE"])
            pattern = _bare(self._atom("B:opat"))
            no_null = re.escape(self.kinds["!"])
            return f"(?<=[{names}{s}{pattern}{no_null}{ANGLES}]|(?<![{names}{s}{p}{b}])[{p}])"
        if t == "NOCALL":  # what was consumed last is no call
            return f"(?<![{chr(BASE['P'])}-{chr(BASE['P'] + 0x7FF)}])"
        if t == "ANGLES":
            return ANGLES
        return self.classes[t] if t in self.classes else self._rule(t)

    def alphabet(self, root: str) -> re.Pattern:
        """What a rule can consume at all, sign by sign; most contents are no candidate of most rules."""
        seen, todo, signs = set(), [root], []
        while todo:
            name = todo.pop()
            if name in seen:
                continue
            seen.add(name)
            for t in self.rules[name]:
                if t in self.rules:
                    todo.append(t)
                elif t not in ("EOF", "CALLED", "NOCALL", "TARGET", "(", ")", "/", "?", "*", "+", "!", "&", ""):
                    signs.append(_bare(self._atom(t)) if t != "ANGLES" else ANGLES)
        escaped = "".join(x if "-" in x and len(x) > 1 else re.escape(x) for x in signs)
        return re.compile(f"[{escaped}]*+\\Z" if escaped else r"\Z")

    # --- parsing

    def reduce(self, kinds: str) -> str:
        """The kinds with every bracket pair replaced by what it holds; unpaired brackets stay."""
        put = self.memo.put
        while True:
            kinds, n = _INNER.subn(put, kinds)
            if not n:
                return self.typed(kinds)

    def typed(self, kinds: str) -> str:
        n = self.angle is not None
        while n:
            kinds, n = self.angle.subn(ANGLES, kinds)
        return kinds

    def parses(self, kinds: str) -> bool:
        return self.start_rule.consumes(self.reduce(kinds))


class _Letters(dict):
    """Whether a rule consumes a part, as a letter or ''."""

    def __init__(self, letter: str, match, select: str, could) -> None:
        super().__init__()
        self.letter, self.match, self.select, self.could = letter, match, select, could

    def __missing__(self, part: str) -> str:
        if len(self) >= MEMO:
            self.clear()
        self[part] = out = self.letter if self.could(part) and self.match(self.select + part) else ""
        return out


class _Rule:
    def __init__(self, grammar: Grammar, name: str, source: str) -> None:
        self.grammar, self.name = grammar, name
        self.match, self.select = grammar.pattern.match, grammar.select[source]
        self.could = grammar.alphabet(name).match
        self.parts, self.order = grammar.sequences.get(name, ((), None))

    def consumes(self, content: str) -> bool:
        """Whether the rule consumes all of the content."""
        if not self.could(content):
            return False
        if self.order is not None:
            chunks = [c for c in self.grammar.cut(content) if c]
            found = "".join([next((x for p in self.parts if (x := p[c])), "!") for c in chunks])
            if self.order.match(found):
                return True
            if len(chunks) == 1 and len(self.parts) == 1:
                return False
        return self.match(self.select + content) is not None


class _Memo(dict):
    def __init__(self, grammar: Grammar) -> None:
        super().__init__()
        self.typed = grammar.typed
        # no list has a fixed length: what parses with two like items in a row parses with any number of them
        self.alike = re.compile("(.{1,2}" + re.escape(grammar.kinds.get(",", ",")) + r")\1{2,}")
        self.dropped = grammar.dropped
        self.full = {BRACKETS[k][0]: (BASE[k], patterns) for k, patterns in grammar.full.items()}

    def put(self, m: re.Match) -> str:
        return self[m[0]]

    def __missing__(self, group: str) -> str:
        if len(self) >= MEMO:
            self.clear()
        base, patterns = self.full[group[0]]
        inner = self.typed(group[1:-1])
        if self.dropped:
            inner = self.dropped.sub("", inner)
        inner = self.alike.sub(r"\1\1", inner)
        mask = 0
        for i, p in enumerate(patterns):
            if p.consumes(inner):
                mask |= 1 << i
        self[group] = out = chr(base + mask)
        return out


def _is_set(pattern: str) -> bool:
    return len(pattern) == 1 or pattern[0] == "[" and pattern.index("]") == len(pattern) - 1


def _bare(pattern: str) -> str:
    return pattern[1:-1] if pattern[0] == "[" else pattern


class Kinds(dict):
    """Kind of each token text, found once for each spelling."""

    def __init__(self, known: dict[str, str], classify) -> None:
        super().__init__(known)
        self.known, self.classify = dict(known), classify

    def __missing__(self, token: str) -> str:
        if len(self) >= MEMO:
            self.clear()
            self.update(self.known)
        kind = self.classify(token)
        if len(token) < 200:
            self[token] = kind
        return kind


def furthest(source: str, kinds: str) -> int:
    """Length of the longest beginning of ``kinds`` that the rule could still complete."""
    pattern = _PARTIAL.get(source)
    if pattern is None:
        pattern = _PARTIAL[source] = regex.compile(source)
    low, high = 0, len(kinds)
    while low < high:
        mid = (low + high + 1) // 2
        if pattern.fullmatch(kinds[:mid], partial=True):
            low = mid
        else:
            high = mid - 1
    return low


_PARTIAL: dict = {}
