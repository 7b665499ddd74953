"""Line scanner: facts from source text by patterns, for files that the parser cannot or must not read.

Symbols come from a table of rules, tried on every line of the comment-stripped text; of the rules in one slot only the
first that fits a line counts. Function bodies are found from headers and braces alone, as a list of lines at which the
current function changes. References and calls then are one pass over the words of each line. Quirks that are visible in
results are kept: a tag pattern that backs off into a shorter name, a column-0 ``return f(x);`` as prototype, identifiers
inside literals as references, and no function symbol for a body whose brace is on the next line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

from ..functions.keywords import SCANNER
from ..functions.lexical import strip_comments
from .facts import Facts

# The line patterns.
DEFINE = re.compile(r"^\s*#\s*define\s+([A-Za-z_]\w*)", re.A)
TYPEDEF = re.compile(r"^\s*typedef\b.*?\b([A-Za-z_]\w*)\s*;\s*$", re.A)
TAG = re.compile(r"\b(struct|union|enum)\s+([A-Za-z_]\w*)(?!\s*\*|\s+[A-Za-z_])", re.A)
FUNC_DEF = re.compile(r"^[A-Za-z_][\w\s*&]*?\b([A-Za-z_]\w*)\s*\([^()]*\)\s*\{\s*$", re.A)
FUNC_PROTO = re.compile(r"^[A-Za-z_][\w\s*&]*?\b([A-Za-z_]\w*)\s*\([^()]*\)\s*;\s*$", re.A)
FUNC_PTR = re.compile(r"^(?!typedef\b)[A-Za-z_][\w\s*&]*?\(\s*\*+\s*([A-Za-z_]\w*)\s*\)\s*\(", re.A)
LABEL = re.compile(r"^\s*([A-Za-z_]\w*)\s*:(?![:=])", re.A)

_WORD = re.compile(r"(?<!\w)([A-Za-z_]\w*)(?=(\s*\()?)", re.A)
_EXTERN = re.compile(r"\bextern\b")


def _first(line: str, m: re.Match) -> int:
    return line.index(m[m.lastindex])


def _last(line: str, m: re.Match) -> int:
    return line.rindex(m[m.lastindex])


def _within(line: str, m: re.Match) -> int:
    return line.index(m[m.lastindex], m.start())


def _always(line: str) -> bool:
    return True


class Rule(NamedTuple):
    slot: str
    kind: str  # empty: the keyword that the pattern found
    pattern: re.Pattern
    column: Callable[[str, re.Match], int]
    definition: Callable[[str], bool] = _always
    any_word: bool = False  # keywords may be names, too


RULES = (
    Rule("macro", "macro", DEFINE, _first, any_word=True),
    Rule("typedef", "typedef", TYPEDEF, _last),
    Rule("tag", "", TAG, _within, any_word=True),
    Rule("function", "function", FUNC_DEF, _first),
    Rule("function", "global_variable", FUNC_PTR, _first, lambda line: not _EXTERN.search(line)),
    Rule("function", "prototype", FUNC_PROTO, _first, lambda line: False),
    Rule("label", "label", LABEL, _first),
)


def symbols_of(line: str) -> list[tuple[str, str, int, bool]]:
    """(name, kind, column, is a definition) of the symbols that the rules see in a line."""
    found, taken = [], set()
    for rule in RULES:
        for m in rule.pattern.finditer(line) if rule.slot not in taken else ():
            name = m[m.lastindex]
            if rule.any_word or name not in SCANNER:
                found.append((name, rule.kind or m[1], rule.column(line, m), rule.definition(line)))
        if found and found[-1][1] in ("function", "global_variable"):
            taken.add("function")
    return found


class Bodies:
    """The function that each line belongs to, as the lines at which it changes."""

    def __init__(self) -> None:
        self.depth, self.lines, self.names = 0, [-1], [None]

    def header(self, line: int, name: str) -> None:
        if self.depth == 0:
            self._change(line, name)

    def braces(self, line: int, text: str) -> None:
        """The line's braces; whatever ends at depth 0 ends after the line."""
        lowest = None
        for b in re.findall(r"[{}]", text):
            self.depth = self.depth + 1 if b == "{" else max(0, self.depth - 1)
            if b == "}":
                lowest = self.depth if lowest is None else min(lowest, self.depth)
        if lowest == 0:
            self._change(line + 1, None)

    def _change(self, line: int, name: str | None) -> None:
        self.lines.append(line)
        self.names.append(name)

    def at(self, line: int) -> str | None:
        return self.names[bisect_right(self.lines, line) - 1]


def grep_scan(text: str) -> Facts:
    """Symbols, references and calls of a source text; locals and aliases stay empty."""
    out = Facts(source="grep")
    lines = strip_comments(text).split("\n")
    bodies = Bodies()
    for ln, line in enumerate(lines):
        if line and not line.isspace():
            for name, kind, col, definition in symbols_of(line):
                out.symbol(name, kind, ln, col, definition=definition)
                if kind == "function":
                    bodies.header(ln, name)
            if "{" in line or "}" in line:
                bodies.braces(ln, line)
    for ln, line in enumerate(lines):
        func, end = bodies.at(ln), 0
        for m in _WORD.finditer(line):
            between = line[end : m.start()].rstrip()
            end = m.end()
            if m[1] not in SCANNER:
                member = between.endswith("->") or (between.endswith(".") and not between.endswith(".."))
                out.ref(m[1], ln, m.start(), func=func, role="field" if member else "")
                if m[2]:
                    out.call(func, m[1], ln, m.start())
    return out
