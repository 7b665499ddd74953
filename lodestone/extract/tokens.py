"""C and C++ tokens with positions, preprocessor lines apart, and bracket matching that tolerates imbalance."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|\\\r?\n)|(?P<id>[A-Za-z_$][A-Za-z0-9_$]*)"
    r"|(?P<num>\.?\d(?:[eEpP][+-]|[\w.'])*)|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<op>->\*?|\.\.\.|::|<<=|>>=|<=>|[-+*/%&|^=!<>]=|\+\+|--|&&|\|\||<<|[][(){}.,;:?~!%^&*+=|<>/-])|(?P<bad>.)", re.S)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)((?:\\\r?\n|/\*.*?\*/|[^\n])*)", re.S)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    pos: int
    line: int
    col: int

    @property
    def end(self) -> int:
        return self.pos + len(self.text)


@dataclass(slots=True)
class Directive:
    word: str
    rest: str
    pos: int  # of the rest
    line: int
    col: int


def tokenize(text: str) -> tuple[list[Token], list[Directive], int]:
    """Tokens, preprocessor lines in order, and the number of characters that are no token."""
    tokens: list[Token] = []
    lines: list[Directive] = []
    bad = 0
    starts = [0] + [m.end() for m in re.finditer("\n", text)] + [len(text) + 1]
    at, row, n = 0, 0, len(text)
    match = _TOKEN.match
    fresh = True  # nothing but blanks and comments on the line so far
    while at < n:
        if fresh and text[at] == "#":
            m = _DIRECTIVE.match(text, at)
            while starts[row + 1] <= m.start(2):
                row += 1
            lines.append(Directive(m[1], m[2], m.start(2), row, m.start(2) - starts[row]))
            at = m.end()
            continue
        m = match(text, at)
        begin, at = m.span()
        kind = m.lastgroup
        if kind == "skip":
            fresh = fresh or "\n" in m[0]
            continue
        fresh = False
        if kind == "bad":
            bad += 1
            continue
        while starts[row + 1] <= begin:
            row += 1
        tokens.append(Token(kind, text[begin:at], begin, row, begin - starts[row]))
    return tokens, lines, bad


_OPEN = {"(": ")", "[": "]", "{": "}"}


def match_brackets(tokens: list[Token]) -> tuple[dict[int, int], int]:
    """Index of each bracket's partner, and how many brackets have none; an open one without partner ends where its
    surroundings end."""
    pair: dict[int, int] = {}
    stack: list[int] = []
    lost = 0
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in ")]}":
            k = next((k for k in range(len(stack) - 1, -1, -1) if _OPEN[tokens[stack[k]].text] == t.text), None)
            # A round or square bracket never reaches out of a block.
            if k is None or (t.text != "}" and any(tokens[s].text == "{" for s in stack[k + 1 :])):
                lost += 1
                continue
            for s in stack[k + 1 :]:
                pair[s] = i
                lost += 1
            pair[stack[k]], pair[i] = i, stack[k]
            del stack[k:]
    for s in stack:
        pair[s] = len(tokens)
        lost += 1
    return pair, lost
