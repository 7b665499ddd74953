"""Variables that a file-scope macro call declares: ``TYPE WRAPPER(name, more);``.

Lines that look like one are cut into words and signs, and the first argument is read through nested wrappers. What
such a line gave before (a prototype or function of the wrapper's name, a call of it) is no fact and goes.
"""

from __future__ import annotations

import re
from itertools import accumulate

from ..functions.keywords import WRAPPED_NOT
from ..functions.lexical import strip_comments

# The line pattern, and the shape of a wrapper's name.
WRAPPED = re.compile(r"^\s*([A-Za-z_]\w*(?:\s*\*+)?)\s+([A-Z][A-Z0-9_]+)\s*\((.*)\)\s*;\s*$", re.A)
WRAPPER = re.compile(r"[A-Z][A-Z0-9_]+")
_PIECE = re.compile(r"[A-Za-z_]\w*|\s+|\S", re.A)


def arguments(pieces: list[str]) -> list[list[str]]:
    """The pieces between the commas that lie in no round or square bracket; an empty last argument is none."""
    depths = list(accumulate((p in ("(", "[")) - (p in (")", "]")) for p in pieces))
    cuts = [k for k, p in enumerate(pieces) if p == "," and depths[k] == 0]
    ends = zip([-1, *cuts], [*cuts, len(pieces)], strict=True)
    parts = [pieces[a + 1 : b] for a, b in ends]
    return parts if parts[-1] else parts[:-1]


def variable(argument: list[str]) -> str | None:
    """The variable in an argument: a name, alone or with one array bound, or that of a nested wrapper's first argument."""
    argument = [p for p in argument if not p.isspace()]
    head, rest = argument[:1], argument[1:]
    if not head or not re.match(r"[A-Za-z_]", head[0], re.A):
        return None
    if not rest or rest[0] == "[" and rest[-1] == "]" and "]" not in rest[:-1]:
        return head[0]
    if rest[0] == "(" and rest[-1] == ")" and WRAPPER.fullmatch(head[0]):
        inner = arguments(rest[1:-1])
        return variable(inner[0]) if inner else None
    return None


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(name, line, col, wrapper) of wrapped variables outside all braces."""
    code = strip_comments(text).split("\n")
    hits = [(ln, m) for ln, line in enumerate(code) if (m := WRAPPED.match(line))]
    if not hits:
        return []
    depths = [0, *accumulate((b for line in code for b in [sum((c == "{") - (c == "}") for c in line)]), lambda d, b: max(0, d + b))]
    found = []
    for ln, m in hits:
        parts = arguments(_PIECE.findall(m[3]))
        name = variable(parts[0]) if len(parts) > 1 and depths[ln] == 0 else None
        if name and name not in WRAPPED_NOT:
            at = re.compile(rf"(?<!\w){re.escape(name)}(?!\w)", re.A).search(code[ln], m.start(3))
            found.append((name, ln, at.start(), m[2]))
    return found


def apply(facts, text: str) -> None:
    """Adds the variables, and drops the wrapper's own symbol and call at their lines."""
    found = scan(text)
    sites = {(wrapper, ln) for _, ln, _, wrapper in found}
    fresh = {name: (ln, col) for name, ln, col, _ in reversed(found)}
    for s in facts.symbols:
        if s["kind"] == "global_variable":
            fresh.pop(s["name"], None)
    if sites:
        facts.symbols = [s for s in facts.symbols if s["kind"] not in ("prototype", "function") or (s["name"], s["line"]) not in sites]
        facts.calls = [c for c in facts.calls if (c["callee"], c["line"]) not in sites]
    for name, (ln, col) in sorted(fresh.items(), key=lambda x: x[1]):
        facts.symbol(name, "global_variable", ln, col)
    for rows in (facts.symbols, facts.calls):
        for k, row in enumerate(rows):
            row["ord"] = k
