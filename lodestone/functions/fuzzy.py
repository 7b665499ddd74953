"""Fuzzy score of a pattern in a name: the best way to place its characters, in one pass per pattern character."""

from __future__ import annotations

# Fixed values of the score.
MATCH, GAP_START, GAP_MORE = 16, -3, -1
BOUNDARY, CAMEL, CONSECUTIVE, FIRST_TIMES = 8, 7, 6, 2
NEVER = float("-inf")


def bonus(name: str, j: int) -> int:
    """Bonus of a place: start or after a sign, lower to upper case, or the first digit."""
    if j == 0:
        return BOUNDARY
    before, here = name[j - 1], name[j]
    if not (before.isascii() and before.isalnum()):
        return BOUNDARY
    if before.islower() and here.isascii() and here.isupper() or not before.isdigit() and here.isascii() and here.isdigit():
        return CAMEL
    return 0


def gap(n: int) -> int:
    return GAP_START + (n - 1) * GAP_MORE if n > 0 else 0


def fuzzy_score(pattern: str, name: str | None) -> int | None:
    """Score, which may be negative; None if the pattern is no subsequence; 0 for an empty pattern."""
    if not pattern:
        return 0
    if name is None or len(pattern) > len(name):
        return None
    p, t = pattern.lower(), name.lower()
    if len(t) != len(name):
        t = "".join(c.lower() if len(c.lower()) == 1 else c for c in name)
    places = [bonus(name, j) for j in range(len(name))]
    row = [MATCH + FIRST_TIMES * places[j] + gap(j) if t[j] == p[0] else NEVER for j in range(len(t))]
    for ch in p[1:]:
        nxt = [NEVER] * len(t)
        apart = NEVER  # best earlier placement with at least one character between, its gap paid up to here
        for j in range(1, len(t)):
            if j > 1:
                apart = max(apart + GAP_MORE, row[j - 2] + GAP_START)
            if t[j] == ch:
                nxt[j] = MATCH + max(row[j - 1] + max(places[j], CONSECUTIVE), apart + places[j])
        row = nxt
    best = max(row)
    return None if best == NEVER else int(best)
