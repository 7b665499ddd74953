"""Names that a type may go by: typedef hops, then one-letter suffix variants of each hop."""

from __future__ import annotations

import re
from collections.abc import Mapping

# Endings that a name with a one-letter ending is also looked up under; the last is none.
SUFFIXES = ("_s", "_e", "_u", "")


def suffix_tags(name: str) -> list[str]:
    m = re.fullmatch(r"(.*)_[a-z]", name, re.S)
    return [m[1] + s for s in SUFFIXES] if m else []


def candidate_tags(name: str, targets: Mapping[str, str]) -> list[str]:
    """The name, its typedef targets in order (cycles end), then the suffix variants of all of these; no repeats."""
    hops = [name]
    while (nxt := targets.get(hops[-1])) and nxt not in hops:
        hops.append(nxt)
    return list(dict.fromkeys(hops + [v for h in hops for v in suffix_tags(h)]))
