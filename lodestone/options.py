"""Options of indexing and querying, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# File endings by language, and the endings that are scanned by default.
C_ENDINGS = frozenset("c h inc".split())
CPP_ENDINGS = frozenset("cpp cc cxx c++ hpp hh hxx h++".split())
DEFAULT_EXTENSIONS = (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".inc")


@dataclass(frozen=True)
class IndexOptions:
    """Settings of a build; ``strict_compat`` keeps visible quirks of the line scanner and of search labels."""

    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    verify_content_hash: bool = False
    parse_timeout_ms: int = 5000
    error_ratio_threshold: float = 0.25
    max_file_size_kb: int = 2048
    max_results: int = 200
    candidate_cap: int = 2000
    min_term: int = 2
    strict_compat: bool = True
    hidden_categories: frozenset[str] = field(default_factory=frozenset)
    hide_empty: bool = True
    #: Tasks that parse at once; None leaves it to the session's shuffle partitions.
    workers: int | None = None
    #: How long a question waits for a running build.
    defer_queries_ms: int = 1500


def language_of(path: str) -> str | None:
    """c, cpp, or None for an unknown ending."""
    ending = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    return "c" if ending in C_ENDINGS else "cpp" if ending in CPP_ENDINGS else None
