"""Path rules: globs to regular expressions, ordered rules of which the last that matches wins, ignore files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False


_PARTS = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
# What the wildcards of a glob stand for.
_WILD = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression that Java, RE2 and Python read alike."""
    body = "".join(_WILD.get(x) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", x) for x in _PARTS.findall(pattern))
    return f"^{body}$"


def rules_of(include: tuple[str, ...] | list[str], exclude: tuple[str, ...] | list[str]) -> list[Rule]:
    """Excludes first, then includes, whatever their order in the settings."""
    return [Rule(x) for x in exclude] + [Rule(x, True) for x in include]


def parse_ignore_line(line: str) -> list[Rule]:
    """Rules of one line of an ignore file."""
    text = line.strip()
    if not text or text.startswith("#"):
        return []
    negated = text.startswith("!")
    text = text[negated:]
    rooted = text.startswith("/")
    text = text[rooted:]
    text = text[:-1] + "/**" if text.endswith("/") and text != "/" else text.removesuffix("/")
    if not text or text == "/**":
        return []
    return [Rule(text, negated)] + ([] if rooted else [Rule(f"**/{text}", negated)])


def parse_ignore(content: str) -> list[Rule]:
    return [r for line in re.split(r"\r?\n", content) for r in parse_ignore_line(line)]


def _forms(path: str, folder: str | None) -> list[str]:
    path = path.replace("\\", "/")
    return [path] if not folder else [path, f"{folder}/{path}" if path else folder]


def is_excluded(path: str, rules: list[Rule], folder: str | None = None) -> bool:
    """One decision over both forms of a path: relative to its folder, and with the folder's name before it."""
    forms = _forms(path, folder)
    last = next((r for r in reversed(rules) if any(re.search(glob_regex(r.pattern), f, re.S) for f in forms)), None)
    return last is not None and not last.negated


def excluded(path: Column, rules: list[Rule], folder: Column | None = None) -> Column:
    """The same decision as a column, in built-in functions; the newest rule is tested first."""
    path = F.regexp_replace(path, r"\\", "/")
    forms = [path]
    if folder is not None:
        forms.append(F.when(F.coalesce(folder, F.lit("")) == "", path).otherwise(F.when(path == "", folder).otherwise(F.concat(folder, F.lit("/"), path))))
    out = F.lit(False)
    for r in rules:
        hit = F.lit(False)
        for f in forms:
            # Java's $ also matches before a last line end, and its dot stops there: neither may be.
            hit = hit | f.rlike("(?s)" + glob_regex(r.pattern)[:-1] + r"\z")
        out = F.when(hit, F.lit(not r.negated)).otherwise(out)
    return out


def excluded_in_folders(file: str, folders: list[str], rules: list[Rule]) -> bool:
    """True if any of the folders (absolute paths) that hold the file excludes it; a file outside all is judged as it is."""
    file = file.replace("\\", "/")
    inside = [f.rstrip("/") for f in folders if file.startswith(f.rstrip("/") + "/")]
    if not inside:
        return is_excluded(file, rules)
    return any(is_excluded(file[len(f) + 1 :], rules, f.rpartition("/")[2]) for f in inside)
