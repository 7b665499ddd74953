"""Symbol search: query text, candidates by subsequence, fuzzy score, ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_score
from ..functions.lexical import display_tag  # noqa: F401  part of the search surface
from ..options import IndexOptions
from ..session import ship_package

# Kinds behind each one-letter prefix.
KIND_PREFIX = {
    "f": ["function", "prototype"], "v": ["global_variable"], "t": ["struct", "union", "enum", "enumerator", "class", "typedef"],
    "m": ["field", "method"], "d": ["macro"], "l": ["label"], "n": ["namespace"],
}


@dataclass(frozen=True)
class ParsedQuery:
    kinds: list[str] | None
    mode: str
    term: str


def parse_query(raw: str) -> ParsedQuery:
    """Kind prefix, mode mark (``'`` exact, ``^`` prefix) and term of a query text."""
    m = re.match(r"(?:([fvtmdln]):(?!:))?\s*(['^]?)(.*)\Z", raw, re.S)
    return ParsedQuery(KIND_PREFIX.get(m[1]), {"'": "exact", "^": "prefix"}.get(m[2], "fuzzy"), m[3])


def is_subsequence(name: Column, term: str) -> Column:
    """True if the term's characters occur in the name in order; A-Z fold, nothing else does."""
    parts = (f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.sub(r"([.+*?^${}()|\[\]\\])", r"\\\1", c) for c in term)
    return name.rlike("(?s)" + ".*".join(parts))


def candidates(symbols: DataFrame, term: str, kinds: list[str] | None = None, cap: int = 2000) -> DataFrame:
    """One row for each (name, kind) that contains the term as a subsequence: its definition if any, shortest names first.

    The cap is the feature's: a search shows at most so many candidates. Ties take the smallest id.
    """
    if not term:
        return symbols.limit(0).select("name", "kind", "data_type", "file", "line", "col", "is_definition", "id")
    rows = symbols.where((F.col("name") != "") & is_subsequence(F.col("name"), term))
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    best = rows.groupBy("name", "kind").agg(
        F.max_by(F.struct("data_type", "file", "line", "col", "is_definition", "id"), F.struct("is_definition", -F.col("id"))).alias("row"))
    return best.select("name", "kind", "row.*").orderBy(F.length("name"), "name", "kind").limit(cap)


def score_column(pattern: str, name: Column, spark) -> Column:
    """Fuzzy score of a name column, null where it doesn't match."""
    ship_package(spark)

    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fuzzy_score(pattern, x) for x in batch], dtype="Int32")

    return of(name)


def fuzzy_filter(rows: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Matching rows with ``score``, best first, then shorter names; none for an empty pattern."""
    if not pattern:
        return rows.limit(0).withColumn("score", F.lit(0))
    scored = rows.withColumn("score", score_column(pattern, F.col("name"), rows.sparkSession)).where("score is not null")
    ordered = scored.orderBy(F.desc("score"), F.length("name"), "name", "kind")
    return ordered.limit(limit) if limit is not None else ordered


def literal_filter(rows: DataFrame, term: str, mode: str, limit: int | None = None) -> DataFrame:
    """Rows whose name is the term, or starts with it, in any case; shorter first, then by letters without case."""
    low = F.lower("name")
    kept = rows.where(low == term.lower() if mode == "exact" else low.startswith(term.lower()))
    ordered = kept.orderBy(F.length("name"), low, "name", "kind")
    return ordered.limit(limit) if limit is not None else ordered


def search(symbols: DataFrame, raw: str, options: IndexOptions | None = None) -> DataFrame:
    """Ranked results of a query text, with ``label`` and ``description``; none for a term of under two characters."""
    options = options or IndexOptions()
    q = parse_query(raw)
    found = candidates(symbols, q.term if len(q.term.strip()) >= options.min_term else "", q.kinds, options.candidate_cap)
    if q.mode == "fuzzy":
        ranked = fuzzy_filter(found, q.term, options.max_results)
    else:
        ranked = literal_filter(found, q.term, q.mode, options.max_results).withColumn("score", F.lit(None).cast("int"))
    shown = F.when(F.col("data_type").startswith("@anon:") | (F.col("data_type") == ""), F.col("kind")).otherwise(F.concat_ws(", ", "kind", "data_type"))
    line = F.col("line") if options.strict_compat else F.col("line") + 1
    return ranked.withColumn("label", F.col("name")).withColumn("description", F.concat(shown, F.lit("  —  "), F.col("file"), F.lit(":"), line))
