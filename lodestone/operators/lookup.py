"""Point queries over the relations: filters that reach the Parquet scan, and batches of cursors by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maintenance import first_by

# Kinds that a token's role admits. An unknown role admits all.
ROLE_KINDS = {
    "value": ["function", "prototype", "global_variable", "enumerator", "method", "macro"],
    "type": ["struct", "union", "enum", "class", "typedef", "macro"],
    "field": ["field", "macro"],
    "label": ["label"],
    "namespace": ["namespace", "class", "macro"],
}
HIT = ["file", "line", "col", "kind", "name"]


def find_symbols(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def find_definitions(symbols: DataFrame, name: str, kinds: list[str] | None = None, definition: bool = True) -> DataFrame:
    """Definitions of a name, of some kinds if any are given."""
    rows = symbols.where((F.col("name") == name) & (F.col("is_definition") == definition))
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def find_declarations(symbols: DataFrame, name: str, kinds: list[str] | None = None) -> DataFrame:
    return find_definitions(symbols, name, kinds, definition=False)


def find_references(refs: DataFrame, name: str, role: str | None = None) -> DataFrame:
    """References that aren't local: a field needs its exact role, other roles also take rows without one."""
    rows = refs.where((F.col("name") == name) & ~F.col("is_local"))
    if role == "field":
        return rows.where(F.col("role") == "field")
    return rows.where(F.col("role").isin(role, "")) if role else rows


def find_local_references(refs: DataFrame, name: str, file: str, func: str | None = None) -> DataFrame:
    """Local references in one function of a file, or without ``func`` in all of its functions."""
    within = F.col("enclosing_func").isNotNull() if func is None else F.col("enclosing_func") == func
    return refs.where((F.col("name") == name) & (F.col("file") == file) & within & F.col("is_local"))


def find_callers(calls: DataFrame, name: str) -> DataFrame:
    return calls.where(F.col("callee") == name)


def find_callees(calls: DataFrame, name: str) -> DataFrame:
    return calls.where(F.col("caller") == name)


def find_locals(local_rows: DataFrame, name: str, file: str, func: str) -> DataFrame:
    return local_rows.where((F.col("name") == name) & (F.col("file") == file) & (F.col("func") == func))


def enclosing_func_at(refs: DataFrame, file: str, name: str, line: int, col: int) -> DataFrame:
    at = refs.where((F.col("file") == file) & (F.col("name") == name) & (F.col("line") == line) & (F.col("col") == col))
    return at.orderBy("ord").select("enclosing_func").limit(1)


def ref_at(refs: DataFrame, cursors: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """First reference at each exact place of ``cursors(req_id, file, name, line, col)``; cursors without one stay, with nulls.

    First is by ``ord``, and by the columns ``ties`` of ``refs`` where that repeats.
    """
    at = ["file", "name", "line", "col"]
    rows = refs.select(*at, "ord", "enclosing_func", "is_local", "role", "owner", "obj_chain", F.col("source").alias("ref_source"), *ties)
    # An id that is asked at several places has a reference if any of them has.
    return first_by(cursors.join(rows, at, "left"), ["req_id"], [F.col(c).asc_nulls_last() for c in ("ord", *ties)]).drop(*ties)


def scope_at(refs: DataFrame, cursors: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The same with defaults for places without a reference."""
    return ref_at(refs, cursors, ties).withColumns({
        "is_local": F.coalesce("is_local", F.lit(False)), "role": F.coalesce("role", F.lit("")), "owner": F.coalesce("owner", F.lit(""))})


def typedef_targets(aliases: DataFrame) -> DataFrame:
    """(name, target): the first target of each typedef name."""
    return aliases.groupBy("name").agg(F.min_by("target", F.struct("file", "ord")).alias("target"))


def hits(symbols: DataFrame) -> DataFrame:
    return symbols.select(*HIT)


def role_kinds(spark) -> DataFrame:
    """(role, kind) of all roles, a table of 18 rows."""
    return spark.createDataFrame([(r, k) for r, ks in ROLE_KINDS.items() for k in ks], "role string, kind string")
