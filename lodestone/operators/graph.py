"""Call graph: one level of callers or callees, and trees by a loop of joins that stops at repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settled

FILE_SCOPE = "(file scope)"


def neighbours(calls: DataFrame, direction: str) -> DataFrame:
    """(parent, name, file, line, col): the first call site of each neighbour, in direction ``callers`` or ``callees``."""
    parent, other = ("callee", "caller") if direction == "callers" else ("caller", "callee")
    rows = calls.select(F.col(parent).alias("parent"), F.coalesce(F.col(other), F.lit(FILE_SCOPE)).alias("name"), "file", "line", "col", "ord")
    first = F.min_by(F.struct("file", "line", "col"), F.struct("file", "ord")).alias("at")
    return rows.where("parent is not null").groupBy("parent", "name").agg(first).select("parent", "name", "at.*")


def call_children(calls: DataFrame, direction: str, parents: DataFrame) -> DataFrame:
    """Children of ``parents(parent, ancestors array)``; ``recursive`` marks those that are not to be opened again."""
    rows = parents.join(neighbours(calls, direction), "parent")
    path = F.concat("ancestors", F.array("parent"))
    return rows.select("parent", "name", "file", "line", "col", path.alias("ancestors"),
                       ((F.col("name") == FILE_SCOPE) | F.array_contains(path, F.col("name"))).alias("recursive"))


def has_children(calls: DataFrame, direction: str, names: DataFrame) -> DataFrame:
    """The ``names(name)`` that have any child."""
    return names.join(calls.select(F.col("callee" if direction == "callers" else "caller").alias("name")).distinct(), "name", "left_semi")


def call_relations(calls: DataFrame, direction: str, requests: DataFrame) -> DataFrame:
    """First level for ``requests(req_id, word, is_local)``; a local has none."""
    parents = requests.where(~F.col("is_local")).select("req_id", F.col("word").alias("parent"))
    rows = parents.join(neighbours(calls, direction), "parent")
    return rows.select("req_id", "name", "file", "line", "col", ((F.col("name") == FILE_SCOPE) | (F.col("name") == F.col("parent"))).alias("recursive"))


def call_tree(calls: DataFrame, direction: str, roots: DataFrame, depth: int) -> DataFrame:
    """(root, depth, path, name, file, line, col, recursive) of the trees below ``roots(root)``, ``depth`` levels deep."""
    edges = neighbours(calls, direction)
    edges = settled(edges, "edges") if depth > 1 else edges  # every level joins them
    level = roots.select("root", F.col("root").alias("at_"), F.array("root").alias("path"))
    out = None
    for k in range(1, depth + 1):
        rows = level.join(edges, F.col("at_") == F.col("parent")).select(
            "root", F.lit(k).alias("depth"), "path", "name", "file", "line", "col",
            ((F.col("name") == FILE_SCOPE) | F.array_contains("path", F.col("name"))).alias("recursive"))
        out = rows if out is None else out.unionByName(rows)
        level = rows.where(~F.col("recursive")).select("root", F.col("name").alias("at_"), F.concat("path", F.array("name")).alias("path"))
    return out
