"""Shared pieces: written tables in the shared folder, row ids, bounded samples, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..storage import drop, release
from ..storage import mark as mark_tables
from ..storage import settled as written

__all__ = ["bounded_sample", "class_counts", "connected_components", "held_out", "learnable", "python_ready", "sampled_ids", "scanned", "written"]

#: Classes of labelled rows up to which their sample thresholds are broadcast.
FEW_CLASSES = 10_000


def python_ready(spark: SparkSession) -> None:
    """Ships the package to Python workers. Arrow batches are bounded in bytes by the session's own setting."""
    ship_package(spark)


#: Parts of a plan whose rows come in the same splits and the same order in every scan.
_SCAN = {"Project", "Filter", "LogicalRelation", "Relation", "RelationV2", "DataSourceV2ScanRelation"}


def scanned(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a plain scan of a table, so that monotonic row ids are the same whenever it is read; else
    ``df`` written to the shared folder and read back."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        name = plan.getClass().getSimpleName()
        if name not in _SCAN:
            return written(df, "rows")
        if not plan.children().size():
            return df
        plan = plan.children().apply(0)


def held_out(id_col: str = "doc_id"):
    """True for the fold that models never learn from: crc32 of the id as text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(id_col: str = "doc_id"):
    """True for rows that models may learn from: not held out, and of a known id."""
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def class_counts(df: DataFrame, classes: str) -> DataFrame:
    """(class, rows) of all rows, written once."""
    return written(df.groupBy(F.col(classes).alias("class_")).agg(F.count("*").alias("rows_")), "classes")


def bounded_sample(df: DataFrame, classes: str, bound: int, key, counts: DataFrame | None = None) -> DataFrame:
    """About ``bound`` rows of each value of ``classes``, by a hash of ``key``; the same rows in every run.

    A class of fewer rows is taken whole, and no class is left out. The class counts are of all rows. Used only to fit
    classifiers.
    """
    counts = class_counts(df, classes) if counts is None else counts
    least = counts.select("class_", F.ceil(F.least(F.lit(1.0), F.lit(float(bound)) / F.col("rows_")) * 1_000_003).alias("least_"))
    least = F.broadcast(least) if counts.count() <= FEW_CLASSES else least
    hashed = df.withColumn("hash_", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_003)))
    kept = hashed.join(least, F.col(classes).eqNullSafe(F.col("class_")) & (F.col("hash_") < F.col("least_")))
    return kept.drop("class_", "least_", "hash_")


def sampled_ids(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, label) of a sample of about ``bound`` distinct labelled ids of each class, to be broadcast: two classes of a few thousand rows."""
    return F.broadcast(bounded_sample(labels.distinct(), label, bound, F.col("doc_id")))


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph of ``edges(u, v)`` long columns; component is its smallest node.

    Alternating large-star and small-star steps: every step is a grouped minimum and one join, and each round is
    written to the shared folder. Only nodes that have an edge appear. Nothing but two numbers a round reaches the driver.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # Written, so that the join reads two plain shuffles: only then can a hub's edges be split over tasks.
            low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
            out = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            low = down.groupBy("u").agg(F.min("v").alias("m"))
            out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return (r[0], r[1])

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        begin = mark_tables()
        last, now = now, written(star(star(now, True), False), name)
        release(begin, keep=(now,))
        if (got := mark(now)) == seen:
            break
        seen = got
        drop(last)
    else:
        raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
