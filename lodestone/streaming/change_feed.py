"""File changes as a stream: the newest change of a path wins, within a batch and over all batches.

A change is (path, seq, op, text, mtime) with op ``upsert`` or ``delete``. Upserts of excluded paths are dropped; deletes
are always applied. The index keeps the ``seq`` of each path's last change, also of deleted ones, so a change that comes
late is left out. Replace-by-file isn't an append, so the sink is ``foreachBatch`` over versioned tables: a batch that is
run again after a failure finds nothing newer to do. All state is on disk, named by batch; a restart goes on from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import Index
from ..options import IndexOptions
from ..sources.exclusion import excluded, rules_of
from ..storage import settled

CHANGES = "path string, seq long, op string, text string, mtime long"


def newest(changes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The last change of each path: one grouped maximum, with map-side partial results."""
    columns = columns or [c for c in changes.columns if c not in ("path", "seq")]
    return changes.groupBy("path").agg(F.max_by(F.struct("seq", *columns), "seq").alias("row")).select("path", "row.*")


def apply_changes(index_path: str, changes: DataFrame, options: IndexOptions | None = None) -> Index | None:
    """Applies one batch of changes; the index after it, or None if there is neither an index nor a change."""
    spark = changes.sparkSession
    options = options or IndexOptions()
    last = newest(changes)
    now = Index.open(spark, index_path)
    if now is not None:
        last = settled(last.join(now.touched.select("path", F.col("seq").alias("had_")), "path", "left").where("had_ is null or seq > had_").drop("had_"), "changes")
    kept = last.where("op <> 'delete'").where(~excluded(F.col("path"), rules_of(options.include, options.exclude)))
    gone = last.where("op = 'delete'").select("path", "seq")
    if last.isEmpty():
        return now
    return Index.build(spark, index_path, kept.select("path", "text", "mtime", "seq"), options, partial=True, removed=gone)


def follow(changes: DataFrame, index_path: str, checkpoint: str, options: IndexOptions | None = None, seconds: float | None = None) -> StreamingQuery:
    """Starts a query that keeps an index up to date; without ``seconds`` it takes what there is and stops."""
    def batch(df: DataFrame, _: int) -> None:
        apply_changes(index_path, df, options)

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def merge_state(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Last change of each path, over an earlier state and a batch."""
    last = newest(changes)
    return last if state is None else newest(state.unionByName(last))


def _states(spark: SparkSession, state_path: str) -> list[int]:
    """Batches whose state is complete, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(state_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(hadoop.Path(f"{state_path}/{n}/_SUCCESS")))


def replay(spark: SparkSession, changes: DataFrame, state_path: str, checkpoint: str) -> DataFrame:
    """Runs a change stream to its end, batch by batch, into state tables named by batch; the last state.

    A batch merges into the last state of an earlier batch, so one that is run again after a failure gives the same; only
    the two last states stay.
    """
    def batch(df: DataFrame, n: int) -> None:
        before = [k for k in _states(df.sparkSession, state_path) if k < n]
        state = df.sparkSession.read.parquet(f"{state_path}/{before[-1]}") if before else None
        merge_state(state, df).write.mode("overwrite").parquet(f"{state_path}/{n}")
        for k in before[:-1]:
            Index._drop(df.sparkSession, f"{state_path}/{k}")

    query = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = _states(spark, state_path)
    return spark.read.parquet(f"{state_path}/{done[-1]}") if done else spark.createDataFrame([], changes.schema)
