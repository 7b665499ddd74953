"""Intermediate tables in the shared folder: what several parts of a plan need is computed once, and lineage stays short."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_settled: list[tuple[SparkSession, str, int]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own, which only a local master may use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        where = _own[app]
    return where.rstrip("/")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back; gone when it is released, or when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append((spark, path, threading.get_ident()))
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def mark() -> int:
    """A point in the list of settled tables, for ``release``."""
    return len(_settled)


def release(since: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables that this thread settled after ``since``, but for those of ``keep``.

    For callers that have written all that they want of them: a plan that still reads one would fail.
    """
    stay = {getattr(df, "settled_path", None) for df in keep}
    mine = [x for x in _settled[since:] if x[2] == threading.get_ident() and x[1] not in stay]
    for entry in mine:
        _delete(*entry[:2])
        _settled.remove(entry)


def drop(df: DataFrame) -> None:
    """Deletes one settled table that nothing reads any more."""
    for entry in [x for x in _settled if x[1] == getattr(df, "settled_path", None)]:
        _delete(*entry[:2])
        _settled.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        conf = sc._jsc.hadoopConfiguration() if sc._jsc is not None else sc._jvm.org.apache.hadoop.conf.Configuration()
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone
        pass


def _clean() -> None:
    """Deletes what was settled; a stopped session's files too, as long as its JVM still runs."""
    for spark, path, _ in _settled:
        _delete(spark, path)
    for where in _own.values():
        shutil.rmtree(where.removeprefix("file://"), ignore_errors=True)


atexit.register(_clean)
