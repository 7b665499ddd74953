"""Session helpers: a local session for tests and the bench, and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine's results rely on (UTC, adaptive execution)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application.

    Functions of Python operators are pickled by reference, so a worker must be able to import the package; on a
    cluster where only the driver has it, Spark's file server brings it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestone-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "lodestone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
