"""Serial index runs of which the newest wins, and bounded waiting for a stream to be idle."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class LatestRunner:
    """Runs one task at a time; a newer request cancels the running one's Spark jobs and skips those still waiting.

    A cancelled build leaves no version behind, so readers see the last one that ended; its folder goes with it, or with
    the next ``vacuum``.
    """

    def __init__(self, spark: SparkSession, name: str = "index-run"):
        self._spark, self._name = spark, name
        self._lock, self._turn = threading.Lock(), threading.Lock()
        self._newest = 0

    def request(self, task: Callable[[], object]) -> object | None:
        """The task's result, or None if a newer request took its place before or while it ran."""
        sc = self._spark.sparkContext
        with self._turn:
            self._newest += 1
            mine = self._newest
            if mine > 1:
                sc.cancelJobGroup(f"{self._name}-{mine - 1}")
        with self._lock:
            if mine != self._newest:
                return None
            sc.setJobGroup(f"{self._name}-{mine}", self._name, interruptOnCancel=False)
            try:
                return task()
            except Exception:
                if mine != self._newest:
                    return None
                raise
            finally:
                sc.setLocalProperty("spark.jobGroup.id", None)

    def stop(self) -> None:
        """Cancels what runs; nothing new starts until the next request."""
        with self._turn:
            self._newest += 1
            self._spark.sparkContext.cancelJobGroup(f"{self._name}-{self._newest - 1}")

    def wait(self, timeout_ms: int) -> bool:
        """Waits until nothing runs, at most so long; true if nothing does. 0 or less doesn't wait."""
        free = self._lock.acquire(timeout=timeout_ms / 1000) if timeout_ms > 0 else self._lock.acquire(blocking=False)
        if free:
            self._lock.release()
        return free


def wait_idle(query: StreamingQuery, timeout_ms: int) -> bool:
    """Waits until a change stream has taken in what there is, at most so long; true if it has. 0 or less doesn't wait."""
    end = time.time() + timeout_ms / 1000
    while True:
        status = query.status
        if not query.isActive or not (status["isDataAvailable"] or status["isTriggerActive"]):
            return True
        if time.time() >= end:
            return False
        time.sleep(0.02)
