"""Source text to the nested record of one file, and the same over a DataFrame of files.

Which way a file goes is decided in order: no known language, too large, a parse that takes too long or fails, or too
large a share of unread text all lead to the line scanner; else the parser's rows stand.
"""

from __future__ import annotations

import hashlib
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..options import IndexOptions, language_of
from ..schema import FACTS, FILE_INDEX
from ..session import ship_package
from . import macro_vars
from .facts import Facts
from .grep_scan import grep_scan
from .parser import parse


#: Characters of source text whose records are handed on at once.
OUT_CHARS = 1 << 18


class ParseTimeout(Exception):
    pass


@contextmanager
def deadline(ms: int):
    """Raises ParseTimeout after so many milliseconds; without effect off the main thread, or for 0."""
    if ms <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise ParseTimeout

    old = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, ms / 1000)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def content_hash(text: str) -> str:
    return hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()


def facts_of(path: str, text: str, lang: str | None, options: IndexOptions) -> Facts:
    facts, error = None, None
    if lang is not None and len(text.encode("utf-8", "surrogatepass")) <= options.max_file_size_kb * 1024:
        try:
            with deadline(options.parse_timeout_ms):
                p = parse(text, path, lang)
            if p.error_ratio <= options.error_ratio_threshold:
                facts = p.facts
            else:
                error = f"unread: {p.error_ratio:.2f}"
        except Exception as e:  # noqa: BLE001  whatever a parser trips over, the file still has its lines
            error = f"{type(e).__name__}: {e}"
    elif lang is not None:
        error = "too large"
    if facts is None:
        facts = grep_scan(text)
        facts.parse_error = error
    macro_vars.apply(facts, text)
    return facts


def index_file(path: str, text: str, lang: str | None = None, options: IndexOptions | None = None, mtime: int = 0) -> dict:
    """The record of one file; ``lang`` defaults to that of the path's ending."""
    facts = facts_of(path, text, lang or language_of(path), options or IndexOptions())
    return {"path": path, "hash": content_hash(text), "mtime": mtime, "parsed_by": facts.source,
            "parse_error": facts.parse_error} | {k: getattr(facts, k) for k in FACTS}


def extract(files: DataFrame, options: IndexOptions | None = None) -> DataFrame:
    """One FileIndex row for each row of ``files(path, text, mtime)``; a null text is skipped like an unreadable file."""
    spark = files.sparkSession
    ship_package(spark)
    options = options or IndexOptions()

    shape = to_arrow_schema(FILE_INDEX)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready, size = [], 0
            for row in batch.to_pylist():
                ready.append(index_file(row["path"], row["text"], options=options, mtime=row["mtime"]))
                size += len(row["text"])
                if size >= OUT_CHARS:  # a record can be many times its text
                    yield pa.RecordBatch.from_pylist(ready, shape)
                    ready, size = [], 0
            if ready:
                yield pa.RecordBatch.from_pylist(ready, shape)

    wanted = files.where("text is not null and path is not null").select("path", "text", F.coalesce(F.col("mtime"), F.lit(0)).cast("long").alias("mtime"))
    return wanted.mapInArrow(of, FILE_INDEX)


def relation(indexed: DataFrame, name: str) -> DataFrame:
    """One of the five fact relations of ``indexed`` FileIndex rows, with the file's path as ``file``."""
    return indexed.select(F.col("path").alias("file"), F.explode(name).alias("row")).select("file", "row.*")
