"""Text operators over DataFrames: tokens, word occurrences in code, functions around lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import SCANNER
from ..functions.lexical import grep_word
from ..session import ship_package

#: Lines in a bucket of the range join.
BUCKET = 64


def identifier_tokens(files: DataFrame) -> DataFrame:
    """(path, line, name, n) of the identifiers on each line of ``files(path, text)``, keywords left out; no Python.

    A line's names are sorted and their runs counted inside its row, so nothing is shuffled.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    found = F.regexp_extract_all("value", F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    keywords = F.array(*(F.lit(w) for w in sorted(SCANNER)))

    def bound(value: Column, then) -> Column:
        """``then(value)`` as an array column, with the value worked out once: a lambda's variable is never copied in."""
        return F.flatten(F.transform(F.array(value), then))

    def runs(names: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(names) - 1)
        begins = F.filter(places, lambda i: (i == 0) | (F.get(names, i) != F.get(names, i - 1)))
        return F.when(F.size(names) > 0, bound(begins, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(names, i).alias("name"), (F.coalesce(F.get(at, k + 1), F.size(names)) - i).cast("long").alias("n"))))).otherwise(F.array())

    counted = bound(F.array_sort(F.filter(found, lambda w: ~F.array_contains(keywords, w))), runs)
    return lines.where("value <> ''").select("path", "line", F.explode(counted).alias("row")).select("path", "line", "row.*")


def word_occurrences(files: DataFrame, word: str) -> DataFrame:
    """(path, line, col, snippet) of every whole-word occurrence in code, comments and literals masked.

    ``snippet`` is the trimmed line, which is at hand where the word is found. Files without the word never reach Python:
    the test runs in the scan's own stage.
    """
    ship_package(files.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                places = grep_word(text, word)
                lines = text.split("\n") if places else []
                rows += [(path, line, col, lines[line].strip(" \t\r")) for line, col in places]
            yield pd.DataFrame(rows, columns=["path", "line", "col", "snippet"])

    wanted = files.select("path", "text").where(F.col("text").contains(word) if word else F.lit(False))
    return wanted.mapInPandas(of, "path string, line int, col int, snippet string")


def enclosing_functions(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds ``func`` to ``points(file, line, ...)``: the latest-starting of ``ranges(file, name, start_line, end_line)`` around.

    A range join by buckets of lines: ranges are put into every bucket that they touch, so the join is on equal keys.
    """
    keys = points.columns
    tiled = ranges.select(F.col("file").alias("f_"), "name", "start_line", "end_line", F.explode(
        F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("bucket_"))
    placed = points.select("file", "line").distinct().withColumn("b_", F.floor(F.col("line") / BUCKET))
    inside = placed.join(tiled, (F.col("file") == F.col("f_")) & (F.col("b_") == F.col("bucket_"))).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = inside.groupBy("file", "line").agg(F.max_by("name", F.struct("start_line", "name")).alias("func"))
    return points.join(best, ["file", "line"], "left").select(*keys, "func")
