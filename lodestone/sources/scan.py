"""Sources of files: a tree of source files, text buffers, and the metadata of an earlier index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import C_ENDINGS, CPP_ENDINGS, IndexOptions
from .exclusion import excluded, rules_of

FILES = "path string, text string, mtime long"


def language(path: Column) -> Column:
    """c, cpp or null by the path's ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(ending.isin(*sorted(C_ENDINGS)), "c").when(ending.isin(*sorted(CPP_ENDINGS)), "cpp")


def scan_files(spark: SparkSession, root: str, options: IndexOptions | None = None, folder: str | None = None) -> DataFrame:
    """(path, text, mtime in ms) of the source files below ``root`` that no rule excludes, path relative to it.

    Endings are pushed into the file listing. Texts are read whole; files that vanish or cannot be read are skipped.
    """
    options = options or IndexOptions()
    endings = ",".join(sorted({e for x in options.extensions for e in (x.lstrip("."), x.lstrip(".").upper())}))
    rows = (spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
            .text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + endings + "}"))
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    absolute = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^file:/+", "/")
    relative = F.substr(absolute, F.lit(len(base) + 2))
    files = rows.select(relative.alias("path"), F.col("value").alias("text"),
                        (F.unix_millis("_metadata.file_modification_time")).cast("long").alias("mtime"))
    rules = rules_of(options.include, options.exclude)
    return files.where(~excluded(F.col("path"), rules, F.lit(folder) if folder else None)) if rules else files


def buffers(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    """Unsaved texts as (path, text, mtime) rows."""
    return spark.createDataFrame(rows, FILES)
