"""Building and maintaining an index: plan, replace by file, parent links, versions on disk.

An index is a folder of Parquet tables and of manifests, one for each version; readers keep the version that they opened.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..extract.file_index import extract, relation
from ..options import IndexOptions
from ..schema import FACTS, FILE_INDEX

#: Slices of the files of a build that may be stopped.
SLICES = 8
AGGREGATE_KINDS = ("struct", "union", "class", "enum", "typedef")


def schema_version(version: str) -> int:
    """major * 10^6 + minor * 10^3 + patch; 0 if it isn't of that form."""
    m = re.match(r"(\d+)\.(\d+)\.(\d+)", version)
    return int(m[1]) * 1_000_000 + int(m[2]) * 1_000 + int(m[3]) if m else 0


def store_name(prefix: str, root: str) -> str:
    return f"{prefix}-{hashlib.sha1(root.encode()).hexdigest()[:12]}"


def index_plan(current: DataFrame, previous: DataFrame, force: bool = False, verify_hash: bool = False) -> DataFrame:
    """(path, action) with action index, unchanged or remove, of ``current(path, mtime, hash)`` and ``previous``.

    Times are compared for equality only. With ``verify_hash`` a file of another time but the same known hash is unchanged.
    One full outer join on the path.
    """
    a, b = current.alias("a"), previous.alias("b")
    same = F.col("a.mtime") == F.col("b.mtime")
    if verify_hash:
        same = same | F.coalesce(F.col("a.hash") == F.col("b.hash"), F.lit(False))
    action = (F.when(F.col("a.path").isNull(), "remove").when(F.lit(force) | F.col("b.path").isNull(), "index")
              .when(same, "unchanged").otherwise("index"))
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def replace_by_file(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "file") -> DataFrame:
    """``old`` without the rows of ``changed`` files, and ``new``. Files of ``changed`` without new rows are removed."""
    return old.join(changed.select(F.col(changed.columns[0]).alias(key)).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def remove_files(old: DataFrame, gone: DataFrame, key: str = "file") -> DataFrame:
    """``old`` without the rows of ``gone`` files; unknown ones change nothing."""
    return old.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti")


def parent_links(symbols: DataFrame, order: list[str | Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Adds ``parent_id``: the id of the aggregate definition that a symbol's scope names, aggregates before typedefs.

    The first by ``order`` (default ``id``) among equals in ``known`` (default ``symbols``); null where nothing matches or
    the scope is empty.
    """
    parent = (symbols if known is None else known).where(F.col("kind").isin(*AGGREGATE_KINDS) & F.col("is_definition") & (F.col("name") != ""))
    first = parent.groupBy(F.col("name").alias("scope")).agg(
        F.min_by("id", F.struct((F.col("kind") == "typedef").alias("late"), *(order or ["id"]))).alias("parent_id"))
    # An empty scope has no parent row, so it finds none; with nulls instead, it isn't even shuffled to one task.
    keyed = symbols.drop("parent_id").withColumn("scope_", F.nullif("scope", F.lit("")))
    return keyed.join(first.withColumnRenamed("scope", "scope_"), "scope_", "left").drop("scope_")


#: Folders of deltas over a full one, beyond which the next build writes a full one.
MOST_DELTAS = 12
#: Seconds after which what no version names is thought to belong to no running build.
STALE_S = 86_400


class Index:
    """One version of an index on disk. ``open`` gives None where there is none.

    A version is a list of folders: a full one, and deltas that each hold the rows of the files which one build touched.
    A file's rows are those of the last folder that touched it. A build writes into a folder of its own, of a name that
    no other build has, and then publishes a manifest that names the folders; until then nothing of it is seen, and what
    a failed or cancelled build leaves behind is never read and goes with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, folders: list[str]):
        self.spark, self.path, self.version, self.folders = spark, path.rstrip("/"), version, folders

    # -- files through Hadoop, so any store that Spark writes to will do

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def _manifests(cls, spark: SparkSession, path: str) -> list[str]:
        p, fs = cls._fs(spark, f"{path.rstrip('/')}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.endswith(".json"))

    @classmethod
    def _manifest(cls, spark: SparkSession, path: str, name: str | None = None) -> dict | None:
        name = name or next(iter(cls._manifests(spark, path)[::-1]), None)
        if name is None:
            return None
        p, fs = cls._fs(spark, f"{path.rstrip('/')}/manifest/{name}")
        stream = fs.open(p)
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @classmethod
    def _publish(cls, spark: SparkSession, path: str, version: int, schema: int, folders: list[str]) -> None:
        """A version exists once its manifest file does: one small file, created whole under its final name."""
        p, fs = cls._fs(spark, f"{path.rstrip('/')}/manifest/{version:012d}.json")
        part = p.suffix(f".{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "at": time.time(), "folders": folders}).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(part, p):
            fs.delete(part, False)
            raise RuntimeError(f"version {version} is there already: another build was faster")

    @classmethod
    def _drop(cls, spark: SparkSession, path: str) -> None:
        p, fs = cls._fs(spark, path)
        fs.delete(p, True)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: str = "1.0.0") -> Index | None:
        """The current version, or None if there is none or it is of another schema version."""
        m = cls._manifest(spark, path)
        return cls(spark, path, m["version"], m["folders"]) if m and m["schema"] == schema_version(schema) else None

    @classmethod
    def vacuum(cls, spark: SparkSession, path: str, keep: int = 2, older_than_s: float = STALE_S) -> list[str]:
        """Deletes versions but the last ``keep``, and folders that no kept version names and nobody wrote to for so long."""
        names = cls._manifests(spark, path)
        for name in names[:-keep]:
            cls._drop(spark, f"{path.rstrip('/')}/manifest/{name}")
        used = {f for n in names[-keep:] for f in cls._manifest(spark, path, n)["folders"]}
        p, fs = cls._fs(spark, f"{path.rstrip('/')}/data")
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []
        gone = [n for n, at in found if n not in used and at <= time.time() - older_than_s]
        for n in gone:
            cls._drop(spark, f"{path.rstrip('/')}/data/{n}")
        return gone

    # -- relations

    def _part(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{folder}/{name}")

    def table(self, name: str) -> DataFrame:
        """One relation: each folder's rows without those of files that a later folder touched."""
        key = "path" if name in ("files", "touched") else "file"
        rows, later = self._part(self.folders[-1], name), None
        for k in range(len(self.folders) - 2, -1, -1):
            touched = self._part(self.folders[k + 1], "touched").select(F.col("path").alias(key))
            later = touched if later is None else later.unionByName(touched)
            rows = remove_files(self._part(self.folders[k], name), later, key).unionByName(rows)
        return rows

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def touched(self) -> DataFrame:
        """(path, seq, removed): the change that each file was last given, also of files that are gone."""
        return self.table("touched")

    def __getattr__(self, name: str) -> DataFrame:
        if name in FACTS:
            return self.table(name)
        raise AttributeError(name)

    # -- builds

    @classmethod
    def build(cls, spark: SparkSession, path: str, files: DataFrame, options: IndexOptions | None = None, force: bool = False,
              schema: str = "1.0.0", partial: bool = False, removed: DataFrame | None = None, stop: Callable[[], bool] | None = None) -> Index:
        """A new version from ``files(path, text, mtime[, seq])``: only changed files are parsed, gone ones are removed.

        With ``partial`` the files are only those to refresh (saved or unsaved changes), and others stay but for the
        ``removed(path[, seq])`` ones. Without an earlier version or with ``force`` everything is written anew (bulk);
        else a delta of the touched files, whose cost follows them and not the index. ``stop`` is asked between slices of
        the files: when it says so, the version holds the slices that are done, and the next build finds the rest.
        """
        options = options or IndexOptions()
        newest = cls._manifest(spark, path)
        old = None if force else cls.open(spark, path, schema)
        folder = uuid.uuid4().hex
        base = f"{path.rstrip('/')}/data/{folder}"
        try:
            full = old is None or len(old.folders) > MOST_DELTAS
            cls._write(spark, base, old, files, options, partial, removed, stop, full)
            folders = [folder] if full else [*old.folders, folder]
            version = (newest["version"] if newest else 0) + 1
            cls._publish(spark, path, version, schema_version(schema), folders)
        except BaseException:
            cls._drop(spark, base)
            raise
        return cls(spark, path, version, folders)

    @classmethod
    def _write(cls, spark, base, old, files, options, partial, removed, stop, full) -> None:
        """Writes the folder of one build: the touched files' rows, or with ``full`` those of all files."""
        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{base}/{name}")
            return spark.read.schema(df.schema).parquet(f"{base}/{name}")

        def with_seq(df: DataFrame) -> DataFrame:
            return df if "seq" in df.columns else df.withColumn("seq", F.lit(None).cast("long"))

        files = with_seq(files)
        mtime = F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime")
        current = files.select("path", "seq", mtime, F.sha1(F.col("text").cast("binary")).alias("hash"))
        todo, plan = files, current.where("path is not null and hash is not null").select("path", F.lit("index").alias("action"), "seq")
        if old is not None:
            plan = index_plan(current, old.files.select("path", "mtime", "hash"), False, options.verify_content_hash).where("action <> 'unchanged'")
            plan = plan.join(current.select("path", "seq"), "path", "left").select("path", "action", "seq")
            if partial:
                plan = plan.where("action <> 'remove'")
                if removed is not None:
                    plan = plan.unionByName(with_seq(removed).select("path", F.lit("remove").alias("action"), "seq"))
        plan = stored(plan, "plan")
        if old is not None:
            todo = files.join(plan.where("action = 'index'").select("path"), "path", "left_semi")
        indexed = cls._parsed(spark, base, todo.select("path", "text", "mtime"), options, stop)
        # A stopped build has touched only what it parsed; what a full build's source cannot read is as good as gone.
        done = plan.where("action = 'index'").join(indexed.select("path"), "path", "left_semi").unionByName(plan.where("action = 'remove'")) if stop else plan
        touched = done.select("path", "seq", (F.col("action") == "remove").alias("removed"))
        meta = indexed.select("path", "hash", "mtime", "parsed_by", "parse_error")
        if full and old is not None:
            gone = touched.select("path")
            stored(replace_by_file(old.touched, touched, gone, "path"), "touched")
            stored(replace_by_file(old.files, meta, gone, "path"), "files")
        else:
            gone = stored(touched, "touched").select("path")
            stored(meta, "files")
        for name in FACTS:
            rows = relation(indexed, name)
            if name == "symbols":
                rows = rows.withColumn("id", F.xxhash64("file", "ord"))
                known = rows if old is None else replace_by_file(old.symbols.drop("parent_id"), rows, gone)
                rows = known if full else rows
                rows = parent_links(rows, ["file", "ord"], known)
            elif full and old is not None:
                rows = replace_by_file(old.table(name), rows, gone)
            # Clustered by name: point look-ups by name read few row groups. Ranges, so that a frequent name is many tasks.
            name_of = "name" if "name" in rows.columns else "callee"
            if full:
                rows = rows.repartitionByRange(name_of, "file", "ord")
            rows.sortWithinPartitions(name_of, "file", "ord").write.parquet(f"{base}/{name}")

    @staticmethod
    def _parsed(spark, base, todo: DataFrame, options: IndexOptions, stop) -> DataFrame:
        """The records of ``todo(path, text, mtime)``, dealt out evenly, written slice by slice if there may be a stop."""
        slices = SLICES if stop else 1
        for k in range(slices):
            if stop and stop():
                break
            part = todo if slices == 1 else todo.where(F.pmod(F.xxhash64("path"), F.lit(slices)) == k)
            extract(part.repartition("path") if options.workers is None else part.repartition(options.workers, "path"), options).write.mode("append").parquet(f"{base}/indexed")
        return spark.read.schema(FILE_INDEX).parquet(f"{base}/indexed") if slices == 1 or k else spark.createDataFrame([], FILE_INDEX)


def counts(symbols: DataFrame) -> DataFrame:
    """Symbols by file."""
    return symbols.groupBy("file").agg(F.count("*").alias("n_symbols"))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")
