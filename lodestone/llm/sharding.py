"""Sharding by histogram sort: splitters are found by counting exact bytes below candidate keys, then one exchange.

Every row has a sort key of 48 hex digits: a hash of its text, then of its id, then of its place in the input. A round
counts exact bytes below probe keys (the starts of equal key ranges) across all partitions; a splitter whose nearest
probe is within the tolerance is settled, the others' ranges are probed again more finely. Equal texts are neighbours in
key order, so a group of copies stays in one shard unless a splitter cannot meet the tolerance without cutting it; a
group of a third of all rows is cut where the bytes ask for it. A round brings at most 4096 sums to the driver, or 256
for each open splitter. Rows move once, when they are dealt out.

Law: ``bytes``. Sizes (UTF-8 bytes of the text plus 16) of shards are near equal: every boundary is within
``tolerance`` of its share, or at the document border nearest to it.

Defined cases: a null text has no bytes, so size 16, and CRC 0; repeated rows are rows of their own; an empty table
gives an empty result; with fewer rows than shards some shards stay empty; equal keys don't arise, as the place is part
of the key. Columns of other names, also such as ``key`` or ``slot``, are handed through by ``carry``. An input that is
no plain table scan is written first, so that row ids hold.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import scanned, written

FIRST_DIGITS, MORE_DIGITS, KEY_DIGITS = 3, 2, 48


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)


def sort_key(text: Column, row_id: Column, place: Column) -> Column:
    def hexed(c: Column) -> Column:
        return F.lpad(F.hex(c), 16, "0")

    return F.concat(hexed(F.xxhash64(text)), hexed(F.xxhash64(row_id, F.lit(1))), hexed(F.xxhash64(place, F.lit(2))))


def splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[str]:
    """n_shards - 1 ascending splitters over ``keys(key, size)``: a row is at or above splitter b iff key >= b."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / n_shards
    found: dict[int, str] = {}
    #: Key range (by its common prefix) -> bytes below it, and the splitters that fall into it.
    open_ranges: dict[str, tuple[int, list[int]]] = {"": (0, list(range(1, n_shards)))}
    while open_ranges and total:
        deep: dict[int, list[str]] = {}
        for prefix in open_ranges:
            deep.setdefault(len(prefix), []).append(prefix)
        sums: dict[str, list[tuple[str, int, str, str]]] = {p: [] for p in open_ranges}
        probes = None
        for length, prefixes in deep.items():
            digits = FIRST_DIGITS if not length else MORE_DIGITS
            part = keys if not length else keys.where(F.substring("key", 1, length).isin(prefixes))
            one = part.groupBy(F.substring("key", 1, length).alias("above"), F.substring("key", 1, length + digits).alias("bin")).agg(
                F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
            probes = one if probes is None else probes.unionByName(one)
        for r in probes.collect():
            sums[r["above"]].append((r["bin"], r["bytes"], r["low"], r["high"]))
        nxt: dict[str, tuple[int, list[int]]] = {}
        for prefix, (below, wanted) in open_ranges.items():
            for b, n_bytes, low, high in sorted(sums[prefix]):
                inside = [i for i in wanted if below < total * i / n_shards <= below + n_bytes]
                for i in inside:
                    left, right = total * i / n_shards - below, below + n_bytes - total * i / n_shards
                    if min(left, right) <= slack or low == high:
                        found[i] = low if left <= right else high + "g"  # "g" is above every digit that can follow
                    else:
                        shared = os.path.commonprefix([low, high])
                        nxt.setdefault(shared, (below, []))[1].append(i)
                below += n_bytes
        open_ranges = nxt
    return [found.get(i, "g") for i in range(1, n_shards)]


def _shard(key: Column, bounds: list[str], base: int = 0) -> Column:
    """How many splitters are at or below the key, by binary search in one expression."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(key >= F.lit(bounds[mid]), _shard(key, bounds[mid + 1 :], base + mid + 1)).otherwise(_shard(key, bounds[:mid], base))


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.002, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs(doc_id, text)``; ``carry`` as struct ``row``.

    Slots count from 0 in each shard without gaps. A slot is the number of the shard's rows in earlier input splits,
    plus the row's number among the shard's rows of its own split, so numbering needs no sort of a whole shard.
    """
    docs = scanned(docs)
    text = F.col("text")
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    placed = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text", *more)
    rows = placed.select(
        "place", "doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        sort_key(text, F.col("doc_id"), F.col("place")).alias("key"), *(["row"] if carry else []))
    keys = written(rows.select("place", "key", "size"), "shard-keys")
    shard = _shard(F.col("key"), splitters(keys.select("key", "size"), n_shards, tolerance)).cast("int").alias("shard")
    split = F.shiftright("place", 33).alias("split")
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keys.select(split, shard).groupBy("shard", "split").count().select(
        "shard", "split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    here = Window.partitionBy("shard", "split").orderBy("place")
    dealt = rows.select("*", split, shard).join(offsets, ["shard", "split"])
    return dealt.select("doc_id", "size", "text_crc32", "shard",
                        (F.col("offset") + F.row_number().over(here) - 1).cast("long").alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, tolerance: float = 0.002) -> None:
    """Writes ``docs`` with their columns into ``path/shard=N`` folders, each row once.

    A column of its own named ``shard`` (in any case of letters) is written with underscores after its name.
    """
    out = shard_by_bytes(docs, n_shards, tolerance, carry=docs.columns)
    taken = {c.lower() for c in docs.columns}
    own = "shard_"
    while own in taken:
        own += "_"
    kept = [F.col("row").getField(c).alias(own if c.lower() == "shard" else c) for c in docs.columns]
    out.select(*kept, F.col("shard").alias("shard")).write.partitionBy("shard").parquet(path)
