"""Mixing sources to target weights by cube-method balanced sampling.

Sources, in code-point order with null last, weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at
twice its source's words and the excess is shared again by weight. A source's rate is target over size: every document
is taken floor(rate) times, and once more with the rate's fraction as inclusion probability.

The fractional part is settled by the cube method: three fractional documents of a source at a time, probabilities move
along the null space of the two constraints (documents, words) until one of the three is in or out, so each source's
token and document totals stay exactly balanced. Documents are dealt into blocks of about ``BLOCK`` rows of one source by
a hash of their id, text and place, so that repeated rows spread; a block leaves at most two documents open, and these meet in the next, far smaller level.
The last block of a source holds its last twelve documents back for the landing, which takes the outcome of all open
ones that is nearest to the target.

Sizes, ranks and targets are of all rows; a source with a third of all rows is many blocks. Moves depend only on hashes
of rows, so reruns agree. Defined cases: a null text has 0 words, and so has an empty one; documents of 0 words take part
in the document balance and take 0 words; repeated rows are rows of their own; an empty table gives an empty result.
Two outcomes of the landing that miss alike: the first in order of the open documents' hashes. Ids may be of any type;
columns of other names, also such as ``size`` or ``copies``, are carried along. An input that is no plain table scan is
written first, so that row ids hold.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import python_ready, scanned, written

BLOCK = 512
HOLD = 12
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
EDGE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def flight(pi: np.ndarray, size: np.ndarray, seed: int, hold: int = 0) -> np.ndarray:
    """Moves inclusion probabilities in the null space of (count, size) until at most two are fractional.

    The last ``hold`` documents are left out, for the landing.
    """
    p, s = pi.tolist(), size.astype(np.float64).tolist()
    draws = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF).random(len(p)).tolist()
    live: list[int] = []
    for i in range(len(p) - hold):
        if EDGE < p[i] < 1 - EDGE:
            live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[j]) / d if d > 0 else -p[j] / d) for j, d in zip(live, u, strict=True) if d)
            down = min((p[j] / d if d > 0 else (p[j] - 1) / d) for j, d in zip(live, u, strict=True) if d)
            step = up if draws[i] * (up + down) < down else -down
            for j, d in zip(live, u, strict=True):
                p[j] += step * d
            live = [j for j in live if EDGE < p[j] < 1 - EDGE]
    out = np.array(p)
    out[out <= EDGE] = 0.0
    out[out >= 1 - EDGE] = 1.0
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the open probabilities (``HOLD`` + 2 at most) on the outcome that misses the words least, then the count."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    ways = np.array(list(itertools.product((0.0, 1.0), repeat=len(open_))))
    gap = ways - p[open_]
    words, count = np.abs(gap @ size.astype(np.float64)[open_]).round(6), np.abs(gap.sum(axis=1))
    out = p.copy()
    out[open_] = ways[np.lexsort((count, words))[0]]
    return out


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of every source of ``sizes(source, size)``.

    The rank that gives the weight is found by range partitions and their counts, so many sources need no single task;
    the level at which the targets fill is a short loop over sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = written(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = written(ranged.join(offsets, "part").select("source", "source_size", weight.alias("weight")), "mix-weights")
    full = MOST * F.col("source_size")
    totals = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    want = SHARE * (totals[0] or 0)
    level = want / totals[1] if totals[1] else 0.0
    while level:
        capped = full < level * F.col("weight")
        r = ranked.agg(F.sum(F.when(capped, full)), F.sum(F.when(~capped, F.col("weight")))).first()
        higher = (want - (r[0] or 0.0)) / r[1] if r[1] else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.select("source", "source_size", F.least(full, level * F.col("weight")).cast("double").alias("target"))


_UNIT = "place long, source string, size long, h long, copies int, pi double"


def _settle(last: bool):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "place"])
        end = last or bool(pdf["lone"].iloc[0])
        p = flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(), int(pdf["h"].iloc[0]), HOLD * end)
        if end:
            p = land(p, pdf["size"].to_numpy())
        return pdf.assign(pi=p)[[x.split()[0] for x in _UNIT.split(", ")]]

    return of


def mix(docs: DataFrame) -> DataFrame:
    """place, doc_id, size, source_size, target, copies, taken of every row of ``docs(doc_id, text, source)``.

    ``place`` is the row's monotonic id in the scan; ``copies`` how often the mix takes it.
    """
    python_ready(docs.sparkSession)
    docs = scanned(docs)
    sizes = written(docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", F.col("source").cast("string").alias("source"),
                                word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")), "mix-sizes")
    targets = written(source_targets(sizes), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of_source = targets.select(F.col("source").alias("s_"), rate.alias("rate"))
    units = sizes.join(of_source, F.col("source").eqNullSafe(F.col("s_"))).select(
        "place", "source", "size", "h", F.floor("rate").cast("int").alias("copies"), (F.col("rate") - F.floor("rate")).alias("pi"))
    done: list[DataFrame] = []
    level = 0
    while True:
        counts = units.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).withColumnRenamed("source", "s_")
        dealt = units.join(counts, F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumn(
            "block", F.pmod(F.xxhash64("h", "place", F.lit(level)), F.col("blocks"))).withColumn("lone", F.col("blocks") == 1).drop("blocks")
        moved = written(dealt.groupBy("source", "block").applyInPandas(_settle(level >= 12), _UNIT), f"mix-level{level}")
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(moved.where(~open_))
        units = moved.where(open_)
        if not units.limit(1).count():
            break
        level += 1
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    copies = (F.col("copies") + F.col("pi").cast("int")).cast("int")
    # Ids are of any type, and never go through pandas.
    ids = sizes.select(F.col("place").alias("place_"), "doc_id")
    out = settled.join(ids, F.col("place") == F.col("place_")).join(targets.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")))
    return out.select("place", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns."""
    docs = scanned(docs)
    chosen = mix(docs).where("copies > 0").select(F.col("place").alias("place_"), "copies")
    rows = docs.select(F.monotonically_increasing_id().alias("place_"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(chosen, "place_").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_")).select("row.*")
