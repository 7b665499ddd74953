"""Exact top-k search: an impact-ordered index, read score at a time.

Vectors are quantised to integers, floor(256 x), and dealt into blocks by hash. A block is indexed once, as postings: a
segment holds the (vector, component) entries of one dimension whose impact (absolute value) falls into one level, levels
halving from the block's largest impact down. A block of queries reads the segments of one level after the other, by
descending impact, and adds each entry's products to its accumulators. After a level the unread rest of a vector has a
known Euclidean norm, so |product of the rest| is at most the query's norm times it: that bounds every score from both
sides. Reading stops only on proof, when for every query at most a few vectors can still reach the k-th lower bound, or
when nothing is left to read; the possible members, all of them, are then rescored exactly in integers, and ties go to
the smaller id.

Vectors move once, to their block; an index is a row of a written table and stays where it is. Queries go out in blocks of
``QUERY_BLOCK``, a broadcast of bounded size each, and every index row answers with its k best of each query; a second
step keeps the best k of these. A task that reads several indexes hands on, from one to the next, the score that k
candidates of each query already reach, so later ones stop sooner and answer with fewer rows. No unit grows with the input.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part. Vectors of other lengths
are as if padded with zeros. An id is asked once, with its smallest vector if it has several; rows of the query's own id
are its own and no candidates. Exact repeats of a row are candidates each, and take a rank each. Rows with a null id take
no part. An empty table gives an empty result; columns of other names, also such as ``score`` or ``rank``, are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import python_ready, written

VECTOR_BLOCK, QUERY_BLOCK = 2048, 2048
LEVELS = 6
#: Queries that read the segments together.
GROUP = 128
#: Blocks of queries after which their answers are written.
PARTS = 16
#: Possible members a query, beyond k, at which rescoring is cheaper than reading another level.
FEW = 24


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as long array; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


class Index:
    """Posting segments of one block by level and dimension, the norms of the rests below each level, and the vectors."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray):
        self.ids, self.times, self.vectors = ids, times, vectors
        impact = np.abs(vectors)
        high = int(impact.max()) if impact.size else 0
        lows = [high >> (k + 1) for k in range(LEVELS - 1)] + [0]
        #: By level: (dimension, vectors, components) of each segment that holds any.
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.rest: list[np.ndarray] = []
        for low in lows:
            held = (impact > low) & (impact <= high)
            dims, rows = np.nonzero(held.T)
            cuts = np.flatnonzero(np.diff(dims)) + 1
            starts = [0, *cuts.tolist()] if len(dims) else []
            parts = np.split(rows, cuts) if len(dims) else []
            self.segments.append([(int(dims[s]), p.astype(np.int32), vectors[p, dims[s]].astype(np.float64)) for s, p in zip(starts, parts, strict=True)])
            self.rest.append(np.sqrt((np.where(impact <= low, vectors, 0).astype(np.float64) ** 2).sum(axis=1)))
            high = low
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
        """(query, id, times, score) of the k best of every query, the query's own rows left out.

        ``floor`` has a score for each query that k candidates of other blocks are known to reach: members below it may
        be left out. Queries are read in groups, so that a group's accumulators stay in cache and it stops on its own.
        """
        floor = np.full(len(query_ids), -np.inf) if floor is None else floor
        out: list[tuple[int, int, int, int]] = []
        for a in range(0, len(query_ids), GROUP):
            part = slice(a, a + GROUP)
            out += self._search(query_ids[part], queries[part], k, floor[part])
        return out

    def _search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int, int]]:
        n, wide = self.vectors.shape[0], max(self.vectors.shape[1], queries.shape[1])
        q = np.zeros((len(query_ids), wide))
        q[:, : queries.shape[1]] = queries
        by_dim = np.ascontiguousarray(q.T)
        norm = np.sqrt((q * q).sum(axis=1))
        own = self.ids[:, None] == query_ids[None, :]
        acc = np.where(own, -np.inf, 0.0)
        k_here = min(k, n)
        possible = ~own
        for level, segments in enumerate(self.segments):
            for dim, rows, values in segments:
                acc[rows] += values[:, None] * by_dim[dim]
            # The last terms cover the rounding of sums in double precision.
            rest = (self.rest[level] * (1 + 1e-9) + self.norm * 1e-12)[:, None]

            def reach(some: slice, rest: np.ndarray = rest) -> np.ndarray:
                slack = rest * norm[some] + 1e-6
                kth = np.maximum(np.partition(acc[:, some] - slack, n - k_here, axis=0)[n - k_here], floor[some])
                return (acc[:, some] + slack >= kth) & ~own[:, some]

            # One query that must read on spares the others the test.
            if level < LEVELS - 1 and reach(slice(0, 1)).sum() > k_here + FEW:
                continue
            possible = reach(slice(None))
            if possible.sum(axis=0).max(initial=0) <= k_here + FEW:
                break
        out: list[tuple[int, int, int, int]] = []
        vectors = np.zeros((n, wide), dtype=np.int64)
        vectors[:, : self.vectors.shape[1]] = self.vectors
        exact = q.astype(np.int64)
        for r in range(len(query_ids)):
            at = np.flatnonzero(possible[:, r])
            if len(at):
                score = exact_products(vectors[at], exact[r])
                best = np.lexsort((self.ids[at], -score))[:k]
                out += [(int(query_ids[r]), int(self.ids[at[b]]), int(self.times[at[b]]), int(score[b])) for b in best]
        return out


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products, in wider integers where 64 bits might not hold a partial sum."""
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(len(query), 1) < 2.0**62:
        return vectors @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors], dtype=object)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _indexed(pdf: pd.DataFrame) -> pd.DataFrame:
    width = int(pdf["v"].map(len).max())
    index = Index(pdf["vec_id"].to_numpy(), pdf["times"].to_numpy(), _matrix(pdf["v"], width))
    return pd.DataFrame({"index": [pickle.dumps(index, protocol=5)]})


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    python_ready(spark)
    known = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    rows = written(known.groupBy("vec_id", "v").agg(F.count("*").alias("times")), "topk-vectors")
    n = rows.count()
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(-(-n // VECTOR_BLOCK) or 1))
    index = written(rows.groupBy(block.alias("block")).applyInPandas(lambda pdf: _indexed(pdf), "index binary"), "topk-index")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = asked.count()
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n_queries // QUERY_BLOCK) or 1))).repartition("part"), "topk-queries")
    done: DataFrame | None = None
    best: DataFrame | None = None
    for part in range(-(-n_queries // QUERY_BLOCK) or 1):
        found = index.mapInPandas(_answers(spark, asked.where(F.col("part") == part), k), "query_id long, vec_id long, times long, score long")
        best = found if best is None else best.unionByName(found)
        if part % PARTS == PARTS - 1:  # plans stay short, and broadcasts go
            kept = written(best, "topk-answers")
            done, best = kept if done is None else done.unionByName(kept), None
    best = done if best is None else best if done is None else done.unionByName(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    each = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))).alias("copy"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(spark, asked: DataFrame, k: int):
    """Answers a block of queries from rows of indexes; the block, of about ``QUERY_BLOCK`` rows, is broadcast."""
    block = asked.select("vec_id", "v").toArrow().to_pandas()
    width = max(map(len, block["v"]), default=0)
    shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), _matrix(block["v"], width)))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = shared.value
        # The k best scores of each query among the blocks that this task has read.
        best = np.full((len(ids), k), -np.inf)
        place = {int(q): r for r, q in enumerate(ids)}
        for pdf in batches:
            for stored in pdf["index"]:
                found = pickle.loads(stored).search(ids, queries, k, best.min(axis=1)) if len(ids) else []
                for query, _, _, score in found:
                    row = best[place[query]]
                    low = row.argmin()
                    row[low] = max(row[low], score)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "times", "score"]).astype("int64")

    return of


#: DuckDB twin: every product, ranked.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
q as (select vec_id, min(v) as v from v where vec_id % 50 = 0 group by vec_id),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
      from q join v c on q.vec_id <> c.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5
"""
