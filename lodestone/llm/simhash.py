"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link if they
differ in 3 bits or fewer. Of two halves of 32 bits, one then differs in at most one bit, so every distinct fingerprint
is put into a table under each half, and also under each half with one of its set bits cleared: whichever of two
neighbouring halves has the extra bit reaches the other that way. That is the Hamming ball of radius 1, and each pair
meets under one key at least. Rows of a key are verified over all 64 bits.

Copies are one fingerprint, so groups of copies are never expanded. Under a key only a spanning forest of the verified
links is emitted, at most one link fewer than members, which keeps every connection. A half shared by more than
``HOT`` distinct fingerprints is indexed once more by the quarters of the other half, in the same way, so no key gathers
more than what 16 bits can tell apart. Links become components by star contraction over written tables.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than a shingle
make one shingle of the whole; repeated rows are copies; null ids never name a component, and a component of null ids
only has a null name. An empty table gives an empty result. ``docs`` must be a table scan for ``place`` to mean a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import connected_components, python_ready, scanned, written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Distinct fingerprints of one half beyond which its keys are indexed once more.
HOT = 4096
#: Near copies: words of a shingle, and 64-bit words of a text's parity bitmap.
SHORT, BITMAP = 5, 4
#: The order of shingles: one text in so many is counted for it, occurrences there that make a shingle common, and common ones
#: listed at most (16 bytes each, broadcast). It decides how many candidates there are and never which copies are found.
ORDER_SHARE, COMMON, LISTED = 4, 4, 2_000_000
#: Buckets of a text's shingle counts, and candidate texts up to which their row ids are broadcast to the texts.
BUCKETS, FEW_TEXTS = 256, 200_000


def fingerprint_of(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8, as an unsigned number."""
    words = (raw or b"").lower().split()  # A-Z, and exactly the six white-space bytes, as bytes methods see them
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: Column, spark, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long."""
    python_ready(spark)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint_of(x, shingle) for x in batch], dtype=np.uint64).view(np.int64))

    return of(text.cast("binary"))


def _ball(half: Column, bits: int) -> Column:
    """The value itself and every value with one of its set bits cleared."""
    cleared = [F.when(half.bitwiseAND(F.lit(1 << b)) != 0, half.bitwiseAND(F.lit(~(1 << b)))) for b in range(bits)]
    return F.array_compact(F.array(half, *cleared))


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def keyed(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(seg, key, sub, subkey, fp): the table rows of every distinct ``fps(fp)``."""
    fp = F.col("fp")
    halves = [fps.select("fp", F.lit(k).alias("seg"), _half(fp, k).alias("half")) for k in (0, 1)]
    halved = halves[0].unionByName(halves[1])
    rows = halved.select("fp", "seg", F.explode(_ball(F.col("half"), 32)).alias("key"))
    plain = rows.select("seg", "key", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subkey"), "fp")
    crowded = written(halved.groupBy("seg", "half").count().where(F.col("count") > hot), "simhash-hot")
    if not crowded.limit(1).count():
        return plain
    keys = crowded.select("seg", F.explode(_ball(F.col("half"), 32)).alias("key")).distinct().withColumn("many", F.lit(True))
    marked = rows.join(keys, ["seg", "key"], "left")
    other = F.when(F.col("seg") == 0, _half(fp, 1)).otherwise(_half(fp, 0))
    deep = None
    for k in (0, 1):
        quarter = F.shiftrightunsigned(other, 16 * k).bitwiseAND(F.lit(0xFFFF))
        one = marked.where("many").select("seg", "key", F.lit(k + 1).alias("sub"), F.explode(_ball(quarter, 16)).alias("subkey"), "fp")
        deep = one if deep is None else deep.unionByName(one)
    return marked.where("many is null").select("seg", "key", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subkey"), "fp").unionByName(deep)


def forest(values: np.ndarray, nodes: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (u, v) arrays of nodes, of the links among nodes whose unsigned values are near."""
    us, vs = [], []
    left, names, queue = values[1:], nodes[1:], [(values[0], nodes[0])]
    while queue:
        value, name = queue.pop()
        near = np.bitwise_count(left ^ value) <= max_bits
        if near.any():
            us.append(np.full(int(near.sum()), name))
            vs.append(names[near])
            queue.extend(zip(left[near], names[near], strict=True))
            left, names = left[~near], names[~near]
        if not queue and len(left):
            queue.append((left[0], names[0]))
            left, names = left[1:], names[1:]
    empty = nodes[:0]
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def _linked(max_bits: int, names: list[str], value: str, node: str):
    """Reads rows sorted by the key columns ``names`` and gives each key's forest over ``node``, by distance of ``value``."""

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf[names].to_numpy()
        f, ids = pdf[value].to_numpy().view(np.uint64), pdf[node].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(f)]])
        size = ends - starts
        two = starts[size == 2]
        near = (np.bitwise_count(f[two] ^ f[two + 1]) <= max_bits) & (ids[two] != ids[two + 1])
        us, vs = [ids[two][near]], [ids[two + 1][near]]
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            own, first = np.unique(ids[s:e], return_index=True)
            u, v = forest(f[s:e][first], own, max_bits)
            us.append(u)
            vs.append(v)
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by key; the last run of a batch waits for its rest."""
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[names].iloc[-1].to_numpy()
            same = (pdf[names].to_numpy() == last).all(axis=1)
            begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if begin:
                yield runs(pd.concat([*rest, pdf.iloc[:begin]], ignore_index=True))
                rest = []
            elif rest and (rest[0][names].iloc[0].to_numpy() != last).any():
                yield runs(pd.concat(rest, ignore_index=True))
                rest = []
            rest.append(pdf.iloc[begin:])
        if rest:
            yield runs(pd.concat(rest, ignore_index=True))

    return of


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(u, v) links between distinct fingerprints that keep every connection at ``max_bits`` (3 at most) or fewer."""
    if max_bits > 3:
        raise ValueError("halves of 32 bits with balls of radius 1 find at most 3 differing bits")
    python_ready(fps.sparkSession)
    rows = keyed(fps, hot)
    dealt = rows.repartition("seg", "key", "sub", "subkey").sortWithinPartitions("seg", "key", "sub", "subkey")
    return dealt.mapInPandas(_linked(max_bits, ["seg", "key", "sub", "subkey"], "fp", "fp"), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """place, doc_id, fp, component, component_id of every row of ``docs(doc_id, text)``.

    ``component`` is the smallest linked fingerprint (signed), ``component_id`` the smallest id with a linked one.
    """
    docs = scanned(docs)
    rows = written(docs.select(F.monotonically_increasing_id().alias("place"), "doc_id",
                               fingerprint(F.col("text"), docs.sparkSession, shingle).alias("fp")), "simhash-docs")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    parts = connected_components(links(fps.select("fp"), max_bits), "simhash-links")
    of_fp = fps.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = written(of_fp.join(named, "component").select("fp", "component", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("place", "doc_id", "fp", "component", "component_id")


def shingles_of(raw: bytes | None) -> np.ndarray:
    """The distinct 5-word shingles of a text in UTF-8 as sorted 64-bit hashes; fewer than ``SHORT`` words are one shingle."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < SHORT else map(b" ".join, zip(*(words[k:] for k in range(SHORT)), strict=False))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(g) for g in grams), dtype=np.uint64))


def shingles(text: Column, spark) -> Column:
    """The distinct shingles of a text column as array of signed longs."""
    python_ready(spark)

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles_of(x).view(np.int64) for x in batch], dtype=object)

    return of(text.cast("binary"))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose shingle sets, read again at these places of ``docs``, have a similarity of 0.8 or more."""
    used = pairs.select(F.col("u").alias("place")).unionByName(pairs.select(F.col("v").alias("place"))).distinct()
    at = written(used, "copies-used")
    at = F.broadcast(at) if at.count() <= FEW_TEXTS else at
    texts = docs.select(F.monotonically_increasing_id().alias("place"), "text").join(at, "place")
    sets = written(texts.select("place", shingles(F.col("text"), docs.sparkSession).alias("s")), "copies-sets")
    sides = [sets.select(F.col("place").alias(end), F.col("s").alias(f"s{end}")) for end in ("u", "v")]
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(sides[0], "u").join(sides[1], "v").where(9 * both >= 4 * (F.size("su") + F.size("sv"))).select("u", "v")


def countable(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose bucket counts in ``stats(node, n, counts)`` allow a similarity of 0.8.

    The counts of two sets differ by no more in sum than the sets do in shingles, which is (n + m) / 9 at 0.8.
    """
    @F.pandas_udf("int")
    def apart(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, other in batches:
            a, b = (np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int32) for x in (one, other))
            yield pd.Series(np.abs(a - b).sum(axis=1, dtype=np.int32))

    sides = [stats.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("counts").alias(f"c{end}")) for end in ("u", "v")]
    held = pairs.join(sides[0], "u").join(sides[1], "v")
    return held.where(9 * apart("cu", "cv") <= F.col("nu") + F.col("nv")).select("u", "v")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """The commonest shingles of a fixed share of ``docs``, rarest first."""
    place = F.xxhash64(F.monotonically_increasing_id())
    sample = docs.select(F.when(F.pmod(place, F.lit(ORDER_SHARE)) == 0, F.col("text")).alias("text")).where("text is not null")
    counts = sample.select(F.explode(shingles(F.col("text"), docs.sparkSession)).alias("s")).groupBy("s").count().where(F.col("count") >= COMMON)
    listed = counts.orderBy(F.desc("count"), "s").limit(LISTED).toArrow()["s"].to_numpy()
    return listed[::-1].view(np.uint64)


_SIGNATURE = f"a long, b long, n int, {', '.join(f'b{k} long' for k in range(BITMAP))}, counts binary, fp long, keys array<long>"


def signature(text: Column, spark, common: np.ndarray) -> Column:
    """a, b, n, b0, b1, …, counts, fp, keys of a text column: a 128-bit name of its shingle set, the set's size, parity bitmap, bucket
    counts, SimHash fingerprint and prefix.

    The prefix is the n // 5 + 1 first shingles in an order of all: those not in ``common`` by hash, then ``common``.
    """
    python_ready(spark)
    order = np.argsort(common, kind="stable")
    known = common[order]
    shared = spark.sparkContext.broadcast((known, order))

    def one(raw: bytes | None) -> tuple:
        s = shingles_of(raw)
        known, order = shared.value
        rank = np.zeros(len(s), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            rank = np.where(known[at] == s, order[at] + 1, 0)
        held = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
        name = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
        bits = np.packbits((held & 1).astype(np.uint8)).view(np.int64)
        fp = np.array([majority(s)], dtype=np.uint64).view(np.int64)[0]
        return (*name, len(s), *bits, np.minimum(held, 255).astype(np.uint8).tobytes(), fp, s[np.argsort(rank, kind="stable")[: len(s) // 5 + 1]].view(np.int64))

    @F.pandas_udf(_SIGNATURE)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _SIGNATURE.split(", ")]
        for batch in batches:
            yield pd.DataFrame([one(raw) for raw in batch], columns=names).astype({c: "int64" for c in names if c not in ("counts", "keys", "n")})

    return of(text.cast("binary"))


def near_copies(docs: DataFrame) -> DataFrame:
    """place, doc_id, component of every row of ``docs(doc_id, text)``: groups of near copies at 5-word similarity 0.8.

    Two texts link if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more; components of links are
    groups, named by the place of their first text. Multi-index hashing over SimHash fingerprints of the sets finds the
    close ones; a fingerprint promises nothing about similarity, so its links are verified on the whole sets, and an
    exact join finds what it missed: two such sets share a shingle of their prefixes, which are the n // 5 + 1 first of n
    shingles in any order of all. Here the order is rare before common, so that passages that many texts hold bring few
    of them together. Candidates share a key that can be the first that they share (what is left of either set from
    there on must hold the overlap), are of sizes that allow 0.8, and differ in no more bits of parity bitmaps and bucket
    counts than their sets may differ in shingles; then the whole sets are compared.

    Texts of the same shingles (by a 128-bit name) are one node, so groups of copies are never expanded. For groups of
    near copies, each key first links its members with one of them, taken by a hash of key and node; after that only
    pairs of a key are compared whose nodes aren't connected yet. No other pair is left out.
    """
    spark = docs.sparkSession
    docs = scanned(docs)
    bits = [f"b{k}" for k in range(BITMAP)]
    seen = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", signature(F.col("text"), spark, common_shingles(docs)).alias("s"))
    rows = written(seen.select("place", "doc_id", "s.*"), "copies-docs")
    named = written(rows.groupBy("a", "b").agg(F.min("place").alias("node")), "copies-nodes")
    nodes = written(rows.join(named.select(F.col("node").alias("place")), "place", "left_semi").select(
        F.col("place").alias("node"), "n", *bits, "counts", "fp", "keys"), "copies-sets")

    keys = nodes.select("node", F.posexplode("keys").alias("pos", "key")).repartition("key")
    met = keys.groupBy("key").count().where(F.col("count") > 1).select("key")
    shared = keys.join(met, "key").withColumn("turn", F.xxhash64("key", "node"))
    shared = written(shared.join(nodes.select("node", "n", *bits), "node"), "copies-keys")

    def side(df: DataFrame, end: str) -> DataFrame:
        return df.select("key", *(F.col(c).alias(f"{end}_{c}") for c in df.columns if c != "key"))

    apart = sum((F.bit_count(F.col(f"u_{x}").bitwiseXOR(F.col(f"v_{x}"))) for x in bits), F.lit(0))
    total = F.col("u_n") + F.col("v_n")
    able = (5 * F.least("u_n", "v_n") >= 4 * F.greatest("u_n", "v_n")) & (9 * apart <= total) & (
        9 * F.least(F.col("u_n") - F.col("u_pos"), F.col("v_n") - F.col("v_pos")) >= 4 * total)
    pair = [F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")]
    first = shared.groupBy("key").agg(F.min("turn").alias("turn"))
    middle = side(shared.join(first, ["key", "turn"], "left_semi"), "u")
    stars = middle.join(side(shared, "v"), "key").where((F.col("u_node") != F.col("v_node")) & able).select(*pair)
    tried = written(stars.unionByName(fingerprint_pairs(nodes.select("node", "fp"))).distinct(), "copies-stars")
    near = written(verified(written(countable(tried, nodes), "copies-pairs"), docs), "copies-near")
    groups = connected_components(near, "copies-links").withColumnRenamed("node", "node_")
    parts = shared.join(groups, F.col("node") == F.col("node_"), "left").select("key", "node", "pos", "n", *bits, F.coalesce("component", "node").alias("part"))
    parts = written(parts, "copies-parts")
    open_ = parts.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    left = written(parts.join(open_, "key"), "copies-open")
    rest = side(left, "u").join(side(left, "v"), "key").where((F.col("u_node") < F.col("v_node")) & (F.col("u_part") != F.col("v_part")) & able)
    rest = written(rest.select(*pair).distinct().join(tried, ["u", "v"], "left_anti"), "copies-rest")
    rest = written(countable(rest, nodes), "copies-pairs")
    groups = connected_components(near.unionByName(verified(rest, docs)), "copies-all")
    of_name = named.join(groups.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select(
        "a", "b", F.coalesce("component", "node").alias("component"))
    return rows.join(of_name, ["a", "b"]).select("place", "doc_id", "component")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) pairs of ``nodes(node, fp)``: each with the first of its fingerprint, and the firsts of near fingerprints."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "copies-fps")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    ends = [firsts.select(F.col("fp").alias(f"{e}_fp"), F.col("first").alias(e)) for e in ("x", "y")]
    near = links(firsts.select("fp")).toDF("x_fp", "y_fp").join(ends[0], "x_fp").join(ends[1], "y_fp")
    return same.unionByName(near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))


def first_of_each(docs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one row of each, with their columns.

    ``parts`` is what ``near_duplicates`` (the default) or ``near_copies`` gives for ``docs``.
    """
    docs = scanned(docs)
    parts = near_duplicates(docs) if parts is None else parts
    best = parts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("best"))
    keep = best.select(F.col("best.place").alias("place_"))
    rows = docs.select(F.monotonically_increasing_id().alias("place_"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(keep, "place_", "left_semi").select("row.*")
