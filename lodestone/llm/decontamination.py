"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed; of every window of 10 words (6 consecutive 5-grams) the rightmost smallest 5-gram hash is kept, with
its place. Two texts that share 10 consecutive words keep the same 5-gram there, so the join of document and item
fingerprints misses no shared window. Each hit is then extended word by word, up to 5 words either side of the 5-gram:
if that gives a run of 10 or more, its words are hit, and longer shared passages are the union of such runs. An item of
fewer than 10 words is a window of its own length, looked for as a whole.

Plan: one pass over the text with no shuffle. Positions are generated and hashed in generated code; the fingerprint
table of the benchmark is broadcast if it is counted to be at most ``BROADCAST_ROWS`` rows and else joined by shuffle;
hits are few and narrow, are summed by row, and meet the documents' word counts by row id. Nothing is collected.

Defined cases: a null text has no words and no windows; so has an empty one. Repeated items are one item, repeated
documents are rows of their own, null item ids hit words but are not counted as items. An empty benchmark hits nothing,
an empty table of documents gives an empty result. Ties of smallest hashes keep the rightmost. Columns of other names,
also such as ``words`` or ``place``, are never read. Documents that are no plain table scan are written first, so that
row ids hold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import scanned

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
#: k-grams in a window, and words on either side of a k-gram that a window around it can reach.
GRAMS = WINDOW - K + 1
SIDE = WINDOW - K
#: Fingerprint rows (each about 300 bytes at most) up to which the benchmark's table is broadcast.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text, empty for null."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    parts = F.split(low, SEPARATORS)
    # Only the first and the last part can be empty; both are the same where there is but one.
    lead = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, lead + 1, F.size(parts) - lead - tail)


def _gram_hashes(words: str, n: int) -> Column:
    """Hashes of all runs of ``n`` words; null for a shorter text."""
    grams = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(grams, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(n)))))


def _context(words: str, at: Column) -> Column:
    """The words from SIDE before to SIDE after the k-gram at ``at``; null beyond the text."""
    return F.array(*(F.get(words, (at + j).cast("int")) for j in range(-SIDE, K + SIDE)))


def winnowed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., at, fp, context) of every fingerprint of ``rows(keep..., words)``; ``at`` is the k-gram's first word."""
    hashed = rows.select(*keep, "words", F.when(F.size("words") >= WINDOW, _gram_hashes("words", K)).alias("hashes"))
    placed = hashed.select(*keep, "words", "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - GRAMS)).alias("i"))
    i = F.col("i")
    # The id times 0 holds the optimizer from pushing the filter below, where it would read every gram several times.
    # Code must stay small here: a generated method of over 8000 bytes of bytecode is never compiled by the JVM.
    grams = placed.select(*keep, "words", (i + F.monotonically_increasing_id() * 0).alias("i"), F.get("hashes", i - 1).alias("g_before"),
                          *(F.get("hashes", i + t).alias(f"g{t}") for t in range(GRAMS)))
    low = grams.withColumn("fp", F.least(*(F.col(f"g{t}") for t in range(GRAMS))))
    fresh = low.where((i == 0) | (F.col(f"g{GRAMS - 1}") == F.col("fp")) | (F.col("g_before") < F.col("fp")))
    offset = F.lit(0)
    for t in range(1, GRAMS):
        offset = F.when(F.col(f"g{t}") == F.col("fp"), t).otherwise(offset)
    at = fresh.select(*keep, "words", "fp", (i + offset).alias("at"))
    return at.select(*keep, "at", "fp", _context("words", F.col("at")).alias("context"))


def short_windows(rows: DataFrame, keep: list[str], n: int) -> DataFrame:
    """(keep..., at, fp, context) of every run of ``n`` words, n below WINDOW; context is the run."""
    hashed = rows.select(*keep, "words", _gram_hashes("words", n).alias("hashes"))
    return hashed.select(*keep, "words", F.posexplode("hashes").alias("at", "fp")).select(
        *keep, "at", "fp", F.slice("words", F.col("at") + 1, n).alias("context"))


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _item_side(table: DataFrame) -> DataFrame:
    return table.select(F.col("item_id").alias("item"), F.col("fp").alias("fp_"), F.col("context").alias("theirs"))


def hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(place, start, end, item) runs of hit words [start, end) of ``rows(place, words)``, whole shared windows each."""
    theirs = _sized(_item_side(winnowed(items.where(F.size("words") >= WINDOW), ["item_id"])).distinct())
    # As above, the id times 0 keeps the comparison of words out of the join's own code.
    found = winnowed(rows, ["place"]).join(theirs, F.col("fp") == F.col("fp_")).select(
        "place", "item", (F.col("at") + F.monotonically_increasing_id() * 0).alias("at"), "context", "theirs")

    alike = F.array_join(F.zip_with("context", "theirs", lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    compared = found.select("place", "item", "at", alike.alias("alike")).where(F.substring("alike", SIDE + 1, K) == "1" * K)
    left = F.length(F.regexp_extract(F.substring("alike", 1, SIDE), "1*$", 0))
    right = F.length(F.regexp_extract(F.substring("alike", SIDE + K + 1, SIDE), "^1*", 0))
    spans = compared.select("place", "item", "at", left.alias("l"), right.alias("r")).where(F.col("l") + F.col("r") + K >= WINDOW)
    out = spans.select("place", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + K + F.col("r")).alias("end"), "item")
    short = items.where((F.size("words") > 0) & (F.size("words") < WINDOW))
    for (n,) in short.select(F.size("words")).distinct().collect():  # nine values at most
        whole = _sized(_item_side(short_windows(short.where(F.size("words") == n), ["item_id"], n)).distinct())
        at = short_windows(rows, ["place"], n).join(whole, (F.col("fp") == F.col("fp_")) & (F.col("context") == F.col("theirs")))
        out = out.unionByName(at.select("place", F.col("at").alias("start"), (F.col("at") + n).alias("end"), "item"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """place, doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs(doc_id, text)``."""
    docs = scanned(docs)
    place = F.monotonically_increasing_id().alias("place")
    # Row id and words in one step: no filter on the words is pushed below it, so texts are split once.
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    rows = docs.select(place, words_of(F.col("text")).alias("words"))
    by_row = hits(rows, items).groupBy("place").agg(F.collect_set(F.struct("start", "end")).alias("runs"), F.collect_set("item").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - 1)))))
    summed = by_row.select("place", covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    counted = docs.select(place, "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(summed, "place", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return out.select("place", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their columns."""
    docs = scanned(docs)
    place = F.monotonically_increasing_id().alias("place_")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    rows = docs.select(F.monotonically_increasing_id().alias("place"), words_of(F.col("text")).alias("words"))
    dirty = hits(rows, items).select(F.col("place").alias("place_")).distinct()
    every = docs.select(place, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return every.join(dirty, "place_", "left_anti").select("row.*")


#: DuckDB twin: exact 10-word windows, without fingerprints.
ORACLE = r"""
with d as (select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, l, array_to_string(w[i : i + l - 1], ' ') as win
       from (select item_id, w, least(len(w), 10) as l, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
ls as (select distinct l from bw),
dw as (select rid, l, i, array_to_string(w[i : i + l - 1], ' ') as win
       from (select rid, w, l, unnest(range(1, len(w) - l + 2)) as i from d, ls where len(w) >= l)),
h as (select rid, i, dw.l, item_id from dw join bw on dw.l = bw.l and dw.win = bw.win),
words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + l)) as p from h) group by rid),
its as (select rid, count(*) as n_items, string_agg(s, ',' order by s) as listed from (select distinct rid, cast(item_id as varchar) as s from h) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (rid) left join its using (rid)
"""
