"""Quality: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

The document's own evidence is a logistic model over the shape of its text (character classes, repeated words and lines,
word lengths). Hosts, and paths below them, differ in how much of what they hold is good, so each site's rate is
estimated from the evidence of all its documents and shrunk toward its parent: a path toward its host, a host toward the
global rate, with strengths found from the data by moments. A document's odds are then moved from the global prior to
its path's posterior, which leaves the document itself out, so sparse sites change nothing.

Site rates are two grouped aggregates with map-side sums (a host with a third of all rows is only one more sum) and come
back by join on the site; nothing about sites reaches the driver but five sums.

Defined cases: a null or empty text has an empty shape and is scored as such; a null host or path is a site of its own;
with no labels to learn from every score is 1.0 and everything is kept. Rows with a null id are scored but never learned
from. Repeated rows are scored alike but for what their site says without the row itself. Ties don't arise: a score of
exactly 0.5 is kept. An empty table gives an empty result. Other columns, of whatever names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._fit import Logistic, fit_logistic
from ._util import held_out, learnable, python_ready, sampled_ids, scanned, written

#: Learning takes at most about so many labelled documents of each class.
DOCS_PER_CLASS = 1500
#: Evidence is kept away from certainty, so that a site can still move it.
LEAST_P = 1e-3
#: A parent counts as one document at least, so that a site of one document has a rate without it.
LEAST_STRENGTH = 1.0
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t",
    "line": b"\n\r", "stop": b".,;:'\"()-?", "bang": b"!", "pipe": b"|", "sign": b"#$%&*@^~=+<>{}[]\\_/`",
}


def shape(text: str | None) -> list[float]:
    """Features of a whole text; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * (len(CLASSES) + 7)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out = [float(np.sqrt(hist[np.frombuffer(c, dtype=np.uint8)].sum() / len(raw))) for c in CLASSES.values()]
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x]
    n = max(len(words), 1)
    out += [
        float(np.sqrt(hist[128:].sum() / len(raw))),
        float(np.sqrt(sum(map(eq, words, words[1:])) / n)),
        len(set(words)) / n,
        float(np.log1p(len(words))),
        min(len(raw) / n, 40.0),
        float(np.sqrt(1 - len(set(lines)) / max(len(lines), 1))),
        float(np.sqrt(len(lines) / n)),
    ]
    return out


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> Logistic | None:
    """Learns the document model from a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(learnable() & F.col("quality").isin(0, 1))
    shares = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    chosen = sampled_ids(known, "quality", docs_per_class)
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality")
    rows = sorted((r["doc_id"], r["quality"], shape(r["text"])) for r in sample.toLocalIterator())
    if not rows:
        return None
    x, y = np.array([r[2] for r in rows]), np.array([float(r[1]) for r in rows])
    total = sum(shares.values())
    weight = np.array([shares[int(k)] / total / max((y == k).mean(), 1e-9) for k in y])
    return fit_logistic(x, y, weight, ridge=0.3)


def evidence(model: Logistic | None, text: Column, spark) -> Column:
    """P(good) of a text column by the document model alone."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            if m is None or not len(batch):
                yield pd.Series(np.ones(len(batch)))
            else:
                yield pd.Series(m(np.array([shape(t) for t in batch])))

    return of(text)


def document_sites(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path of a document: the source up to its first slash, and its first folder or else its language section."""
    host = F.substring_index(source, "/", 1)
    path = F.when(F.instr(source, "/") > 0, F.substring_index(source, "/", 2)).otherwise(
        F.concat_ws("/", host, lang))
    return host, path


def site_priors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Sums by path with the host's, and the global rate, from ``scored(host, path, p)``.

    Returns (host, path, n, k, host_n, host_k, host_strength, path_strength) and the global mean: n documents with k
    good ones expected. Strengths are of the Beta priors, by moments: the spread of site means beyond what the documents
    in them explain. Sites that spread no more than that are as their parent (a strength without bound).
    """
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("k")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"))
    sums = hosts.agg(F.sum("host_n"), F.sum("host_k")).first()
    mean = min(max((sums[1] or 0.0) / max(sums[0] or 0, 1), LEAST_P), 1 - LEAST_P)

    def strength(table: DataFrame, n: str, k: str, parent: Column) -> float:
        gap = (F.col(k) / F.col(n) - parent) ** 2
        r = table.where(F.col(n) > 1).agg(F.count("*"), F.avg(gap), F.avg(1 / F.col(n))).first()
        between = (r[1] - mean * (1 - mean) * r[2]) if r[0] else 0.0
        return float(max(mean * (1 - mean) / max(between, 1e-12) - 1, LEAST_STRENGTH))

    of_host = strength(hosts, "host_n", "host_k", F.lit(mean))
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    of_path = strength(both, "n", "k", F.col("host_k") / F.col("host_n"))
    return both.select("*", F.lit(of_host).alias("host_strength"), F.lit(of_path).alias("path_strength")), mean


def with_posterior(rows: DataFrame, priors: DataFrame, mean: float) -> DataFrame:
    """Adds ``site_rate`` and ``posterior`` to ``rows(host, path, p, ...)``; keeps every row."""
    sites = priors.select(F.col("host").alias("h_"), F.col("path").alias("p_"), "n", "k", "host_n", "host_k", "host_strength", "path_strength")
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("h_")) & F.col("path").eqNullSafe(F.col("p_")), "left")
    own = F.col("p")
    host_rate = (F.col("host_k") - own + F.col("host_strength") * mean) / (F.col("host_n") - 1 + F.col("host_strength"))
    rate = (F.col("k") - own + F.col("path_strength") * host_rate) / (F.col("n") - 1 + F.col("path_strength"))
    rate = F.least(F.greatest(rate, F.lit(LEAST_P)), F.lit(1 - LEAST_P))

    def logit(c: Column) -> Column:
        return F.log(c / (1 - c))

    p = F.least(F.greatest(own, F.lit(LEAST_P)), F.lit(1 - LEAST_P))
    z = logit(p) + logit(F.col("site_rate")) - logit(F.lit(mean))
    return joined.withColumn("site_rate", rate).withColumn("posterior", 1 / (1 + F.exp(-z))).drop(
        "h_", "p_", "n", "k", "host_n", "host_k", "host_strength", "path_strength")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source)``: place, doc_id, held_out, evidence, site_rate, score, keep.

    A document is kept at a score of 0.5 or more. Texts are read once for their evidence; all that follows is narrow.
    """
    docs = scanned(docs)
    model = fit(docs, labels)
    host, path = document_sites(F.col("source"), F.col("lang"))
    rows = written(docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", host.alias("host"), path.alias("path"),
                               evidence(model, F.col("text"), docs.sparkSession).alias("p")), "quality-evidence")
    priors, mean = site_priors(rows)
    out = with_posterior(rows, priors, mean)
    score = F.lit(1.0) if model is None else F.col("posterior")
    return out.select("place", "doc_id", held_out().alias("held_out"), F.col("p").alias("evidence"), "site_rate", score.alias("score"), (score >= 0.5).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    docs = scanned(docs)
    kept = classify(docs, labels).where("keep").select(F.col("place").alias("place_"))
    rows = docs.select(F.monotonically_increasing_id().alias("place_"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(kept, "place_", "left_semi").select("row.*")
