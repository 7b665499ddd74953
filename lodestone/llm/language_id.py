"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and cut into code-point n-grams of 1 to 3 characters, each hashed into one of ``N_BUCKETS`` rows of
a log-probability matrix (buckets x languages). The matrix is of fixed size (4 MB for 16 languages), broadcast, and a
batch is scored by numpy: gather the rows of all n-grams of the batch's texts, then sum them by text.

The prior P(language) is of all rows that may be learned from; only the n-gram counts come from the sample.

Defined cases: a null text, or one with no letter, is ``und`` with score 0.0; so is every text if nothing could be
learned. Ties go to the language that sorts first. Repeated rows are scored alike, each on its own. Rows with a null id
are scored but never learned from. Whole texts are scored, in pieces where they are long. An empty table gives an empty
result; columns of other names, also such as ``lang_pred`` or ``score``, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import bounded_sample, class_counts, held_out, learnable, python_ready

N_BUCKETS = 1 << 16
#: Learning takes about so many rows of each language at most; a rarer language is taken whole.
ROWS_PER_LANGUAGE = 400
#: Texts of a batch are joined up to so many code points before they are scored together.
CHUNK = 1 << 20


def ngram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Hash buckets of the 1-, 2- and 3-grams that start at each code point (shorter by 0, 1 and 2 entries)."""
    c = codes.astype(np.uint64)
    mask = np.uint64(N_BUCKETS - 1)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = x * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(40)) & mask).astype(np.int64)

    one = c + np.uint64(1)
    two = one[:-1] * np.uint64(1 << 21) + one[1:] if len(c) > 1 else one[:0]
    three = two[:-1] * np.uint64(0x100000001B3) + one[2:] if len(c) > 2 else one[:0]
    return [mixed(one), mixed(two), mixed(three)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Model:
    """Languages in sorted order, log P(bucket | language) and log P(language)."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.langs, self.logp, self.prior = langs, logp, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        """Joint log-probability of each text and language; a text is never cut."""
        out = np.tile(self.prior, (len(texts), 1))
        k = at = 0
        while k < len(texts):
            parts, owner, size = [], [], 0
            while k < len(texts) and size < CHUNK:
                codes = _codes(texts[k])
                piece = codes[at : at + CHUNK + 2]  # two more, for the n-grams that start before the piece's end
                for part in ngram_buckets(piece):
                    part = part[:CHUNK]
                    if len(part):
                        parts.append(part)
                        owner.append(k)
                size += len(piece)
                at += CHUNK
                if at >= len(codes):
                    k, at = k + 1, 0
            if parts:
                starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                flat = np.concatenate(parts)
                for j in range(len(self.langs)):
                    np.add.at(out[:, j], owner, np.add.reduceat(self.logp[j][flat], starts))
        return out


def train(rows: Iterator[tuple[str, str]], alpha: float = 0.05, prior: dict[str, int] | None = None) -> Model:
    """Fits a model from (text, language) rows, as an iterator that is read once.

    ``prior`` has the rows of each language where ``rows`` are only a sample of them.
    """
    counts: dict[str, np.ndarray] = {}
    n: dict[str, int] = {}
    for text, lang in rows:
        if text is None or lang is None:
            continue
        have = counts.setdefault(lang, np.zeros(N_BUCKETS))
        n[lang] = n.get(lang, 0) + 1
        for part in ngram_buckets(_codes(text)):
            have += np.bincount(part, minlength=N_BUCKETS)
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, N_BUCKETS)), np.zeros(0))
    c = np.array([counts[x] for x in langs]) + alpha
    n = {x: (prior or n).get(x, n[x]) for x in langs}
    total = sum(n.values())
    return Model(langs, np.log(c / c.sum(axis=1, keepdims=True)), np.log(np.array([n[x] / total for x in langs])))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from a bounded sample of the labelled rows outside the held-out fold, streamed to the driver."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = class_counts(known, "lang")
    sample = bounded_sample(known, "lang", rows_per_language, F.col("doc_id"), counts).select("text", "lang")
    prior = {r["class_"]: r["rows_"] for r in counts.toLocalIterator()}  # a row for each language, as the model has
    return train(((r["text"], r["lang"]) for r in sample.toLocalIterator()), prior=prior)


def predict(model: Model, text: Column, spark) -> Column:
    """struct(lang string, score double) of a text column; the score is the posterior of the language given."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = list(batch)
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            live = [i for i, t in enumerate(texts) if m.langs and t is not None and any(map(str.isalpha, t))]
            if live:
                s = m.scores([texts[i] for i in live])
                best = s.argmax(axis=1)
                odds = 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, o in zip(live, best, odds, strict=True):
                    lang[i], score[i] = m.langs[b], o
            yield pd.DataFrame({"lang": lang, "score": score})

    return of(text)


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs(doc_id, text, lang)``."""
    model = model or fit(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), predict(model, F.col("text"), docs.sparkSession).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
