"""Toxicity: a two-state linear-chain conditional random field over words.

A word's emission is the sum of hashed weights of the word and of its prefixes; a 2x2 transition matrix links neighbours.
The corpus has only document labels, so the training tokens are labelled from them: a word is labelled toxic in a toxic
document if it, or one of its prefixes, is found in at least ``MIN_RATIO`` times the share of toxic documents as of
clean ones, and in enough distinct toxic texts (copies of one text count once). Forward-backward gives each word the
marginal probability of the toxic state; a small logistic model over the marginals' sum, mean, maximum and the length
gives the document score, and runs of words at 0.5 or more are the offending spans.

Whole texts are scored, whatever their length, in memory that follows the longest text. Defined cases: a null or empty
text has no words and gets the score of a document without toxic words; if no labels can be learned from, every score
is 0.0. Rows with a null id are scored but never learned from. Repeated rows are scored alike, each on its own. A score
of exactly 0.5 is toxic. An empty table gives an empty result; columns of other names, also such as ``score``, are never
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._fit import Logistic, fit_logistic
from ._util import held_out, learnable, python_ready, sampled_ids

WORD = re.compile(r"\w+")
N_WEIGHTS = 1 << 18
#: Learning takes at most about so many labelled documents of each class.
DOCS_PER_CLASS = 1000
#: Training sequences are runs of up to so many words.
SEQUENCE = 64
#: Words of a block of a long sequence, and of a group of texts that is scored at once.
BLOCK, WORDS = 256, 200_000
MIN_RATIO = 8.0
MEMO = 400_000


def features(word: str) -> list[str]:
    """The word and its prefixes of 3 to 8 characters."""
    w = word.lower()
    return [w, *("^" + w[:k] for k in range(3, min(len(w), 9)))]


def _slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (N_WEIGHTS - 1) for f in features(word)]


class Layout:
    """Sequences of words laid out by time: the words at position t of all sequences that are so long lie together."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max()) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        self.start = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        position = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.index = self.start[position] + np.repeat(rank, lengths)  # place of each word, in text order
        self.rank = rank  # of each sequence among those that are laid out, longest first


def marginals(emission: np.ndarray, lay: Layout, trans: np.ndarray, begin: np.ndarray):
    """P(toxic) of each place of the layout, and the expected transition and first-state counts.

    ``emission`` is the score of the toxic state at each place; ``trans`` and ``begin`` are log-weights.
    """
    up = np.exp(emission.clip(-30, 30))
    m = np.exp(trans)
    b = np.exp(begin)
    a0, a1 = np.empty_like(up), np.empty_like(up)
    b0, b1 = np.ones_like(up), np.ones_like(up)
    steps = len(lay.active)
    for t in range(steps):
        s, n = lay.start[t], lay.active[t]
        if t == 0:
            x0, x1 = np.full(n, b[0]), np.full(n, b[1])
        else:
            p = lay.start[t - 1]
            q0, q1 = a0[p : p + n], a1[p : p + n]
            x0, x1 = q0 * m[0, 0] + q1 * m[1, 0], q0 * m[0, 1] + q1 * m[1, 1]
        x1 = x1 * up[s : s + n]
        norm = x0 + x1
        a0[s : s + n], a1[s : s + n] = x0 / norm, x1 / norm
    for t in range(steps - 2, -1, -1):
        s, p, n = lay.start[t + 1], lay.start[t], lay.active[t + 1]
        y0, y1 = b0[s : s + n], b1[s : s + n] * up[s : s + n]
        x0, x1 = m[0, 0] * y0 + m[0, 1] * y1, m[1, 0] * y0 + m[1, 1] * y1
        norm = x0 + x1
        b0[p : p + n], b1[p : p + n] = x0 / norm, x1 / norm
    toxic = a1 * b1 / (a0 * b0 + a1 * b1)
    return toxic, (a0, a1, b0, b1, up, m)


def long_marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, begin: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """P(toxic) of every word of sequences of any length, exactly, in steps of at most ``block``.

    Sequences are cut into blocks. A block's transfer matrix carries any incoming state over it; the matrices link the
    blocks of a sequence from both ends, and then all blocks run forward and backward at once from the right states.
    """
    n_blocks = -(-lengths // block)
    ends = np.cumsum(n_blocks) - 1
    sizes = np.full(int(n_blocks.sum()), block, dtype=np.int64)
    some = lengths > 0
    sizes[ends[some]] = (lengths - (n_blocks - 1) * block)[some]
    first = ends - n_blocks + 1
    lay = Layout(sizes)
    up = np.empty(int(lengths.sum()))
    up[lay.index] = np.exp(emission.clip(-30, 30))
    m = np.exp(trans)
    steps = len(lay.active)
    # Rows of the transfer matrices, in the layout's order: from an incoming clean and an incoming toxic state.
    t0, t1 = np.stack([np.ones(len(sizes)), np.zeros(len(sizes))]), np.stack([np.zeros(len(sizes)), up[: len(sizes)]])
    for t in range(1, steps):
        s, n = lay.start[t], lay.active[t]
        p, q = t0[:, :n], t1[:, :n]
        x = np.stack([p[0] * m[0, 0] + p[1] * m[1, 0], (p[0] * m[0, 1] + p[1] * m[1, 1]) * up[s : s + n]])
        y = np.stack([q[0] * m[0, 0] + q[1] * m[1, 0], (q[0] * m[0, 1] + q[1] * m[1, 1]) * up[s : s + n]])
        norm = (x + y).sum(axis=0)
        t0[:, :n], t1[:, :n] = x / norm, y / norm
    carry = np.stack([t0[:, lay.rank], t1[:, lay.rank]])  # [incoming, outgoing, block]
    into, after = np.empty((2, len(sizes))), np.ones((2, len(sizes)))
    into[:, first[some]] = np.exp(begin)[:, None]
    most = int(n_blocks.max(initial=0))
    for k in range(1, most):
        at = first[n_blocks > k] + k
        last = np.einsum("ib,iob->ob", into[:, at - 1], carry[:, :, at - 1])
        nxt = np.einsum("ob,op->pb", last, m)
        into[:, at] = nxt / nxt.sum(axis=0)
    for k in range(most - 1, 0, -1):
        at = first[n_blocks > k] + k
        held = np.einsum("iob,ob->ib", carry[:, :, at], after[:, at])
        back = np.einsum("op,pb->ob", m, held)
        after[:, at - 1] = back / back.sum(axis=0)
    order = np.empty_like(lay.rank)
    order[lay.rank] = np.arange(len(order))
    into, after = into[:, order], after[:, order]
    a0, a1 = np.empty_like(up), np.empty_like(up)
    for t in range(steps):
        s, n = lay.start[t], lay.active[t]
        if t == 0:
            x0, x1 = into[0], into[1]
        else:
            p = lay.start[t - 1]
            q0, q1 = a0[p : p + n], a1[p : p + n]
            x0, x1 = q0 * m[0, 0] + q1 * m[1, 0], q0 * m[0, 1] + q1 * m[1, 1]
        x1 = x1 * up[s : s + n]
        norm = x0 + x1
        a0[s : s + n], a1[s : s + n] = x0 / norm, x1 / norm
    toxic = np.empty_like(up)
    y0 = y1 = np.empty(0)
    for t in range(steps - 1, -1, -1):
        s, n = lay.start[t], lay.active[t]
        x0, x1 = after[0, :n].copy(), after[1, :n].copy()
        k = len(y0)
        if k:  # blocks that go on
            nxt = lay.start[t + 1]
            z1 = y1 * up[nxt : nxt + k]
            b0, b1 = m[0, 0] * y0 + m[0, 1] * z1, m[1, 0] * y0 + m[1, 1] * z1
            x0[:k], x1[:k] = b0 / (b0 + b1), b1 / (b0 + b1)
        f0, f1 = a0[s : s + n] * x0, a1[s : s + n] * x1
        toxic[s : s + n] = f1 / (f0 + f1)
        y0, y1 = x0, x1
    return toxic[lay.index]


def expected_transitions(lay: Layout, inner) -> np.ndarray:
    a0, a1, b0, b1, up, m = inner
    total = np.zeros((2, 2))
    for t in range(len(lay.active) - 1):
        s, p, n = lay.start[t + 1], lay.start[t], lay.active[t + 1]
        x = np.stack([a0[p : p + n], a1[p : p + n]])
        y = np.stack([b0[s : s + n], b1[s : s + n] * up[s : s + n]])
        pair = x[:, None, :] * m[:, :, None] * y[None, :, :]
        total += (pair / pair.sum(axis=(0, 1))).sum(axis=2)
    return total


class Crf:
    """Hashed emission weights, transitions, and the logistic model that turns marginals into a document score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, begin: np.ndarray, bias: float):
        self.weights, self.trans, self.begin, self.bias = weights, trans, begin, bias
        self.document: Logistic | None = None
        self._memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def emission(self, word: str) -> float:
        return float(self.weights[_slots(word)].sum()) + self.bias

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of every word of every text, by groups of texts of about ``WORDS`` words."""
        memo, flat, held, out = self._memo, [], 0, []
        for k, text in enumerate(texts):
            if len(memo) > MEMO:
                memo.clear()
            words = WORD.findall(text)
            for w in words:
                if w not in memo:
                    memo[w] = self.emission(w)
            flat.append(np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words)))
            held += len(words)
            if held >= WORDS or k == len(texts) - 1:
                n = np.array([len(f) for f in flat], dtype=np.int64)
                toxic = long_marginals(np.concatenate(flat), n, self.trans, self.begin) if held else np.zeros(0)
                out += np.split(toxic, np.cumsum(n)[:-1])
                flat, held = [], 0
        return out

    @staticmethod
    def summary(p: np.ndarray) -> list[float]:
        if not len(p):
            return [0.0, 0.0, 0.0, 0.0, 0.0]
        total, most = float(p.sum()), np.sort(p)[::-1][:3]
        return [np.log1p(total), float(most[0]), float(most[1:].sum()), np.sqrt(total / len(p)), np.log1p(len(p))]

    def scores(self, tagged: list[np.ndarray]) -> np.ndarray:
        if self.document is None:
            return np.zeros(len(tagged))
        return self.document(np.array([self.summary(p) for p in tagged]))


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) code-point offsets of the runs of words whose marginal is at least ``least``."""
    out: list[tuple[int, int]] = []
    before = -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= least:
            if i == before + 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
            before = i
    return out


def weak_lexicon(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features that mark toxic documents, from (words, label) rows; copies of a text count once."""
    seen: set[tuple[int, int]] = set()
    found = (Counter(), Counter())
    n = [0, 0]
    for words, toxic in docs:
        grams = [zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(len(words) - 2)]
        if grams:
            g = np.array(grams, dtype=np.uint64)
            marks = [(j, int(((g * np.uint64(2 * j + 2654435761)) & np.uint64(0xFFFFFFFF)).min())) for j in range(4)]
            if any(x in seen for x in marks):
                continue
            seen.update(marks)
        n[toxic] += 1
        found[toxic].update({f for w in set(words) for f in features(w)})
    least = max(5, n[1] // 50)
    return {f for f, k in found[1].items() if k >= least
            and (k + 0.5) / (n[1] + 1) >= MIN_RATIO * (found[0][f] + 0.5) / (n[0] + 1)}


def train(rows: list[tuple[str, int]], class_share: dict[int, float] | None = None, steps: int = 60) -> Crf:
    """Fits the field and the document model from (text, label) rows.

    ``class_share`` is each class's share among all labelled rows: it undoes the sample's even classes.
    """
    docs = [(WORD.findall(text or ""), int(label)) for text, label in rows]
    model = Crf(np.zeros(N_WEIGHTS), np.zeros((2, 2)), np.zeros(2), -4.0)
    if len({label for _, label in docs}) < 2:
        return model
    marked = weak_lexicon(docs)
    ids: dict[str, int] = {}
    token_ids, labels, lengths = [], [], []
    for words, toxic in docs:
        at = [ids.setdefault(w, len(ids)) for w in words]
        for k in range(0, len(at), SEQUENCE):
            part = at[k : k + SEQUENCE]
            token_ids.append(np.array(part))
            lengths.append(len(part))
            labels.append(np.full(len(part), toxic, dtype=np.float64))
    word_marked = np.array([any(f in marked for f in features(w)) for w in ids], dtype=np.float64)
    slots = [_slots(w) for w in ids]
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    flat_slots = np.array([x for s in slots for x in s])
    n = np.array(lengths, dtype=np.int64)
    lay = Layout(n)
    tokens = np.empty(int(n.sum()), dtype=np.int64)
    tokens[lay.index] = np.concatenate(token_ids)
    truth = np.empty(len(tokens))
    truth[lay.index] = np.concatenate(labels)
    truth *= word_marked[tokens]
    seen_trans = np.zeros((2, 2))
    for t in range(len(lay.active) - 1):
        s, p, k = lay.start[t + 1], lay.start[t], lay.active[t + 1]
        x, y = truth[p : p + k], truth[s : s + k]
        seen_trans += [[((1 - x) * (1 - y)).sum(), ((1 - x) * y).sum()], [(x * (1 - y)).sum(), (x * y).sum()]]
    first = truth[: lay.active[0]]
    seen_first = np.array([(1 - first).sum(), first.sum()])
    gram = {k: np.zeros_like(v) for k, v in (("w", model.weights), ("t", model.trans), ("b", model.begin))}
    gram["c"] = np.zeros(1)
    for _ in range(steps):
        per_word = np.bincount(owner, weights=model.weights[flat_slots], minlength=len(slots)) + model.bias
        toxic, inner = marginals(per_word[tokens], lay, model.trans, model.begin)
        gap = toxic - truth
        by_word = np.bincount(tokens, weights=gap, minlength=len(slots))
        grad = {
            "w": np.bincount(flat_slots, weights=by_word[owner], minlength=N_WEIGHTS) + 0.05 * model.weights,
            "t": expected_transitions(lay, inner) - seen_trans + 0.05 * model.trans,
            "b": np.array([(1 - toxic[: lay.active[0]]).sum(), toxic[: lay.active[0]].sum()]) - seen_first + 0.05 * model.begin,
            "c": np.array([gap.sum()]),
        }
        for k, g in grad.items():
            gram[k] += g * g
            step = 0.5 * g / np.sqrt(gram[k] + 1e-8)
            if k == "w":
                model.weights -= step
            elif k == "t":
                model.trans -= step
            elif k == "b":
                model.begin -= step
            else:
                model.bias -= float(step[0])
    y = np.array([label for _, label in docs], dtype=np.float64)
    share = class_share or {0: float((y == 0).mean()), 1: float((y == 1).mean())}
    weight = np.where(y == 1, share[1] / max((y == 1).mean(), 1e-9), share[0] / max((y == 0).mean(), 1e-9))
    x = []
    for k in range(0, len(rows), 512):
        x += [model.summary(p) for p in model.tag([t or "" for t, _ in rows[k : k + 512]])]
    model.document = fit_logistic(np.array(x), y, weight, ridge=0.1)
    return model


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> Crf:
    """Learns from a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learnable() & F.col("toxic").isin(0, 1))
    shares = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    total = sum(shares.values()) or 1
    chosen = sampled_ids(known, "toxic", docs_per_class)
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")
    rows = sorted(((r["doc_id"], r["text"] or "", r["toxic"]) for r in sample.toLocalIterator()))
    return train([(t, y) for _, t, y in rows], {k: shares.get(k, 0) / total for k in (0, 1)})


def score(model: Crf, text: Column, spark) -> Column:
    """struct(score double, toxic_words int, offsets array<array<int>>) of a text column."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, toxic_words int, offsets array<array<int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch]
            tagged = m.tag(texts)
            found = [[list(s) for s in spans(t, p)] if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, tagged, strict=True)]
            yield pd.DataFrame({"score": m.scores(tagged), "toxic_words": [int((p >= 0.5).sum()) for p in tagged], "offsets": found})

    return of(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words, offsets of every row of ``docs(doc_id, text)``."""
    model = model or fit(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(model, F.col("text"), docs.sparkSession).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.score").alias("score"), (F.col("p.score") >= 0.5).cast("int").alias("predicted"),
                       F.col("p.toxic_words").alias("toxic_words"), F.col("p.offsets").alias("offsets"))
