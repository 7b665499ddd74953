"""Learned operators: held-out accuracy, defined cases, forward-backward against enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, quality, toxicity
from lodestone.llm._fit import fit_logistic

from .conftest import ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_on_held_out_documents(docs):
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[0] > 0.98 and r[1] > 100


def test_language_scores_equal_naive_sums():
    m = language_id.train([("abab ba", "x"), ("cdcd dc", "y"), ("abcd", "x")])
    for text in ("abab", "dcdc cd", "a", "é"):
        codes = language_id._codes(text)
        want = [m.prior[j] + sum(m.logp[j][b] for part in language_id.ngram_buckets(codes) for b in part) for j in range(2)]
        assert np.allclose(m.scores([text])[0], want)
    assert m.langs[int(m.scores(["abab"])[0].argmax())] == "x"


def test_language_defined_cases(odd, empty, clashing, table):
    for df in (odd, clashing):
        rows = language_id.identify_languages(df).collect()
        assert len(rows) == len(ODD)
        by = {r.doc_id: r for r in rows}
        assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (2, 3, 4)) and by[5].lang_pred == by[6].lang_pred
    assert language_id.identify_languages(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_languages(unlabelled).collect()} == {"und"}


def test_toxicity_on_held_out_documents(docs, marks):
    got = toxicity.score_toxicity(docs, marks).join(marks, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert np.mean([r.toxic == r.predicted for r in got]) > 0.9


def test_toxic_spans_name_the_words(docs, marks):
    rows = toxicity.score_toxicity(docs, marks).where("predicted = 1").join(docs.select("doc_id", "text"), "doc_id").limit(20).collect()
    words = {r.text[a:b].lower() for r in rows for a, b in r.offsets}
    assert rows and any(w in {"idiot", "moron", "stupid", "trash", "loser"} for x in words for w in x.split())


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    trans, begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([3, 1, 5, 0, 4])
    lay = toxicity.Layout(lengths)
    e = rng.normal(size=int(lengths.sum()))
    placed = np.empty_like(e)
    placed[lay.index] = e
    got, inner = toxicity.marginals(placed, lay, trans, begin)
    got = got[lay.index]
    at, pairs = 0, np.zeros((2, 2))
    for n in lengths:
        total, sums, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            if not y:
                continue
            w = np.exp(begin[y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(e[at + k] for k in range(n) if y[k]))
            total += w
            sums += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                own[a, b] += w
        if n:
            assert np.allclose(got[at : at + n], sums / total)
            pairs += own / total
        at += n
    assert np.allclose(toxicity.expected_transitions(lay, inner), pairs)


def test_toxicity_defined_cases(odd, empty, clashing, labels, no_labels):
    for df in (odd, clashing):
        rows = toxicity.score_toxicity(df, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score_toxicity(odd, no_labels).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_quality_on_held_out_documents(docs, marks):
    got = quality.classify(docs, marks).join(marks, "doc_id").where("held_out").select("quality", "keep").collect()
    assert np.mean([bool(r.quality) == r.keep for r in got]) > 0.95


def test_site_posterior_equals_its_formula(spark, table):
    rows = [("h1", "h1/a", 0.9)] * 30 + [("h1", "h1/b", 0.2)] * 3 + [("h2", "h2/a", 0.3)] * 20 + [("h3", "h3/a", 0.5)] + [(None, None, 0.6)]
    df = table(rows, "host string, path string, p double")
    priors, mean = quality.site_priors(df)
    assert abs(mean - np.mean([r[2] for r in rows])) < 1e-9
    got = quality.with_posterior(df, priors, mean).collect()
    assert len(got) == len(rows)
    s = priors.first()
    host = lambda h, p: (sum(r[2] for r in rows if r[0] == h) - p + s.host_strength * mean) / (sum(r[0] == h for r in rows) - 1 + s.host_strength)
    for g in got:
        n, k = sum(r[1] == g.path for r in rows), sum(r[2] for r in rows if r[1] == g.path)
        assert abs(g.site_rate - (k - g.p + s.path_strength * host(g.host, g.p)) / (n - 1 + s.path_strength)) < 1e-9
    by = {g.path: g.posterior for g in got}
    assert by["h1/a"] > 0.9 and by["h3/a"] == pytest.approx(0.5, abs=1e-6)  # a site of one document changes nothing


def test_quality_defined_cases(odd, empty, clashing, labels, no_labels):
    for df in (odd, clashing):
        assert quality.classify(df, labels).count() == len(ODD)
        assert quality.good_documents(df, labels).columns == df.columns
    assert quality.good_documents(odd, no_labels).count() == len(ODD)
    assert quality.classify(empty, labels).count() == 0


def test_logistic_separates_and_shrinks():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    p = fit_logistic(x, np.array([0, 0, 1, 1.0]), ridge=0.1)(x)
    assert (p[:2] < 0.5).all() and (p[2:] > 0.5).all()
    assert np.allclose(fit_logistic(x, np.ones(4))(x), 1, atol=0.05)


def test_blocks_of_long_sequences_are_exact():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = rng.integers(0, 40, size=rng.integers(1, 9))
        e, trans, begin = rng.normal(0, 4, size=int(n.sum())), rng.normal(0, 2, (2, 2)), rng.normal(0, 1, 2)
        lay = toxicity.Layout(n)
        laid = np.empty(len(e))
        laid[lay.index] = e
        want = toxicity.marginals(laid, lay, trans, begin)[0][lay.index] if len(e) else laid
        for block in (1, 2, 5, 64):
            assert not len(e) or np.allclose(want, toxicity.long_marginals(e, n, trans, begin, block), atol=1e-9)
