"""Exact operators against brute force, and their defined cases."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import decontamination, mixing, sharding, simhash, token_counts, topk
from lodestone.llm._util import connected_components

from ..oracle import connect, same
from .conftest import DOCS, ODD

SF = "/root/testdata/sf0.001"


# -- token counts

def some_texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [
        "  a  b ", "漢字 x\n\n y\tz  ", "😀😀 ok▁x", "a" * 300 + " " * 40, "abababa" * 30, "ﬁ½ ",  "\x00\r\n"]


def test_counts_equal_the_models_own_encoder(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    m = token_counts.Unigram.load(token_counts.default_vocabulary())
    assert isinstance(m, token_counts.Bpe)
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())
    texts = some_texts(spark, "/root/testdata/sf0.01")
    assert [m.count(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def test_unigram_counts_equal_a_tokenizer(spark):
    """The same pieces and scores, read as a unigram model."""
    sentencepiece, models = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())]
    m = token_counts.Unigram([p for i, p in enumerate(pieces) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))], byte_fallback=True)
    hf = models.Tokenizer(models.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    texts = some_texts(spark, SF)
    want = [len(hf.encode((" " + t).replace(" ", token_counts.SPACE), add_special_tokens=False).ids) for t in texts]
    assert [m.count(t) for t in texts] == want


def test_bpe_equals_plain_merging():
    rng = random.Random(8)
    for _ in range(60):
        pieces = list("abc▁") + ["".join(rng.choice("abc▁") for _ in range(rng.randint(2, 4))) for _ in range(12)]
        m = token_counts.Bpe([(p, float(-k)) for k, p in enumerate(dict.fromkeys(pieces))], byte_fallback=True)
        for _ in range(60):
            text = "".join(rng.choice("abc▁é") for _ in range(rng.randint(0, 14)))
            assert m.viterbi(text) == sum(1 if p in m.rank else len(p.encode()) for p in m.merged(text)), (pieces, text)


def test_viterbi_equals_enumeration():
    rng = random.Random(5)
    pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): float(-rng.randint(0, 6)) for _ in range(14)} | {"a": -3.0}
    m = token_counts.Unigram(list(pieces.items()), byte_fallback=True)

    def best(text):
        """Best score and count by the rule: of equal scores into a place the one whose last piece starts first."""
        out = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            found = None
            for s in range(e):
                if text[s:e] in pieces and (found is None or out[s][0] + pieces[text[s:e]] > found[0]):
                    found = (out[s][0] + pieces[text[s:e]], out[s][1] + 1)
            if text[e - 1] not in pieces and (found is None or out[e - 1][0] + m.unknown > found[0]):
                found = (out[e - 1][0] + m.unknown, out[e - 1][1] + len(text[e - 1].encode()))
            out.append(found)
        return out[-1][1]

    for _ in range(300):
        text = "".join(rng.choice("ab▁cé") for _ in range(rng.randint(0, 9)))
        assert m.viterbi(text) == best(text), text


def test_token_count_cases(odd, empty, clashing):
    for df in (odd, clashing):
        rows = token_counts.token_counts(df).collect()
        assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
        assert len({r.n_tokens for r in rows if r.doc_id in (5, 6)}) == 1 and next(r.n_tokens for r in rows if r.doc_id == 5) > 40_000
    assert token_counts.token_counts(empty).count() == 0


# -- sharding

def shards(df, **k):
    return [r.asDict() for r in sharding.shard_by_bytes(df, **k).collect()]


def test_shards_are_near_equal_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = shards(docs)
    sizes = {d["doc_id"]: len((d["text"] or "").encode()) + 16 for d in docs.collect()}
    total, most, by = sum(sizes.values()), max(sizes.values()), {}
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]]
        by.setdefault(r["shard"], []).append(r)
    assert len(rows) == len(sizes) and set(by) == set(range(40))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 40) <= most + 2 * 0.002 * total / 40


def test_copies_stay_together_unless_too_many(table):
    rng = random.Random(1)
    rows = [(k, "copy of one text" if k % 3 == 0 else f"text {rng.random()} {k}", "en", "s", 1) for k in range(3000)]
    by = {}
    for r in shards(table(rows, DOCS), n_shards=10):
        by.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert len(by) == 10 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 10 + 100
    few = [(k, f"pair {k // 2}", "en", "s", 1) for k in range(2000)]
    placed = {}
    for r in shards(table(few, DOCS), n_shards=10):
        placed.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert sum(len(x) > 1 for x in placed.values()) <= 9


def test_shard_cases(odd, empty, clashing, tmp_path, spark):
    for df in (odd, clashing):
        rows = shards(df, carry=df.columns)
        assert len(rows) == len(ODD) and all(r["text_crc32"] == zlib.crc32((r["row"]["text"] or "").encode()) for r in rows)
        assert next(r["size"] for r in rows if r["doc_id"] == 2) == 16
    assert shards(empty) == []
    sharding.write_shards(odd, str(tmp_path / "out"), n_shards=3)
    sharding.write_shards(clashing, str(tmp_path / "clash"), n_shards=3)
    assert spark.read.parquet(str(tmp_path / "clash")).where("shard_ = 'x' and shard < 3").count() == len(ODD)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


# -- simhash

def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(points, linked):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(points)):
        groups.setdefault(find(i), set()).add(points[i])
    return {frozenset(g) for g in groups.values()}


def test_near_duplicates_equal_brute_force(spark, odd):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        fps = {i: brute_fingerprint(t) for i, t in rows if i is not None}
        got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in simhash.near_duplicates(df).collect() if r.doc_id is not None}
        assert set(got) == {(i, f) for i, f in fps.items()}
        ids = {}
        for (i, _), c in got.items():
            ids.setdefault(c, set()).add(i)
        assert {frozenset(x) for x in ids.values()} == components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
        assert all(c == min(x) for c, x in ids.items())


@pytest.mark.parametrize("hot", [4, 10_000])
def test_links_keep_all_connections(table, hot):
    """Fingerprints around few centres, many with the same half, through the plain and the crowded index."""
    rng = random.Random(hot)
    points = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randint(0, 7)):
                f ^= 1 << rng.randrange(64 if rng.random() < 0.5 else 20)
            points.add(f)
    points = sorted(points)
    signed = [f - (1 << 64) if f >> 63 else f for f in points]
    edges = [((r.u) & (1 << 64) - 1, (r.v) & (1 << 64) - 1) for r in simhash.links(table([(f,) for f in signed], "fp long"), hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    have = {frozenset(x) for x in edges}
    assert components(points, lambda a, b: frozenset((a, b)) in have) == components(points, lambda a, b: (a ^ b).bit_count() <= 3)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_are_found_and_others_left(table):
    """Planted copies with one word in forty replaced meet their originals; texts of the same words at random don't."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)] + ["the", "of"] * 300
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 300))] for _ in range(150)]
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)]
    pairs = {}
    for k in range(100):
        copy = list(texts[k])
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 60)):
            copy[at] = rng.choice(vocabulary)
        a, b = shingles(" ".join(texts[k])), shingles(" ".join(copy))
        if len(a & b) / len(a | b) >= 0.8:
            pairs[1000 + k] = k
        rows.append((1000 + k, " ".join(copy), "en", "s", 1))
    got = {r.doc_id: r.component for r in simhash.near_copies(table(rows, DOCS)).collect()}
    assert len(pairs) > 60 and np.mean([got[a] == got[b] for a, b in pairs.items()]) >= 0.95
    assert len({got[k] for k in range(150)}) == 150


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_near_copies_below_the_similarity_stay(table):
    """Texts at 0.4 to 0.79 and the same words in another order aren't copies of each other."""
    rng = random.Random(5)
    texts = []
    for k in range(60):
        one = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(one)
        for at in range(20, 180, 160 // (5 + k % 12)):
            other[at] = f"x{rng.randrange(5000)}"
        if 0.4 <= similarity(" ".join(one), " ".join(other)) < 0.8:
            texts += [one, other]
        texts.append(one[::-1])
    assert len(texts) > 140
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)]
    assert simhash.near_copies(table(rows, DOCS)).select("component").distinct().count() == len(rows)


def test_near_copies_are_those_of_all_pairs(table):
    """Appended blocks, short texts, chains and a family around a common passage: the groups of a comparison of all pairs."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(40_000)}"
    texts = []
    for n in [15, 20] * 40 + [130, 250, 400] * 6:
        one = [word() for _ in range(n)]
        texts += [one, one[:-1] + [word()] if n < 100 else one + [word() for _ in range(n // 5 - 2)]]
    base = [word() for _ in range(300)]
    for _ in range(80):
        texts.append([word() if rng.random() < 0.015 else w for w in base])
        texts.append(base[:200] + [word() for _ in range(rng.randint(10, 200))])
    texts = [" ".join(t) for t in texts] + ["", "one two", "One  two", "one two three"]
    part = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for i, j in pairs:
        part = [part[j] if x == part[i] else x for x in part]
    got = {r.doc_id: r.component for r in simhash.near_copies(table([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)).collect()}
    assert len(pairs) > 500
    assert len({(got[k], part[k]) for k in got}) == len(set(got.values())) == len(set(part))


def test_first_of_each(odd, empty, clashing):
    for df in (odd, clashing):
        for parts in (None, simhash.near_copies(df)):
            kept = simhash.first_of_each(df, parts)
            ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
            assert kept.columns == df.columns and ids == [1, 2, 5, 7, 8, 10]
    assert simhash.near_copies(empty).count() == 0
    assert simhash.first_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(table):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 230)] + [(7, 7), (9, 8), (8, 9)]
    got = {r.node: r.component for r in connected_components(table(edges, "u long, v long"), "test").collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 230)} == {5} and got[9] == 8 and 7 not in got


# -- top-k

@pytest.mark.parametrize("seed", [1, 2])
def test_topk_equals_brute_force(table, seed):
    rng = np.random.default_rng(seed)
    vecs = [(k, rng.normal(size=8).astype(float).tolist()) for k in range(300)] + [(300 + k, [1.0] * 8) for k in range(40)]
    rows = vecs + [(None, [1.0] * 8), (1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (50, vecs[50][1]), (1050, []), (1100, [2.0])]
    got = {}
    for r in topk.search(table(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    live = {i: [int(np.floor(x * 256)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in live if i % 50 == 0):
        want = sorted(((-sum(a * b for a, b in zip(live[q], v)), i) for i, v in live.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)], q
    assert set(got) == {i for i in live if i % 50 == 0}


def test_topk_of_nothing(table):
    assert topk.search(table([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.search(table([(50, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_topk_counts_repeats(table, monkeypatch):
    """Repeated rows take a rank each; an id with several vectors is asked with the smallest; blocks of any number agree."""
    rows = [(50, [1.0, 0.0], "x"), (50, [2.0, 0.0], "x"), (50, [1.0, 0.0], "x"), (1, [3.0, 0.0], "x"), (1, [3.0, 0.0], "x"), (2, [4.0], "x"), (None, [9.0, 9.0], "x"),
            (3, None, "x"), (4, [float("nan"), 1.0], "x"), (100, [0.5, 0.5], "x")]
    df = table(rows, "vec_id long, embedding array<double>, score string")
    want = {(50, 1, 2, 262144), (50, 2, 1, 196608), (50, 3, 1, 196608), (50, 4, 100, 32768),
            (100, 1, 2, 131072), (100, 2, 1, 98304), (100, 3, 1, 98304), (100, 4, 50, 65536), (100, 5, 50, 32768)}
    assert {tuple(r) for r in topk.search(df).collect()} == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 2)
    monkeypatch.setattr(topk, "PARTS", 1)
    assert {tuple(r) for r in topk.search(df).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_topk_floors_of_other_blocks_lose_nothing(monkeypatch, seed):
    """Blocks read one after the other with the best scores so far give the best of all rows, ties included."""
    monkeypatch.setattr(topk, "GROUP", 3)
    rng = np.random.default_rng(seed)
    ids, vectors = rng.permutation(700), rng.integers(-4, 5, (700, 6)) if seed % 2 else rng.integers(-(2**20), 2**20, (700, 6))
    asked = np.flatnonzero(ids % 50 == 0)
    queries, best, found, sent = vectors[asked], np.full((len(asked), 5), -np.inf), {int(ids[a]): [] for a in asked}, 0
    place = {int(ids[a]): r for r, a in enumerate(asked)}
    for low in range(0, 700, 100):
        index = topk.Index(ids[low : low + 100], np.ones(100, dtype=np.int64), vectors[low : low + 100])
        for q, i, _, score in index.search(ids[asked], queries, 5, best.min(axis=1)):
            found[q].append((-score, i))
            row = best[place[q]]
            row[row.argmin()] = max(row.min(), score)
            sent += 1
    for a in asked:
        scores = vectors @ vectors[a]
        want = sorted((-int(scores[r]), int(ids[r])) for r in range(700) if r != a)[:5]
        assert sorted(found[int(ids[a])])[:5] == want
    assert sent < len(asked) * 35  # later blocks answer with fewer rows


def test_topk_large_numbers_are_exact(table):
    """Scores above 2^53 that differ in their last digit."""
    rows = [(0, [1e7, 1.0])] + [(k, [1e7, k / 256]) for k in range(1, 9)]
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(table(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(k + 1, 8 - k, 2_560_000_000**2 + 256 * (8 - k)) for k in range(5)]


# -- decontamination and mixing

def test_sql_twins(spark):
    con = connect(SF)
    for name, f in (("benchmark", lambda s, d: decontamination.contamination(s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/benchmark.parquet")).drop("place")),
                    ("vectors", lambda s, d: topk.search(s.read.parquet(f"{d}/embeddings.parquet")))):
        got, want = same(spark, con, f, decontamination.ORACLE if name == "benchmark" else topk.ORACLE, SF)
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_contamination_equals_brute_force(table, seed):
    rng = random.Random(seed)

    def words(n, letters=3):
        return [rng.choice("abc"[:letters]) for _ in range(n)]

    docs = [(k, " ".join(words(rng.randint(0, 60), rng.choice((1, 2, 3)))), "en", "s", 1) for k in range(60)] + [(99, None, None, None, None), (5, "A b. C!", "en", "s", 1)]
    items = [(k, " ".join(words(rng.choice((0, 1, 3, 9, 10, 14, 40)), rng.choice((1, 2, 3))))) for k in range(12)] + [(3, "a b c a b c a b c a b c"), (None, "c c c c c c"), (77, None)]

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    want = []
    for i, t, *_ in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            b = split(text)
            n = min(len(b), 10)
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(found), bool(hit)))
    got = decontamination.contamination(table(docs, DOCS), table(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == sorted(want)


def test_decontamination_cases(odd, empty, clashing, table):
    items = table([(1, "quick brown fox jumps over the lazy dog near the river"), (2, "")], "item_id long, text string")
    none = table([], "item_id long, text string")
    for df in (odd, clashing):
        kept = decontamination.clean_documents(df, items)
        assert kept.columns == df.columns and kept.count() == len(ODD) - 2
        assert decontamination.clean_documents(df, none).count() == len(ODD)
    assert decontamination.contamination(empty, items).count() == 0


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    per = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        per.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in x) for s, x in per.items()}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, capped = {}, set()
    while True:  # share by weight, stop at twice the size, share the rest again
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        over = {s for s in sizes if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s, x in per.items():
        assert x[0].target == pytest.approx(target[s]) and x[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in x) - target[s]) <= max(0.02 * target[s], 60)
    again = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_flight_keeps_both_balances():
    rng = np.random.default_rng(0)
    p, size = rng.random(400), rng.integers(0, 50, 400)
    out = mixing.flight(p, size, 7)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-4
    settled = mixing.land(out, size)
    assert set(np.unique(settled)) <= {0.0, 1.0}


def test_mixing_cases(odd, empty, clashing):
    for df in (odd, clashing):
        assert mixing.mix(df).count() == len(ODD)
        assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_ids_of_any_type(table):
    """Text ids, and a hot source of one repeated row: blocks stay small."""
    df = table([("a", "one two three", "s")] * 3000 + [("b", "four", "t"), (None, None, None)], "doc_id string, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 3002 and sum(r.taken for r in got if r.doc_id == "a") <= 2 * 9000 and {r.doc_id for r in got} == {"a", "b", None}


def test_row_ids_hold_for_other_plans(spark, table):
    """An input that is no plain scan is written first: ids of two reads agree."""
    from lodestone.llm._util import scanned

    plain = table([(k, f"text {k}", "s") for k in range(50)], "doc_id long, text string, source string")
    assert scanned(plain) is plain and scanned(plain.where("doc_id > 3")).count() == 46
    shuffled = plain.repartition(7).orderBy(F.rand())
    assert {r.doc_id for r in simhash.first_of_each(shuffled).collect()} <= set(range(50))
    assert mixing.mixed_documents(shuffled).where("text <> concat('text ', doc_id)").count() == 0


def test_no_class_is_left_out_of_a_sample(table):
    from lodestone.llm._util import bounded_sample

    df = table([(k, f"class{k % 1500}") for k in range(6000)] + [(k, "big") for k in range(6000, 20000)] + [(None, None)], "doc_id long, lang string")
    got = bounded_sample(df, "lang", 100, F.col("doc_id"))
    n = {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()}
    assert len(n) == 1502 and 60 < n["big"] < 150 and n["class7"] == 4 and got.collect() == bounded_sample(df, "lang", 100, F.col("doc_id")).collect()


def test_near_copies_equal_brute_force(table):
    """Families of edited copies around a shared passage: the components of all pairs at 0.8, also just above and below."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(60)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
            rows.append(" ".join(words + passage[: rng.randint(0, 30)] if rng.random() < 0.5 else words))
    rows += [" ".join(passage)] * 5 + ["", "one two", "one two", None]
    sets = [frozenset(simhash.shingles_of((t or "").encode()).tolist()) for t in rows]
    want = components(range(len(rows)), lambda i, j: sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0)
    got = {r.doc_id: r.component for r in simhash.near_copies(table(list(enumerate(rows)), "doc_id long, text string")).collect()}
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(got[k], set()).add(k)
    assert {frozenset(g) for g in groups.values()} == want and len(want) < len(rows) - 20
