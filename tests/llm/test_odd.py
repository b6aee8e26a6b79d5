"""Odd rows in every operator and stage, and stages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistrand.llm import _queries, ann, html_text, mixing, near_dup, packing, passages, quality, toxicity, vec_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, _id long, sid long, key string, __id long, w array<int>, size long, doc long, other long"
WORDS = ["".join(random.Random(i).choice("abcdefgh") for _ in range(6)) for i in range(4000)]


def text(n, r):
    return " ".join(r.choice(WORDS) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3, "k", 4, [5], 6, 7, 8) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    base, long = text(90, r), text(40_000, r)
    near = base.split()
    near[45] = "other"
    out = [(1, base, "a"), (1, base, "a"), (2, base, None), (3, " ".join(near), "b"), (4, None, None), (None, None, "a"), (None, text(60, r), "b"), (5, "", "a"), (6, " \n", "b")]
    out += [(7, long, "a"), (8, text(20, r) + " " + " ".join(long.split()[30_000:30_070]), "b"), (9, text(70, r), "c"), (9, text(70, r), "c"), (10, "one", "c"), (11, "é́ 𝒳 ﷺ", "c"), (12, "x" * 300_000, "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows)


def test_operators_take_odd_documents(spark, docs, rows):
    empty, n = docs.limit(0), len(rows)
    sample = spark.createDataFrame([(1, 1), (3, 0), (7, 0), (9, 1)], "_id long, label int")
    tox, qual = toxicity.fit(docs, sample), quality.fit(docs, sample)
    for df, k in ((docs, n), (empty, 0)):
        assert toxicity.detect(df, tox, 0.7).count() == k and quality.classify(df, qual, 0.3).count() == k
        assert toxicity.keep_clean(df, tox, 2.0).count() == k and mixing.mix(df).count() == k
        got = near_dup.near_duplicates(df, k=5)
        assert got.count() == k
        assert passages.remove(df, passages.find(df)).columns == docs.columns
        assert (packing.pack(df, _queries.tokenizer_path()).count() >= k) if k else packing.pack(df, _queries.tokenizer_path()).count() == 0
    scores = {(r.doc_id, round(r.score, 9)) for r in quality.classify(docs, qual, 0.3).where("doc_id = 1").collect()}
    assert len(scores) == 1  # repeated rows score alike


def test_passages_take_any_id(spark, docs):
    found = passages.find(docs).collect()
    assert {(f.doc_id, f.other_id) for f in found} >= {(8, 7), (2, 1)}
    named = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert {frozenset((f.doc_id, f.other_id)) for f in passages.find(named).collect()} >= {frozenset(("d8", "d7"))}


def test_passages_cover_every_verbatim_repeat(spark):
    r = random.Random(21)
    shared = [text(n, r) for n in (50, 60, 80, 400)]
    pieces = [" ".join(shared[3].split()[i * 18 : i * 18 + 36]) for i in range(20)]
    rows = [(i, text(25, r) + " " + p + " " + text(25, r), "a") for i, p in enumerate(pieces)]
    rows += [(100 + i, " ".join(x for y in range(3) for x in (text(12 + y, r), shared[(i + y) % 3])), "a") for i in range(8)]
    rows += [(200, text(30, r) + " " + shared[3], "a"), (201, shared[3] + " " + text(30, r), "a")]
    gone = {}
    for f in passages.find(make(spark, rows)).collect():
        gone.setdefault(f.doc_id, set()).update(range(f.first_word, f.last_word + 1))
    first = {}
    for i, t, _ in rows:
        w = t.split()
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), i) != i:
                assert len(set(range(p, p + 50)) - gone.get(i, set())) < 20, (i, p)
    assert len(set(range(400)) - gone[201]) == 0


def test_pages_conversations_and_vectors_take_odd_rows(spark):
    page = "<html><body><article><p>a &amp; b</p></article></body></html>"
    df = spark.createDataFrame([(1, "http://x/1", page, "h", 1), (1, "http://x/1", page, "h", 1), (None, None, None, "h", 1), (2, "no url", "", "h", 2)], "page_id long, url string, html string, host string, key long")
    got = Counter((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got == {(1, "a & b"): 2, (None, ""): 1, (2, ""): 1} and html_text.extract(df.limit(0)).count() == 0
    rng = np.random.default_rng(2)
    x = [[float(v) for v in rng.normal(size=8)] for _ in range(30)]
    rows = [(i, 0, x[i], 1, 2, 3) for i in range(30)] + [(0, 0, x[0], 1, 2, 3), (40, 0, x[1], 1, 2, 3), (41, 0, None, 1, 2, 3), (None, 0, x[2], 1, 2, 3), (42, None, x[3], 1, 2, 3)]
    v = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>, cid long, h long, list int")
    near = ann.search(v, F.col("vec_id") % 20 == 0, k=5).collect()
    assert Counter(r.query_id for r in near) == {0: 5, 20: 5, 40: 5} and not any(r.query_id == r.vec_id for r in near)
    assert [r.score for r in sorted((r for r in near if r.query_id == 40), key=lambda r: r["rank"])][0] == pytest.approx(max(float(np.dot(x[i], x[1])) for i in range(30)))
    links = {r.vec_id: r for r in vec_dup.near_duplicates(v).where("vec_id is not null").collect()}
    assert links[1].n_links == 1 and links[40].component_id == 1 and not links[40].kept and links[42].n_links == 0 and links[2].n_links == 1


def test_stages_against_brute_force(spark, docs, rows):
    import corpus_pipeline as c

    def words(t):
        return (t or "").split()

    def shingles(t):
        w = [x.lower() for x in words(t)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = [(r.doc_id, r.text) for r in c.near_duplicates(spark, docs, "").collect()]
    order = sorted({(i is None, i or 0, t or "") for i, t, _ in rows if words(t)})
    groups = []
    for _, i, t in order:
        s = shingles(t)
        near = [g for g in groups if any(len(s & x) >= 0.8 * len(s | x) for x in g[1])]
        merged = (min([g[0] for g in near] + [(i, t)], key=lambda k: order.index(next(o for o in order if o[1:] == k))), [s] + [x for g in near for x in g[1]])
        groups = [g for g in groups if g not in near] + [merged]
    assert sorted(t for _, t in kept if words(t)) == sorted(t for (_, t), _ in groups)
    assert sum(not words(t) for _, t in kept) == sum(not words(t) for _, t, _ in rows)
    assert c.near_duplicates(spark, docs.limit(0), "").count() == 0
    mixed = Counter(r.text for r in c.mix(spark, docs, "").collect())
    assert set(mixed) <= {t for _, t, _ in rows} and all(mixed[t] <= 2 * n for t, n in Counter(t for _, t, _ in rows).items())
    clean = c.toxicity(spark, docs, "/root/testdata/sf0.001")
    assert clean.columns == docs.columns and c.substrings(spark, docs, "").columns == docs.columns
    assert c.pack(spark, docs, "").count() >= len(rows)


def test_mixing_is_the_dual_optimum(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(1, 400)), "ab"[i % 2]) for i in range(400)]
    got = mixing.mix(make(spark, rows)).select("doc_id", "size", "rate", "target", "source_size").collect()
    for odd in (0, 1):
        size = np.array([g.size for g in got if g.doc_id % 2 == odd], float)
        rate = np.array([g.rate for g in got if g.doc_id % 2 == odd])
        target = next(g.target for g in got if g.doc_id % 2 == odd)
        if target >= 2 * size.sum() * (1 - 1e-9):
            assert (rate == 2).all()
            continue
        lo, hi = -50.0, 50.0
        for _ in range(200):  # bisection on the multiplier
            mid = (lo + hi) / 2
            tokens = (size * np.minimum(2, np.exp(np.minimum(mid * size / size.mean(), 50)))).sum()
            lo, hi = (mid, hi) if tokens < target else (lo, mid)
        assert np.abs(rate - np.minimum(2, np.exp(lo * size / size.mean()))).max() < 1e-3


def test_all_maximal_segments():
    def brute(s):
        """Ruzzo and Tompa's definition, by splitting at the best segment."""
        if not len(s) or max(s) <= 0:
            return []
        best = max(((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (round(sum(s[x[0] : x[1]]), 9), -(x[1] - x[0]), -x[0]))
        i, j = best
        return brute(s[:i]) + [best] + [(a + j, b + j) for a, b in brute(s[j:])]

    r = np.random.default_rng(9)
    for _ in range(300):
        s = r.normal(size=r.integers(1, 20)) - 0.2
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(list(s))


def test_forest_walk_is_the_naive_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, quality.N_FEATURES))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(float)
    f = quality.grow(x, y, trees=15, depth=3)
    for row, got in zip(x[:60], f.score(x[:60])):
        raw = f.base
        for t in range(len(f.feature)):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.threshold[t, node])
            raw += f.leaf[t, node - 7]
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))
    assert ((f.score(x) > 0.5) == y).mean() > 0.9
