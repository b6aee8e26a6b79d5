"""Rows that a bound, a join or a choice once left out."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from epistrand.llm import ann, passages, toxicity, vec_dup

DOCS = "doc_id long, text string, source string"


def test_mix_of_null_and_repeated_ids(spark):
    import corpus_pipeline as c

    rows = [(None if i % 3 == 0 else i % 40, f"t{i} " + "w " * (1 + i * 7 % 90), "abc"[i % 3 if i % 5 else 0]) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = c.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    got = Counter(tuple(r) for r in mixed.collect())
    assert set(got) <= set(rows) and max(got.values()) <= 2
    words = sum(n * len(t.split()) for (_, t, _), n in got.items())
    assert abs(words - 1.5 * sum(len(t.split()) for _, t, _ in rows)) <= 150


def test_merged_chains_keep_their_diagonals():
    r = np.random.default_rng(2)
    w = r.integers(1, 2**31, 400).astype(np.uint64)
    # The passage stands at 300 of the other document; its halves also stand apart, nearer to the stretch's diagonal.
    p = w[:60]
    a = np.concatenate([p[:30], w[100:180], p[30:], w[200:330], p, w[340:360]])
    d = np.concatenate([w[60:80], p, w[80:100]])
    assert not passages.align(d, a, -20, 50, 0.8)
    own = passages.align(d, a, -20, 50, 0.8, ((20, 49, 0, 29), (20, 79, 270, 329)))
    assert {x for f, e, *_ in own for x in range(f, e + 1)} >= set(range(20, 80))


def test_toxic_words_are_kept_by_log_odds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOKENS", 5, raising=False)
    rows = [(i, "the and of to in is " + ("vilex " if i < 20 else "") + f"{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(i, int(i < 60)) for i in range(400)], "_id long, label int")
    assert "vilex" in toxicity.fit(docs, sample).lexicon.toxic


def test_ann_searches_every_length(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(size=20 if i < 60 else 18)]) for i in range(100)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5, lists=2).collect()
    assert Counter(g.query_id for g in got) == {q: 5 for q in range(0, 100, 20)}
    assert all((g.query_id < 60) == (g.vec_id < 60) for g in got)


def test_vec_dup_compares_every_length(spark):
    rows = [(n, 1, [1.0] * n) for n in range(1, 1301)] + [(2000 + n, 1, [1.0] * (n - 1) + [1.01]) for n in (900, 1250)]
    got = {g.vec_id: g.n_links for g in vec_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")).collect()}
    assert {i for i, n in got.items() if n} == {900, 1250, 2900, 3250}
