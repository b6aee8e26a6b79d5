"""Findings of round 2."""

import random
import time
from unittest import mock

import numpy as np

from epistrand.llm import _common, near_dup, passages, toxicity

WORDS = ["".join(random.Random(i).choice("abcdefgh") for _ in range(6)) for i in range(4000)]


def test_near_duplicates_compares_a_class_with_few_leaders(spark, monkeypatch):
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(90)]
    copies = [" ".join(w if r.random() > 0.02 else r.choice(WORDS) for w in base) for _ in range(400)]
    made, estimated = [], near_dup._estimated

    def counted(pairs, classes, least):
        made.append(pairs.count())
        out = estimated(pairs, classes, least)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") < 2  # the filter must not run the function anew
        return out

    monkeypatch.setattr(near_dup, "_estimated", counted)
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string"), k=2).collect()
    assert len(got) == 400 and made[0] <= 12 * 400
    sets = [{tuple(c.split()[i : i + 2]) for i in range(len(c.split()) - 1)} for c in copies]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(400):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {x.doc_id: x.component_id for x in got} == {i: find(i) for i in range(400)}


def test_window_hashes_tell_windows_apart():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    for n in range(1, 60):
        w = words[r.integers(0, 3, 200)]
        h = passages.window_hashes(w, n).tolist()
        windows = [tuple(w[i : i + n].tolist()) for i in range(201 - n)]
        assert len(h) == len(windows) and len(set(h)) == len(set(windows)) == len(set(zip(h, windows, strict=True)))
    assert not len(passages.window_hashes(w, 201))


def test_segments_of_runs_are_those_of_single_scores():
    r = np.random.default_rng(2)
    for _ in range(300):
        s = r.integers(-4, 4, r.integers(0, 40)).astype(float)
        split = np.zeros(2 * len(s))  # a zero after each score leaves no neighbours, so no runs
        split[::2] = s
        assert toxicity.segments(s) == [(a // 2, (b + 1) // 2, x) for a, b, x in toxicity.segments(split)]


def test_alignment_scans_runs_of_shared_words():
    def seconds(scores):
        began = time.process_time()
        found = toxicity.segments(scores)
        return time.process_time() - began, found

    one, apart = np.ones(1_000_000), np.ones(2_000_000)
    apart[1::2] = 0
    whole, found = seconds(one)
    assert found == [(0, 1_000_000, 1_000_000.0)] and whole < seconds(apart)[0] / 3  # a step a run, not a step a word


def test_pipeline_estimates_pairs_of_near_copies_once(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(6)
    base = [r.choice(WORDS) for _ in range(150)]
    copies = [" ".join(w if r.random() > 0.01 else r.choice(WORDS) for w in base) for _ in range(300)]
    plans, pairs_of, estimated = [], [], near_dup._estimated

    def seen(pairs, classes, least):
        pairs_of.append(pairs.count())
        out = estimated(pairs, classes, least)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(near_dup, "_estimated", seen)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string"), "")
    assert 0 in {x.doc_id for x in kept.collect()} and pairs_of[0] <= 12 * 300
    assert all(p.count("ArrowEvalPython") < 2 for p in plans)


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(r.randrange(1000, 1900), r.randrange(1000, 1900)) for _ in range(450)] + [(-5, 1500), (2**62, -(2**62)), (7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    staged, stage = [], _common.stage
    monkeypatch.setattr(_common, "stage", lambda df, name: staged.append(name) or stage(df, name))
    few = _common.components(e, "a", "b").collect()
    assert staged == ["edges", "roots"]  # no rounds of joins
    monkeypatch.setattr(_common, "LOCAL_EDGES", 0)
    many = _common.components(e, "a", "b").collect()
    assert len(staged) > 4 and len(few) == len(many) and {tuple(x) for x in few} == {tuple(x) for x in many}
    root = {x.node: x.root for x in few}
    assert root[200] == 0 and root[1500] == -5 and root[2**62] == -(2**62)
    assert _common.components(e.where("a > 2 and a < 2"), "a", "b").count() == 0


def test_chaining_gives_memory_back(spark, monkeypatch):
    r = random.Random(9)
    shared = [r.choice(WORDS) for _ in range(120)]
    texts = [" ".join([r.choice(WORDS) for _ in range(40)] + shared + [r.choice(WORDS) for _ in range(40)]) for _ in range(5)]
    wrapped, plans, frugal, stage = [], [], passages.frugal, passages.stage

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(passages, "frugal", lambda run: wrapped.append(run.__name__) or frugal(run))
    monkeypatch.setattr(passages, "stage", staged)
    found = passages.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert "chain" in wrapped and not any("Pandas" in p for p in plans)  # workers hold no pandas frames and release what chaining took
    assert {x.doc_id for x in found} == {1, 2, 3, 4} and all(x.first_word <= 40 and x.last_word >= 159 for x in found)


def test_minimisers_are_the_first_least_hashes_of_windows():
    r = np.random.default_rng(3)
    for n in [*range(40), 300, 5000]:
        for most in (3, 50, 1 << 63):
            for window in (1, 2, 7, 16):
                h = r.integers(0, most, n, dtype=np.uint64)
                want = {s + int(h[s : s + window].argmin()) for s in range(max(1, n - window + 1))} if n else set()
                assert passages.minimisers(h, window).tolist() == sorted(want)


def test_minimisers_need_no_scan_of_each_window():
    h = np.random.default_rng(4).permutation(1 << 20).astype(np.uint64)
    began = time.process_time()
    view = np.lib.stride_tricks.sliding_window_view(h, 16)
    want = np.unique(np.concatenate([np.arange(s, min(s + 65536, len(view))) + view[s : s + 65536].argmin(axis=1) for s in range(0, len(view), 65536)]))
    scanned = time.process_time() - began
    began = time.process_time()
    assert (passages.minimisers(h) == want).all() and time.process_time() - began < 0.7 * scanned


def test_driver_collects_once_its_heap_is_half_full():
    calls = []

    def session(total):
        jvm = mock.MagicMock()
        heap = jvm.java.lang.Runtime.getRuntime.return_value
        heap.totalMemory.return_value, heap.maxMemory.return_value = total, 750
        jvm.java.lang.System.gc.side_effect = lambda: calls.append(total)
        return mock.MagicMock(sparkContext=mock.MagicMock(_jvm=jvm))

    _common._collect(session(370))
    _common._collect(session(380))
    assert calls == [380]
