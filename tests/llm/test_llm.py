"""Brute force, round trips, odd rows and held-out accuracy of the operators of ``llm``."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistrand.llm import _queries, ann, chat, html_text, mixing, near_dup, packing, passages, quality, toxicity, vec_dup
from epistrand.llm._common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, pos int"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]


def text(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, long = text(120), text(3000)
    near = base.split()
    near[60] = "changed"
    passage = text(70)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, text(40) + " " + passage + " " + text(30)), (9, text(20) + " " + passage), (10, "one"), (None, text(30)), (11, text(80)), (11, text(80)), (12, base)]
    rows = [(i, t, "en", s, len(t or ""), "x", 1) for (i, t), s in zip(rows, ["a", "b", None] * 5)]
    return spark.createDataFrame([*rows, rows[0]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    assert all(r.taken <= 2 * r["size"] for r in rows)
    t = mixing.source_targets(spark.createDataFrame([("a", 100), ("b", 100), ("c", 10), (None, 50)], "source string, source_size long"))
    got = {r.source: r.target for r in t.collect()}
    assert sum(got.values()) == pytest.approx(390) and got["c"] == 20 and got["a"] == pytest.approx(200) and got[None] == pytest.approx(100)
    again = mixing.mix(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixing_meets_targets(spark):
    r = random.Random(1)
    d = spark.createDataFrame([(i, "w " * r.randrange(1, 300), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    by = mixing.mix(d).join(d, "doc_id").groupBy("source").agg(F.sum("taken").alias("got"), F.first("target").alias("want")).collect()
    assert all(abs(x.got / x.want - 1) < 0.01 for x in by)


def test_packing(spark, docs, empty):
    path = _queries.tokenizer_path()
    rows = [r.asDict() for r in packing.pack(docs, path).collect()]
    enc = packing.WordEncoder(path)
    want = sorted((r.doc_id or -1, zlib.crc32(b)) for r in docs.collect() for all_ids in [enc.whole(r.text or "") + b"\1\0\0\0"] for i in range(0, len(all_ids), 8192) for b in [all_ids[i : i + 8192]])
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(by) == list(range(len(by))) and packing.pack(empty, path).count() == 0


def test_word_encoder_is_exact():
    enc = packing.WordEncoder(_queries.tokenizer_path())
    r = random.Random(2)
    alpha = "ab'sdéÉßİΣσς é́ ª²½١٣#.,<|endoftext|>\x1c\x85\n\tﬁŉ"
    for _ in range(3000):
        t = "".join(r.choice(alpha) for _ in range(r.randrange(25)))
        assert enc.encode([t])[0] == enc.whole(t)


def test_plan_uses_every_piece():
    r = random.Random(3)
    counts = {r.randrange(1, 2049): r.randrange(1, 50) for _ in range(300)}
    used = {}
    for window, many, items in packing.plan(counts, 2048, (256, 512, 1024, 2048)):
        total = sum(k * c for k, c in items)
        assert total <= window and (window == 2048 or total == window)
        for k, c in items:
            used[k] = used.get(k, 0) + many * c
    assert used == counts


def test_chat(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|x", "a|b <\\\\| <", "", None, "é́ 𝒳"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user\nx", None, "assistant"], odd))] + [(2, 0, "assistant", "z"), (None, 0, "user", "n"), (2, None, "user", "first")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:6])
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].n_turns == 6 and not got[1].valid_order
    loss = (odd[2] or "") + odd[5]
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].valid_order and got[2].n_turns == 2 and got[None].n_turns == 1 and not got[None].valid_order  # it ends unanswered


def test_html():
    page = '<html><head><title>t</title></head><body><nav><ul><li>menu</ul></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one<br>two<p>x<!-- no --> y</p><form>f</form><section id="comments"><p>c</p></section></article><footer>f</footer></body>'
    assert html_text.main_text(html_text.blocks(page), np.zeros(0, bool))[0] == "A & B one two x y"


def test_html_repeats(spark):
    common = " ".join(f"w{i}" for i in range(20))
    rows = [(i, f"http://h.org/{i}", f"<p>{common}</p><p>own{i} " + " ".join(f"u{i}x{j}" for j in range(15)) + "</p>") for i in range(5)] + [(9, None, None), (10, "http://h.org/z", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"own{i} ") and common not in got[i] for i in range(5)) and got[9] == got[10] == ""
    r = random.Random(3)
    pages = [np.array([r.randrange(3) for _ in range(r.randrange(30))], np.uint64) for _ in range(12)]
    hosts = np.array([i % 2 for i in range(12)])
    page, place, total = html_text.runs(pages, np.ones(12), hosts, 3)
    want = Counter((h, run) for p, h in zip(pages, hosts) for run in {tuple(p[i : i + 3].tolist()) for i in range(len(p) - 2)})
    assert {(hosts[p], tuple(pages[p][x : x + 3].tolist())): n for p, x, n in zip(page, place, total)} == want


def test_html_counts_over_the_whole_host(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SHARD_PAGES", 7)
    monkeypatch.setattr(html_text, "TOKENS", 100)
    r = random.Random(4)
    common = [text(12, r) for _ in range(30)]
    rows = [(i, f"https://big.org/{i}", f"<p>own{i} a{i} b{i} c{i}</p><div>{common[i % 30]}</div>") for i in range(90)]
    rows += [(100 + i, "https://other.org/x", "<p>same page " + text(20, random.Random(1)) + "</p>") for i in range(5)]
    got = {x.page_id: x for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"own{i} a{i} b{i} c{i}" and got[i].n_removed == 12 for i in range(90))
    assert all(got[100 + i].text.startswith("same page") for i in range(5))  # copies of one page are one page


def jaccard(a, b, k):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x and y else 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, empty, k):
    r = random.Random(8)
    base = [r.choice(WORDS) for _ in range(90)]
    rows = [(1000 + i, " ".join(w if r.random() > 0.03 else r.choice(WORDS) for w in base)) for i in range(60)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = near_dup.near_duplicates(d, k=k).collect()
    texts = [(x.doc_id, x.text) for x in d.collect()]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i][1], texts[j][1], k) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, (n, _) in enumerate(texts):
        if n is not None:
            groups.setdefault(find(i), []).append(n)
    want = sorted((n, min(groups[find(i)])) for i, (n, _) in enumerate(texts) if n is not None)
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id is not None) == want
    assert len(got) == len(texts) and near_dup.near_duplicates(empty, k=k).count() == 0


def test_passages(spark, docs, empty):
    found = passages.find(docs)
    rows = found.collect()
    assert {(r.doc_id, r.other_id) for r in rows} >= {(9, 8), (2, 1), (12, 1)}
    assert not {r.doc_id for r in rows} & {7, 8, 10, 11}
    hit = [r for r in rows if (r.doc_id, r.other_id) == (9, 8)]
    assert {(r.first_word, r.last_word) for r in hit} == {(20, 89)}
    kept = {r.doc_id: r.text for r in passages.remove(docs, found).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert kept[9].split() == before[9].split()[:20] and kept[8] == before[8] and 2 not in kept and kept[4] is None
    assert passages.remove(docs, found).columns == docs.columns and passages.find(empty).count() == 0


def test_passages_of_repeated_lines_and_frequent_seeds(spark, monkeypatch):
    r = random.Random(8)
    line, passage = text(12, r), text(60, r)
    rows = [(i, " ".join([text(30, r), *[line] * (6 + i % 7), text(25, r), passage, text(20, r)])) for i in range(20)]
    rows += [(100 + i, text(200, r)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, passages.find(docs).collect()))
    monkeypatch.setattr(passages, "LEAST_SHARE", 3)
    monkeypatch.setattr(passages, "SHARES", 10**9)
    assert sorted(map(tuple, passages.find(docs).collect())) == plain
    gone = {}
    for d, _, s, e, *_ in plain:
        gone.setdefault(d, set()).update(range(s, e + 1))
    assert set(gone) == set(range(1, 20))  # the first holder and the unrelated documents are left alone
    for i in range(1, 20):
        lines = 30 + 12 * (6 + i % 7)
        assert set(range(30, lines)) <= gone[i] and set(range(lines + 25, lines + 85)) <= gone[i]
        assert len(gone[i]) <= 12 * (6 + i % 7) + 60


def test_passages_split_among_earlier_documents(spark):
    r = random.Random(9)
    a, b, c = text(30, r), text(30, r), text(25, r)
    edited = (a + " " + b).split()
    edited[30] = "changed"
    rows = [(1, text(40, r) + " " + a + " " + text(40, r)), (2, text(50, r) + " " + b + " " + text(20, r))]
    rows += [(5, text(35, r) + " " + a + " " + b + " " + text(30, r)), (9, text(25, r) + " " + a + " " + b + " " + text(45, r))]
    rows += [(11, text(15, r) + " " + " ".join(edited) + " " + text(33, r))]
    rows += [(20 + i, text(40, r) + " " + c + " " + text(40, r)) for i in range(6)]  # too short for a passage
    rows += [(30, text(70, r) + " " + " ".join(rows[0][1].split()[20:95]))]  # mostly held by document 1, and the end is part of 40
    rows[-1] = (30, rows[-1][1] + " " + b)
    rows += [(40, text(20, r) + " " + " ".join(rows[-1][1].split()[-60:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {}
    for d, _, s, e, *_ in passages.find(docs).collect():
        gone.setdefault(d, set()).update(range(s, e + 1))
    assert gone == {9: set(range(25, 85)), 11: set(range(15, 75)), 30: set(range(70, 145)), 40: set(range(20, 80))}


def test_chaining_finds_the_best_line():
    p = np.array([1, 2, 3, 4, 5, 6])
    a = np.array([10, 50, 11, 12, 51, 13])
    best = max(passages.chains(p, a), key=len)
    assert p[best].tolist() == [1, 3, 4, 6]


def test_segments_match_brute_force():
    r = np.random.default_rng(4)
    for _ in range(200):
        s = r.integers(-4, 4, r.integers(1, 25)).astype(float)
        got = toxicity.segments(s)
        if (s > 0).any():
            best = max(s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1))
            assert max(x for _, _, x in got) == pytest.approx(best)
        assert all(x == pytest.approx(s[i:j].sum()) and x > 0 for i, j, x in got)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_vec_dup_and_ann(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 16))
    x[100:160] = x[0] + r.normal(size=(60, 16)) * 0.25
    x[200:210] = x[1]
    rows = [(i, [float(v) for v in x[i]], int(i % 2) if i < 100 else 0) for i in range(300)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: g for g in vec_dup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([w[2] for w in rows[:300]])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    assert [got[i].n_links for i in range(300)] == link.sum(1).tolist() and all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    comp = np.arange(300)
    for _ in range(300):
        comp = np.minimum(comp, np.where(link, comp[None, :], 999).min(1))
    assert [got[i].component_id for i in range(300)] == comp.tolist()
    near = ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    ids = [*range(300), 904]
    allx = np.vstack([x, x[:1]])
    hit = total = 0
    for q in range(0, 300, 20):
        score = allx @ x[q]
        best = [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        mine = [n.vec_id for n in sorted(near, key=lambda n: n["rank"]) if n.query_id == q]
        hit, total = hit + len(set(mine) & set(best)), total + 5
        assert len(mine) == 5
    assert hit / total >= 0.9
    none = df.limit(0)
    assert vec_dup.near_duplicates(none).count() == 0 and ann.search(none, F.col("vec_id") % 20 == 0).count() == 0


def test_classifiers_hold_out(spark, empty):
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    for name, col, least in (("op2_toxicity", "toxic", 0.85), ("op8_quality", "quality", 0.95)):
        p = _queries.queries()[name](spark, sf).toPandas().set_index("doc_id").join(lab, how="inner")
        h = p[p.held_out]
        recall = [(h.predicted[h[col] == v] == v).mean() for v in (0, 1)]
        assert sum(recall) / 2 >= least and h.score.between(0, 1).all()


def test_classifiers_take_odd_rows(spark, docs, empty):
    forest = quality.grow(np.zeros((0, quality.N_FEATURES)), np.zeros(0))
    assert quality.classify(docs, forest, 0.3).count() == docs.count() and quality.classify(empty, forest, 0.3).count() == 0
    none = toxicity.Model(toxicity.Lexicon({}, {}, 0, 0))
    assert {r.predicted for r in toxicity.detect(docs, none, 0.7).collect()} == {0} and toxicity.keep_clean(empty, none, 0.7).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = _queries.table(spark, SF, "documents")
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "substrings", "mix", "pack"]
    d = c.near_duplicates(spark, docs, SF)
    assert d.columns == docs.columns and 0 < d.count() < docs.count()
    m = c.mix(spark, docs, SF)
    assert m.columns == docs.columns
    assert c.run(spark, SF).count() > 0
