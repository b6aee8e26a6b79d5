"""Toxicity: maximum-scoring segments over token log-odds.

1. From labelled documents, each word and each word prefix of 3 to 7 letters gets a log-odds of
   occurring in toxic rather than other documents, under a Dirichlet prior in proportion to its
   overall rate, less one standard error. Tokens that toxic documents clearly prefer are kept.
2. A word scores the log-odds of its longest kept token, any other word a small negative drift, so
   the expected score of clean text is negative.
3. A linear-time scan (Ruzzo and Tompa 1999) finds all maximal-scoring segments of a text.
4. The largest of n chance scores follows an extreme-value law with parameters lambda and K, fitted
   on clean labelled documents; it turns segment scores into expected counts E. Segments with E
   below a limit are significant toxic passages.
5. The score of a document is a logistic function of its summed evidence, fitted on the same
   labelled documents, each judged by counts without its own.

A null or empty text has no passage and gets the score of zero evidence. Null ids are never
labelled; repeated rows get equal scores; labels of one document or of equal texts that differ count
as toxic. Texts are scanned whole, however long. A word of several kept tokens takes the longest;
segments of equal score take the shorter left part. Columns other than ``doc_id`` and ``text`` play
no part, whatever their names. With no usable labels every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._common import frugal, stage

#: Labelled documents to learn from, at most.
MAX_LABELLED = 40_000
#: Words that a task remembers, at most (only speed changes).
MEMO = 50_000
PREFIXES = (7, 6, 5, 4, 3)
_STRIP = ".,;:!?|#*%$&\"'()[]{}<>-"


def tokens(word: str) -> list[str]:
    """The word and its prefixes, longest first; prefixes end in ``*``."""
    w = word.lower().strip(_STRIP)
    return [w, *[w[:k] + "*" for k in PREFIXES if len(w) > k]] if w else []


@dataclass
class Lexicon:
    """Token counts in toxic and other documents; ``llr`` is a low estimate of the log-odds ratio."""

    toxic: dict[str, int]
    other: dict[str, int]
    n_toxic: int
    n_other: int
    prior: float = 20.0
    least: int = 3
    least_llr: float = 2.5
    drift: float = 0.4

    def llr(self, token: str, own_toxic: int = 0, own_other: int = 0) -> float:
        a, b = self.toxic[token] - own_toxic, self.other.get(token, 0) - own_other
        if a < self.least:
            return 0.0
        na, nb = max(1, self.n_toxic - own_toxic), max(1, self.n_other - own_other)
        pseudo = 0.5 + self.prior * (a + b) / (na + nb)
        odds = math.log((a + pseudo) / (na + self.prior)) - math.log((b + pseudo) / (nb + self.prior))
        return odds - math.sqrt(1 / (a + pseudo) + 1 / (b + pseudo))

    def word(self, word: str, own_toxic: int = 0, own_other: int = 0) -> float:
        for t in tokens(word):
            if t in self.toxic:
                s = self.llr(t, own_toxic, own_other)
                if s >= self.least_llr:
                    return s
        return -self.drift


class Scorer(dict):
    """word -> score, remembered up to a bound."""

    def __init__(self, lexicon: Lexicon, own_toxic: int = 0, own_other: int = 0):
        super().__init__()
        self.args = (lexicon, own_toxic, own_other)

    def __missing__(self, word: str) -> float:
        lexicon, a, b = self.args
        s = lexicon.word(word, a, b)
        if len(self) >= MEMO:
            self.clear()
        self[word] = s
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), end exclusive; ties go to the shorter left part.

    Only positive scores can start or end a segment, and neighbours among them always join, so the
    scan visits runs of positive scores and takes the sums between them from cumulated scores.
    """
    turns = np.flatnonzero(np.diff(np.concatenate([[False], scores > 0, [False]]).astype(np.int8)))
    if not len(turns):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    sums = total[turns].tolist()
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier with smaller sum before
    for start, end, left, right in zip(turns[::2].tolist(), turns[1::2].tolist(), sums[::2], sums[1::2], strict=True):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - le) for s, e, le, r, _ in stack]


@dataclass
class Model:
    lexicon: Lexicon
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (-500.0, 0.0, 0.0, 0.0)
    significant: float = 0.05
    passages: bool = field(default=True)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float, float]:
        """Sum of -log E over significant segments, -log E of the best, and all segments' scores a word."""
        logs = [self.lam * s - math.log(self.k * max(1, n)) for _, _, s in found]
        return sum(x for x in logs if x > -math.log(self.significant)), max([0.0, *logs]), 100 * sum(s for _, _, s in found) / (n + 20)

    def score(self, evidence: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * math.log1p(x) for w, x in zip(self.weights[1:], evidence, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _scan(text: str, scorer: Scorer) -> tuple[list[tuple[int, int, float]], int]:
    words = text.split()
    scores = np.fromiter(map(scorer.__getitem__, words), np.float64, len(words))
    return segments(scores), len(words)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w)), a.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _count(df: DataFrame, wanted: dict[str, int] | None) -> DataFrame:
    """(token, n): in how many of the texts each token occurs; only ``wanted`` ones if given. Counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
            counts.clear()
            return b

        for b in batches:
            for text in b.column(0).to_pylist():
                seen: set[str] = set()
                for w in set((text or "").split()):
                    t = memo.get(w)
                    if t is None:
                        t = [x for x in tokens(w) if wanted is None or x in wanted]
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[w] = t
                    seen.update(t)
                for t in seen:
                    counts[t] = counts.get(t, 0) + 1
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    return df.select("text").mapInArrow(frugal(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Learn from the texts of ``sample`` (_id, label: a bounded table, so it is broadcast)."""
    texts = docs.select(F.col("doc_id").alias("__doc"), "text").where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(sample.select(F.col("_id").alias("__id"), "label")), F.col("__doc") == F.col("__id"))
    rows = stage(rows.groupBy("text").agg(F.max("label").alias("label")), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count("*")).collect()}
    if not n.get(1) or not n.get(0):
        return Model(Lexicon({}, {}, 0, 0), weights=(-500.0, 0.0, 0.0, 0.0))
    by_token = _count(rows.where("label = 1"), None).where("n >= 3").withColumnRenamed("n", "a")
    by_token = by_token.join(_count(rows.where("label = 0"), None).withColumnRenamed("n", "b"), "token", "left").select("token", "a", F.coalesce("b", F.lit(0)).alias("b"))
    blank = Lexicon({}, {}, n[1], n[0])
    pseudo = 0.5 + blank.prior * (F.col("a") + F.col("b")) / (n[1] + n[0])
    odds = F.log((F.col("a") + pseudo) / (n[1] + blank.prior)) - F.log((F.col("b") + pseudo) / (n[0] + blank.prior))
    llr = odds - F.sqrt(1 / (F.col("a") + pseudo) + 1 / (F.col("b") + pseudo))  # as Lexicon.llr, which decides below
    passing = by_token.where(llr >= blank.least_llr - 1 - 1e-6).collect()
    lexicon = Lexicon({r[0]: r[1] for r in passing}, {r[0]: r[2] for r in passing if r[2]}, n[1], n[0])
    toxic, other = lexicon.toxic, lexicon.other
    keep = {t for t in toxic if lexicon.llr(t) >= lexicon.least_llr - 1}
    lexicon = Lexicon({t: toxic[t] for t in keep}, {t: other[t] for t in keep if t in other}, n[1], n[0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {1: Scorer(lexicon, 1, 0), 0: Scorer(lexicon, 0, 1)}
        for b in batches:
            labels = b.column(1).to_pylist()
            found = [_scan(t, by[y]) for t, y in zip(b.column(0).to_pylist(), labels, strict=True)]
            s = [[x for _, _, x in f] for f, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array([k for _, k in found], pa.int64()), pa.array(s, pa.list_(pa.float64()))], ["label", "n", "s"])

    seen = rows.select("text", "label").mapInArrow(frugal(scan), "label int, n long, s array<double>").toPandas()
    # In one order whatever the tasks did, so that sums come out alike; the rows are bounded by the sample.
    seen = seen.iloc[sorted(range(len(seen)), key=lambda i: (seen["label"].iat[i], seen["n"].iat[i], list(seen["s"].iat[i])))]
    y = seen["label"].to_numpy(np.float64)
    clean = seen[y == 0]
    lam, k = _extreme_value(clean["s"].to_list(), clean["n"].to_numpy(np.float64), lexicon.drift)
    model = Model(lexicon, lam, k)
    x = np.array([model.evidence([(0, 0, v) for v in s], m) for s, m in zip(seen["s"], seen["n"], strict=True)])
    model.weights = _logistic(np.log1p(x), y)
    return model


def _extreme_value(found: list, n: np.ndarray, drift: float) -> tuple[float, float]:
    """lambda and K of the law of chance scores, from the segments of clean texts.

    lambda solves E[exp(lambda * score)] = 1 over a clean text's words (its segments stand for the
    positive ones, one pseudo-count keeps it finite); K is its maximum-likelihood value. The texts
    with most positive score, one in 50, are left out: some are toxic and labelled wrongly.
    """
    sums = np.array([float(sum(s)) for s in found])
    if len(sums):
        ok = sums <= np.quantile(sums, 0.98)
        found, n = [s for s, o in zip(found, ok, strict=True) if o], n[ok]
    positive = np.array([v for s in found for v in s] + [3.0])
    words = max(float(n.sum()), 10.0 * len(positive))
    lo, hi = 1e-3, 20.0

    def excess(lam: float) -> float:
        return float(np.exp(np.minimum(lam * positive, 600.0)).sum() / words + (1 - len(positive) / words) * math.exp(-lam * drift) - 1)

    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    lam = (lo + hi) / 2
    best = np.array([max(s) if len(s) else 0.0 for s in found])
    k = len(best) / max(float((n * np.exp(-lam * best)).sum()), 1e-9) if len(best) else 0.1
    return lam, min(max(k, 1e-6), 10.0)


def detect(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, score, predicted, n_passages and passages (start word, end word, score, E) of every document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_passages int, passages array<struct<first:int,last:int,score:double,e:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for b in batches:
            score, spans = [], []
            for text in b.column(1).to_pylist():
                found, n = _scan(text or "", scorer)
                score.append(model.score(model.evidence(found, n)))
                e = [(s, t - 1, v, model.k * max(1, n) * math.exp(-model.lam * v)) for s, t, v in found]
                spans.append([{"first": s, "last": t, "score": v, "e": p} for s, t, v, p in e if p < model.significant])
            s = np.array(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array([len(x) for x in spans], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "n_passages", "passages"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents, with all their columns, whose score is below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for b in batches:
            score = [model.score(model.evidence(*_scan(t or "", scorer))) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([s < threshold for s in score], pa.bool_()))

    return docs.mapInArrow(frugal(run), StructType([StructField(f.name, f.dataType, True) for f in docs.schema]))
