"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (byte classes, words, lines, repetition) are the only inputs of a
score. Trees are grown on the driver from a bounded sample of labelled rows, level by level over
binned statistics, and flattened into arrays; scoring walks all rows down each tree at once.

A null text counts as empty and gets a score. Documents without a label are scored like others; a
null id is never labelled. Repeated rows get equal scores. Texts are measured whole, however long;
columns other than ``doc_id`` and ``text`` play no part, whatever their names; splits of equal gain
go to the earlier statistic and the lower threshold. Without labels of both kinds every score
is the share of label 1 (0.5 without any label). An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import frugal

#: Labelled rows that the trees are grown from, at most (in expectation; rows are taken by a hash of their id).
MAX_LABELLED = 40_000

_GROUPS = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " ", "\n", ".,", "#%&*$", "|", "!?", "@", "<>{}[]()=;/\\_", "-'\":")
_TABLE = np.zeros((256, len(_GROUPS) + 1))
for _i, _g in enumerate(_GROUPS):
    _TABLE[[ord(c) for c in _g], _i] = 1
_TABLE[128:, len(_GROUPS)] = 1
N_FEATURES = _TABLE.shape[1] + 11


def statistics(text: str) -> np.ndarray:
    """The statistics of one whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = max(1, len(data))
    share = counts @ _TABLE / n
    p = counts[counts > 0] / n
    words = text.split()
    distinct = Counter(words)
    lines = [x for x in text.split("\n") if x]
    w = max(1, len(words))
    rest = [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / w, len(distinct) / w,
        max(distinct.values(), default=0) / w, len(lines) / w, len(set(lines)) / max(1, len(lines)),
        sum(k[:1].isupper() * v for k, v in distinct.items()) / w, sum(v for k, v in distinct.items() if not k[-1:].isalnum()) / w,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, max(map(len, distinct), default=0),
    ]
    return np.concatenate([share, rest])


@dataclass
class Forest:
    """Complete trees of one depth as arrays: internal nodes by level, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            raw += self.leaf[t, node - inner]
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Gradient boosting on the log loss; splits come from per-node histograms of gradients."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n_feat = x.shape[1]
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            best = np.zeros(width)
            for f in range(n_feat):
                key = at * bins + code[:, f]
                hg = np.bincount(key, g, width * bins).reshape(width, bins)
                hh = np.bincount(key, h, width * bins).reshape(width, bins)
                gl, hl = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
                gs, hs = hg.sum(1, keepdims=True), hh.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain = np.where((hl > least) & (hs - hl > least), gain, 0)[:, : len(edges[f])]
                if gain.size:
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best = np.where(better, top, best)
                    feature[t, first : first + width][better] = f
                    threshold[t, first : first + width][better] = edges[f][k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        out = node - inner
        leaf[t] = -rate * np.bincount(out, g, leaves) / (np.bincount(out, h, leaves) + l2)
        raw += leaf[t, out]
    return Forest(feature, threshold, leaf, base)


def sample_of(labels: DataFrame, label_col: str, trained: Column, most: int) -> DataFrame:
    """(_id, label): labelled rows of the training part, at most about ``most`` by a hash of the id, one row an id."""
    rows = labels.where(trained & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows


def measured(docs: DataFrame, extra: list[str]) -> DataFrame:
    """The columns ``extra`` of documents and their statistics as an array ``x``."""
    cols = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([statistics(t or "") for t in b.column("text").to_pylist()]) if b.num_rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in extra], pa.array(list(x), pa.list_(pa.float64()))], [*extra, "x"])

    return docs.select(*extra, "text").mapInArrow(frugal(run), ", ".join([*cols, "x array<double>"]))


def fit(docs: DataFrame, sample: DataFrame, **options) -> Forest:
    """Grow a forest from the labelled rows; ``sample`` is bounded, so it is broadcast to leave the texts where they are."""
    texts = docs.select(F.col("doc_id").alias("__doc"), "text")
    labelled = texts.join(F.broadcast(sample.select(F.col("_id").alias("__id"), "label")), F.col("__doc") == F.col("__id")).select("text", "label")
    rows = measured(labelled, ["label"]).toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, N_FEATURES))
    y = rows["label"].to_numpy(np.float64)
    # In one order whatever the tasks did, so that the trees come out alike; the rows are bounded by the sample.
    order = np.lexsort((*x.T, y))
    return grow(x[order], y[order], **options)


def classify(docs: DataFrame, forest: Forest, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([statistics(t or "") for t in b.column("text").to_pylist()]) if b.num_rows else np.zeros((0, N_FEATURES))
            s = forest.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
