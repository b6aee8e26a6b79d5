"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan.

1. Centres are fitted on a bounded sample; every vector goes to the list of its nearest centre. There
   are more lists the more vectors there are. Lists of more than ``CHUNK`` vectors are cut into chunks.
2. How many lists to probe is measured: sample queries are searched exactly over all rows, and the
   least number of lists that reaches the target recall is taken.
3. A query takes along a bar: its k-th best score among a bounded sample of the candidates. No score
   below it can be among the k best.
4. A task holds one chunk, randomly rotated, and streams the queries that probe its list past it, so
   neither the vectors nor the queries of a list meet in memory, and vectors are not copied. Column
   block by column block, the squared distance seen so far, scaled up, is tested against the bar
   (turned into a distance by the norms); candidates beyond it by ``EPSILON`` standard errors are given
   up (ADSampling, Gao and Long 2023). Survivors are scored on original vectors in double precision.

Nulls: vectors that are null, zero, or hold null or non-finite numbers take no part, as queries or as
candidates, and so do rows without an id. Vectors of each length are searched apart, so long vectors
need no bound. Rows with the query's own id are never its neighbours. Rows that repeat a query's id and
vector are one query; one id with several vectors is a query for each. Candidates count as rows, so a
neighbour's id may repeat if its row does. Ties go to the smaller id. Other columns play no part,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import frugal, stage
from .vec_dup import is_valid

#: Vectors that centres are fitted on, and queries that probing is tuned on, at most (in expectation).
SAMPLE, TUNED = 20_000, 64
#: Vectors that bars are taken from, at most.
BARS = 4096
#: Vectors of a list, about; lists, at most; vectors of a chunk, and queries compared with it at once.
LIST, LISTS, CHUNK, QUERIES = 2048, 1024, 8192, 256
EPSILON, BLOCK = 2.1, 16


def _centres(x: np.ndarray, n: int, seed: int = 5, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.bincount(at, minlength=len(c))
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best: larger score first, then smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Chunk:
    """Vectors of one chunk: original and rotated."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, turn: np.ndarray):
        self.x, self.ids = x, ids
        self.rotated = (x @ turn).astype(np.float32)
        self.squares = (x**2).sum(1)

    def scan(self, q: np.ndarray, q_id: np.ndarray, bar: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, vector index, score) of the ``k`` best of each query that reach its bar."""
        d = self.x.shape[1]
        turned = (q @ turn).astype(np.float32)
        # score >= bar exactly if the squared distance is at most this
        limit = np.maximum((q**2).sum(1)[:, None] + self.squares[None, :] - 2 * bar[:, None], 0).astype(np.float32)
        alive = np.ones(limit.shape, bool)
        seen = np.zeros(limit.shape, np.float32)
        for b in range(0, d - BLOCK, BLOCK):
            p, r = turned[:, b : b + BLOCK], self.rotated[:, b : b + BLOCK]
            seen += (p**2).sum(1)[:, None] + (r**2).sum(1)[None, :] - 2 * (p @ r.T)
            done = b + BLOCK
            alive &= seen * np.float32(d / done) <= limit * np.float32((1 + EPSILON / done**0.5) ** 2) + 1e-6
        alive &= self.ids[None, :] != q_id[:, None]
        i, j = np.nonzero(alive)
        score = np.concatenate([(self.x[j[s : s + 50_000]] * q[i[s : s + 50_000]]).sum(1) for s in range(0, max(1, len(i)), 50_000)])
        ok = score >= bar[i]
        i, j, score = i[ok], j[ok], score[ok]
        order = np.lexsort((self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < k], j[place < k], score[place < k]


def search(vectors: DataFrame, queries: F.Column, k: int = 20, recall: float = 0.97, lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that satisfies ``queries``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("is_query")).where(is_valid("v") & F.col("vec_id").isNotNull())
    rows = stage(rows.withColumn("h", F.xxhash64("vec_id", "v")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("is_query").alias("asked")).where("n > 1 and asked > 0").orderBy("d").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d, n, n_asked in lengths:
        out = out.union(_search(rows.where(F.size("v") == d), d, n, n_asked, k, recall, lists or min(LISTS, -(-n // LIST))))
    return out


def _matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    return np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _search(rows: DataFrame, d: int, n: int, n_asked: int, k: int, recall: float, lists: int) -> DataFrame:
    """``search`` among the ``n`` staged rows of length ``d``, of which ``n_asked`` are queries."""

    def sampled(df: DataFrame, size: int, of: int) -> DataFrame:
        return df if of <= size else df.where(F.pmod(F.shiftright("h", 3), F.lit(1 << 20)) < int((1 << 20) * size / of) + 1)

    taken = sampled(rows, SAMPLE, n).select("vec_id", "v", "h").toPandas().sort_values(["h", "vec_id"], kind="stable")
    sample, sample_id = np.stack(taken["v"].to_list()), taken["vec_id"].to_numpy()
    centres = _centres(sample, lists)
    sample, sample_id = sample[:BARS], sample_id[:BARS]
    turn = np.linalg.qr(np.random.default_rng(11).normal(size=(d, d)))[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array(_nearest(_matrix(b, d), centres).astype(np.int32)) if b.num_rows else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, at], [*b.schema.names, "list"])

    listed = stage(rows.mapInArrow(frugal(assign), "vec_id long, v array<double>, is_query boolean, h long, list int"), "listed")
    asked = stage(listed.where("is_query").dropDuplicates(["h"]).select("vec_id", "v", "h"), "asked")
    probes = _probes(listed, sampled(asked, TUNED, n_asked), centres, k, recall)

    # One row a list, and there are LISTS at most.
    chunks = {r[0]: -(-r[1] // CHUNK) for r in listed.groupBy("list").agg(F.count("*")).collect()}
    chunk_of = F.create_map(*[F.lit(int(x)) for kv in chunks.items() for x in kv])
    names = ["list", "chunk", "asks", "id", "h", "bar", "v"]
    row = "list int, chunk int, asks boolean, id long, h long, bar double, v array<double>"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                v, ids = _matrix(b, d), b.column("vec_id").to_numpy(zero_copy_only=False)
                score = v @ sample.T
                score[ids[:, None] == sample_id[None, :]] = -np.inf
                bar = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k] if len(sample) > k else np.full(len(v), -np.inf)
                bar -= 1e-9 * np.abs(np.where(np.isfinite(bar), bar, 0.0))
                # A centre's inner product bounds what its list can offer, on average.
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
                at = np.array([(i, c, x) for i in range(len(v)) for c in near[i].tolist() for x in range(chunks.get(c, 0))], np.int64).reshape(-1, 3)
                take = pa.array(at[:, 0])
                cols = [pa.array(at[:, 1].astype(np.int32)), pa.array(at[:, 2].astype(np.int32)), pa.array(np.ones(len(at), bool)), b.column("vec_id").take(take), b.column("h").take(take), pa.array(bar[at[:, 0]]), b.column("v").take(take)]
                yield pa.RecordBatch.from_arrays(cols, names)

    right = asked.mapInArrow(frugal(probe), row)
    chunk = F.pmod(F.col("h"), F.element_at(chunk_of, F.col("list"))).cast("int")
    left = listed.select("list", chunk.alias("chunk"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "h", F.lit(0.0).alias("bar"), "v")
    dealt = left.union(right).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, at = None, [], [], None
        for b in batches:
            where = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "chunk", "asks")])
            cut = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(where)], strict=True):
                if s == e:
                    continue
                part, now = b.slice(s, e - s), tuple(where[s, :2].tolist())
                if now != key:
                    key, held, ids, at = now, [], [], None
                if not where[s, 2]:
                    held.append(_matrix(part, d))
                    ids.append(part.column("id").to_numpy(zero_copy_only=False))
                    continue
                if at is None and held:
                    at, held = Chunk(np.concatenate(held), np.concatenate(ids), turn), []
                if at is None:
                    continue
                q, q_id, h, bar = _matrix(part, d), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h", "bar"))
                for x in range(0, len(q), QUERIES):
                    y = slice(x, x + QUERIES)
                    i, j, score = at.scan(q[y], q_id[y], bar[y], turn, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_id[y][i]), pa.array(h[y][i]), pa.array(at.ids[j]), pa.array(score)], ["query_id", "h", "vec_id", "score"])

    found = dealt.mapInArrow(frugal(meet), "query_id long, h long, vec_id long, score double")
    best = Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probes(listed: DataFrame, sample: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe: the least number that finds ``recall`` of the true neighbours of the sample queries."""
    asked = sample.select("vec_id", "v").orderBy("vec_id").toPandas()
    q, ids = np.stack(asked["v"].to_list()), asked["vec_id"].to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, x_id, at = np.stack(b["v"].to_list()), b["vec_id"].to_numpy(), b["list"].to_numpy()
                score = q @ x.T
                score[ids[:, None] == x_id[None, :]] = -np.inf
                for i in range(len(q)):
                    t = _top(score[i], x_id, min(k, len(x)))
                    yield pd.DataFrame({"i": i, "vec_id": x_id[t], "list": at[t], "score": score[i][t]})

    top = listed.select("vec_id", "v", "list").mapInPandas(exact, "i int, vec_id long, list int, score double")
    best = Window.partitionBy("i").orderBy(F.col("score").desc(), "vec_id")
    top = top.withColumn("r", F.row_number().over(best)).where((F.col("r") <= k) & (F.col("score") > float("-inf"))).select("i", "list").toPandas()
    rank = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    need = np.sort(rank[top["i"].to_numpy(), top["list"].to_numpy()])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1 if len(need) else len(centres)
