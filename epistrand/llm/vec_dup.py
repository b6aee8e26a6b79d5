"""Near-duplicate embeddings: a subspace pigeonhole join.

Unit vectors have cosine c or more exactly if their squared distance is at most 2 - 2c. They are
rotated to principal axes (from a bounded sample; any rotation is exact) and split into blocks, and
the squared distance is split among the blocks in proportion to their variance: a linked pair must
keep within budget in one block at least. Each block has a grid on its two leading axes with cells as
wide as its radius, so that partners sit in neighbouring cells; half of the neighbours see a copy.
Inside a cell, pairs within the block's budget are verified on the original vectors in double
precision, and counted by the first block whose budget they keep, so each once. A cell emits counts
and a spanning set of links only, never its pairs. Crowded cells are cut into chunks; a task holds one
chunk and streams all others that meet it past, members of later chunks and visitors alike.

Equal vectors with equal labels form one class with a weight before anything else, so ties and
repeated rows cost nothing. Nulls: vectors that are null, zero or hold null or non-finite numbers, and
rows without a label, link with nothing. Vectors of different length are never compared; each length
is searched apart. Null ids are counted as partners. Columns other than ``vec_id``, ``label`` and
``embedding`` play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, frugal, stage

#: Vectors that the rotation is fitted on, at most (in expectation).
SAMPLE = 20_000
#: Vectors of a chunk of a crowded cell, at least, and crowded cells, at most.
CHUNK = 4096
CROWDED = 50_000
_FORWARD = ((1, 0), (-1, 1), (0, 1), (1, 1))
_ROW = "cell long, chunk int, role int, cid long, weight long, vec binary"


def is_valid(vec: str) -> F.Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class Rotation:
    """Principal axes cut into blocks, with their budgets and grid widths."""

    def __init__(self, sample: np.ndarray, dim: int, blocks: int, limit: float):
        blocks = max(1, min(blocks, dim))
        cov = np.cov(sample.T) if len(sample) > dim else np.eye(dim)
        energy, axes = np.linalg.eigh(np.atleast_2d(cov))
        order = np.argsort(-energy)
        # Dealt like cards, so that each block leads with a strong axis.
        self.parts = [order[b::blocks] for b in range(blocks)]
        self.axes = axes
        power = np.array([max(energy[p].sum(), 1e-12) for p in self.parts])
        self.budget = limit * power / power.sum() * (1 + 1e-9) + 1e-12
        self.side = np.sqrt(self.budget)

    def turn(self, unit: np.ndarray) -> list[np.ndarray]:
        r = unit @ self.axes
        return [r[:, p] for p in self.parts]


def _unit(vec: np.ndarray) -> np.ndarray:
    return vec / np.linalg.norm(vec, axis=1, keepdims=True)


def _cell_hash(label: np.ndarray, block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    from ._words import mix64

    x = mix64(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(block + 1))
    x = mix64(x ^ mix64(a.astype(np.int64).astype(np.uint64) + np.uint64(0x1234567)))
    return mix64(x ^ (mix64(b.astype(np.int64).astype(np.uint64)) + np.uint64(0x7654321))).astype(np.int64)


def _homes(r: list[np.ndarray], rot: Rotation, block: int) -> tuple[np.ndarray, np.ndarray]:
    x = r[block]
    second = x[:, 1] if x.shape[1] > 1 else np.zeros(len(x))
    return np.floor(x[:, 0] / rot.side[block]).astype(np.int64), np.floor(second / rot.side[block]).astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class _Side:
    """Vectors of one side of a comparison, with their norms and rotated blocks."""

    def __init__(self, rot: Rotation, block: int, cid: np.ndarray, weight: np.ndarray, vec: np.ndarray):
        self.cid, self.weight, self.vec = cid, weight, vec
        self.norm = np.linalg.norm(vec, axis=1)
        self.r = rot.turn(vec / self.norm[:, None])
        self.sq = (self.r[block] ** 2).sum(1)


def _links_between(rot: Rotation, block: int, threshold: float, left: _Side, right: _Side, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (index on the left, index on the right), each once, that this block answers for."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    x, y = left.r[block], right.r[block]
    for s in range(0, len(x), 1024):
        for t in range(s if same else 0, len(y), 4096):
            d = left.sq[s : s + 1024, None] + right.sq[None, t : t + 4096] - 2 * (x[s : s + 1024] @ y[t : t + 4096].T)
            p, q = np.nonzero(d <= rot.budget[block] + 1e-9)
            p, q = p + s, q + t
            if same:
                p, q = p[p < q], q[p < q]
            for c in range(0, len(p), 100_000):
                u, v = p[c : c + 100_000], q[c : c + 100_000]
                ok = ((x[u] - y[v]) ** 2).sum(1) <= rot.budget[block]
                for b in range(block):
                    ok &= ((left.r[b][u] - right.r[b][v]) ** 2).sum(1) > rot.budget[b]
                u, v = u[ok], v[ok]
                ok = (left.vec[u] * right.vec[v]).sum(1) / (left.norm[u] * right.norm[v]) >= threshold
                if ok.any():
                    found.append((u[ok], v[ok]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class _Cell:
    """One chunk of a cell: holds its members, counts their links among themselves and with what is streamed past."""

    def __init__(self, rot: Rotation, block: int, threshold: float, cid: np.ndarray, weight: np.ndarray, vec: np.ndarray):
        self.args, self.held = (rot, block, threshold), _Side(rot, block, cid, weight, vec)
        a, b = _links_between(*self.args, self.held, self.held, True)
        self.links = np.bincount(a, weight[b], len(cid)).astype(np.int64) + np.bincount(b, weight[a], len(cid)).astype(np.int64)
        self.root = _roots(len(cid), a, b)

    def meet(self, cid: np.ndarray, weight: np.ndarray, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cid, links, root) of the streamed ones that are linked with a held one."""
        rot, block, _ = self.args
        other = _Side(rot, block, cid, weight, vec)
        a, b = _links_between(*self.args, other, self.held, False)
        n = len(self.root)
        self.links += np.bincount(b, weight[a], n).astype(np.int64)
        root = _roots(n + len(cid), np.concatenate([np.arange(n), b]), np.concatenate([self.root, a + n]))
        self.root = root[:n]
        links = np.bincount(a, self.held.weight[b], len(cid))
        hit = np.flatnonzero(links > 0)
        return cid[hit], links[hit], self.held.cid[root[n + hit]]

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hit = np.flatnonzero(self.links > 0)
        return self.held.cid[hit], self.links[hit], self.held.cid[self.root[hit]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, blocks: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = is_valid("v") & F.col("label").isNotNull()
    rows = stage(rows.select("vec_id", F.when(usable, F.xxhash64("label", "v")).alias("cid"), F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("v")).alias("v")), "vectors")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("weight"), F.min("vec_id").alias("id"))
    classes = stage(classes, "classes")
    # A class alone in its length has no partner.
    dims = [r[0] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()]
    part = spark.createDataFrame([], "cid long, links long, root long")
    for d in dims:
        part = part.union(stage(_links(classes.where(F.size("v") == d), d, threshold, blocks), "links"))
    counts = part.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(part.where("root is not null"), "cid", "root")
    per = classes.join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    per = stage(per.select("cid", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "per")
    least = per.groupBy("root").agg(F.min("id").alias("component"))
    per = per.join(least, "root").select("cid", "n_links", "component")
    out = rows.join(per, "cid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, dim: int, threshold: float, blocks: int) -> DataFrame:
    """(cid, links, root): partial counts of linked vectors, and spanning links between classes."""
    n = classes.count()
    take = classes if n <= SAMPLE else classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / n))
    sample = take.select("cid", "v").toPandas().sort_values("cid")["v"]
    rot = Rotation(_unit(np.stack(sample.to_list())) if len(sample) else np.zeros((0, dim)), dim, blocks, max(0.0, 2 - 2 * threshold))
    n_blocks = len(rot.parts)

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        col = lambda k: b.column(k).to_numpy(zero_copy_only=False)
        return col("cid"), col("label"), col("weight"), np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, label, _, vec = read(b)
            r = rot.turn(_unit(vec)) if len(vec) else []
            cells = [_cell_hash(label, k, *_homes(r, rot, k)) for k in range(n_blocks)] if len(vec) else [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells))], ["cell"])

    cols = classes.select("cid", "label", "weight", "v")
    most = max(CHUNK, n * n_blocks // CROWDED + 1)
    # At most n * n_blocks / most <= CROWDED rows.
    crowded = {r[0]: -(-r[1] // most) for r in cols.mapInArrow(frugal(count), "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid_all, label_all, weight_all, vec_all = read(batch)
            for s in range(0, len(cid_all), 2000):
                cid, label, weight, vec = (x[s : s + 2000] for x in (cid_all, label_all, weight_all, vec_all))
                packed = [v.tobytes() for v in vec]
                r = rot.turn(_unit(vec))
                for k in range(n_blocks):
                    a, b = _homes(r, rot, k)
                    out: list[tuple[int, int, int, int]] = []  # cell, chunk, role, row; role 0: held, 1: streamed
                    for visits, (da, db) in [(False, (0, 0)), *[(True, f) for f in _FORWARD]]:
                        for row, cell in enumerate(_cell_hash(label, k, a + da, b + db).tolist()):
                            chunks = crowded.get(cell, 1)
                            if visits:
                                out += [(cell, c, 1, row) for c in range(chunks)]
                            else:
                                own = int(cid[row]) % chunks
                                out += [(cell, c, int(c < own), row) for c in range(own + 1)]
                    t = np.array(out, dtype=np.int64).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t[:, 0]), pa.array(t[:, 1].astype(np.int32)), pa.array((t[:, 2] + 2 * k).astype(np.int32)), pa.array(cid[t[:, 3]]), pa.array(weight[t[:, 3]]), pa.array([packed[x] for x in t[:, 3]], pa.binary())],
                        ["cell", "chunk", "role", "cid", "weight", "vec"])

    dealt = cols.mapInArrow(frugal(deal), _ROW).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None

        def out(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].astype(np.int64)), pa.array(rows[2])], ["cid", "links", "root"])

        def opened(block: int) -> _Cell:
            return _Cell(rot, block, threshold, *(np.concatenate([h[x] for h in held]) for x in range(3)))

        for b in batches:
            at, chunk, role, cid, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "chunk", "role", "cid", "weight"))
            cut = np.flatnonzero((at[1:] != at[:-1]) | (chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                if s == e:
                    continue
                now = (at[s], chunk[s], role[s] // 2)
                if now != key:
                    if key is not None and (held or cell):
                        yield out((cell or opened(key[2])).own())
                    key, held, cell = now, [], None
                rows = cid[s:e], weight[s:e], np.frombuffer(b"".join(b.column("vec").slice(s, e - s).to_pylist()), np.float64).reshape(e - s, dim)
                if role[s] % 2 == 0:
                    held.append(rows)
                elif held or cell:
                    cell = cell or opened(key[2])
                    for x in range(0, e - s, 4096):
                        yield out(cell.meet(*(r[x : x + 4096] for r in rows)))
        if key is not None and (held or cell):
            yield out((cell or opened(key[2])).own())

    return dealt.mapInArrow(frugal(run), "cid long, links long, root long")
