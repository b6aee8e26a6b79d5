"""Target regions: first-match interval joins, region reports, ECDFs, interval reduction.

Targets: bed_row (order of the file), seqnames, start, end, and any further columns.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import strings as st
from ..functions.contexts import beta, context
from .reports import with_pass

#: Up to so many targets are looked up in arrays that each task holds; more are joined on blocks of positions.
BROADCAST_TARGETS = 500_000
_NONE = np.iinfo(np.int64).max


def _read_end() -> Column:
    return F.col("start") + F.length("xm") - 1


def match_targets(reads: DataFrame, targets: DataFrame, kind: str = "amplicon", tolerance: int = 1, min_overlap: int = 1) -> DataFrame:
    """Reads with ``bed_row``, the first target that matches, or null.

    ``amplicon``: start or end within ``tolerance``; ``capture``: an overlap of ``min_overlap`` or more.
    """
    if kind not in ("amplicon", "capture"):
        raise ValueError(f"unknown kind {kind!r}; amplicon or capture")
    t = targets.select("bed_row", F.col("seqnames").alias("s"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"))
    if kind == "capture":  # shortened by the overlap less one, targets and reads need only share a base
        t = t.withColumn("b", F.col("b") - min_overlap + 1).where("b >= a")
    t = t.where("s IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND bed_row IS NOT NULL")
    few = t.limit(BROADCAST_TARGETS + 1).toArrow()
    if few.num_rows <= BROADCAST_TARGETS:
        return _looked_up(reads, few, targets.schema["bed_row"].dataType, kind, tolerance, min_overlap)
    return reads.join(_joined(reads, t, kind, tolerance, min_overlap), "templid", "left")


class _Least:
    """The least row of points within a range: a table of minima over powers of two, made in each task."""

    def __init__(self, at: np.ndarray, row: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        self.at, self.row, self.table = at[order], row[order], None

    def within(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = [self.row]
            while (width := 1 << len(self.table)) <= len(self.row):
                x = self.table[-1]
                self.table.append(np.minimum(x[: len(self.row) - width + 1], x[width // 2 : len(self.row) - width // 2 + 1]))
        i, j = np.searchsorted(self.at, lo, "left"), np.searchsorted(self.at, hi, "right")
        out = np.full(len(i), _NONE)
        level = np.frexp(np.maximum(j - i, 0))[1] - 1
        for k in np.unique(level[j > i]):
            w = np.flatnonzero((level == k) & (j > i))
            out[w] = np.minimum(self.table[k][i[w]], self.table[k][j[w] - (1 << int(k))])
        return out


class _Covering:
    """The least row of the intervals over a point: a step function, found in one sweep."""

    def __init__(self, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        begins, ends, rows = a[order].tolist(), b[order].tolist(), row[order].tolist()
        self.at = np.unique(np.concatenate([a, b + 1]))
        least, open_, k = [], [], 0
        for p in self.at.tolist():
            while k < len(begins) and begins[k] == p:
                heapq.heappush(open_, (rows[k], ends[k]))
                k += 1
            while open_ and open_[0][1] < p:
                heapq.heappop(open_)
            least.append(open_[0][0] if open_ else _NONE)
        self.least = np.array([_NONE, *least], np.int64)

    def over(self, p: np.ndarray) -> np.ndarray:
        return self.least[np.searchsorted(self.at, p, "right")]


def _looked_up(reads: DataFrame, targets: pa.Table, row_type, kind: str, tolerance: int, min_overlap: int) -> DataFrame:
    """``match_targets`` for few targets: a read looks up minima by bisection, however many targets it meets, with no shuffle.

    A captured target lies over the first base of the read or starts further on in it; an amplicon's start or end is
    within a range.
    """
    names = np.array(targets["s"].to_pylist(), object)
    a, b, row = (targets[c].to_numpy().astype(np.int64) for c in ("a", "b", "bed_row"))
    by = {}
    for name in set(names.tolist()):
        own = names == name
        starts = _Least(a[own], row[own])
        by[name] = (starts, _Covering(a[own], b[own], row[own]) if kind == "capture" else _Least(b[own], row[own]))
    arrow = to_arrow_type(row_type)

    def first(rname: pa.Array, start: pa.Array, length: pa.Array) -> pa.Array:
        rs, n = st.numbers(start), st.numbers(length)
        out, there = np.full(len(rs), _NONE), ~st.nulls(rname, start, length)
        coded = rname.dictionary_encode()
        code = st.numbers(coded.indices)
        for i, name in enumerate(coded.dictionary.to_pylist()):
            if name not in by:
                continue
            w = np.flatnonzero(there & (code == i))
            if kind == "capture":
                w = w[n[w] >= min_overlap]
                s, e = rs[w], rs[w] + n[w] - min_overlap
                found = by[name][1].over(s), by[name][0].within(s + 1, e)
            else:
                e = rs[w] + n[w] - 1
                found = [x.within(p - tolerance, p + tolerance) for x, p in zip(by[name], (rs[w], e), strict=True)]
            out[w] = np.minimum(*found)
        return pa.array(np.where(out == _NONE, 0, out), mask=out == _NONE).cast(arrow)

    return reads.withColumn("bed_row", F.arrow_udf(first, row_type)("rname", "start", F.length("xm")))


def _blocks(a: str, b: str, which: int) -> str:
    """SQL: the blocks of powers of two that make up the positions from ``a`` to ``b``, two a power at most."""
    lo, hi = f"(-shiftright(-({a}), k))", f"shiftright(({b}) + 1, k)"
    one = lambda ends, block: f"CASE WHEN {lo} < {hi} AND {ends} % 2 <> 0 THEN named_struct('w', {which}, 'k', k, 'p', {block}) END"
    return f"filter(flatten(transform(sequence(0, 40), k -> array({one(lo, lo)}, {one(hi, f'{hi} - 1')}))), x -> x IS NOT NULL)"


def _around(a: str, which: int) -> str:
    """SQL: the blocks of every power of two that ``a`` lies in."""
    return f"transform(sequence(0, 40), k -> named_struct('w', {which}, 'k', k, 'p', shiftright({a}, k)))"


def _joined(reads: DataFrame, t: DataFrame, kind: str, tolerance: int, min_overlap: int) -> DataFrame:
    """(templid, bed_row) for many targets: both sides meet on blocks of positions, each of which keeps its least row.

    So rows grow with reads and targets, not with the pairs of them that match.
    """
    r = reads.select("templid", F.col("rname").alias("s"), F.col("start").cast("long").alias("a"), _read_end().cast("long").alias("b"))
    if kind == "capture":
        r = r.withColumn("b", F.col("b") - min_overlap + 1).where("b >= a")
        held, asked = (_blocks("a", "b", 0), _around("a", 1)), (_around("a", 0), _blocks("a + 1", "b", 1))
    else:
        near = lambda c, which: _blocks(f"{c} - {tolerance}", f"{c} + {tolerance}", which)
        held, asked = (_around("a", 0), _around("b", 1)), (near("a", 0), near("b", 1))
    at = lambda df, parts, *keep: df.select(*keep, "s", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select(*keep, "s", "x.w", "x.k", "x.p")
    least = at(t, held, "bed_row").groupBy("s", "w", "k", "p").agg(F.min("bed_row").alias("bed_row"))
    return at(r, asked, "templid").join(least, ["s", "w", "k", "p"]).groupBy("templid").agg(F.min("bed_row").alias("bed_row"))


def region_report(reads: DataFrame, targets: DataFrame, kind: str = "amplicon", threshold: bool = True, tolerance: int = 1, min_overlap: int = 1, **thresholds) -> DataFrame:
    """Targets with ``nreads+``, ``nreads-`` and ``VEF``; targets without reads have nulls, unmatched reads a row without a target."""
    m = match_targets(with_pass(reads, threshold, **thresholds), targets, kind, tolerance, min_overlap)
    g = m.groupBy("bed_row").agg(F.count_if(F.col("strand") == "+").alias("nreads+"), F.count_if(F.col("strand") == "-").alias("nreads-"), F.count_if("pass").alias("_p"), F.count("*").alias("_n"))
    vef = F.col("_p") / F.col("_n").cast("double") if threshold else F.lit(None).cast("double")
    g = g.select("bed_row", "nreads+", "nreads-", vef.alias("VEF"))
    return targets.join(g, "bed_row", "full")


def amplicon_report(reads: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    return region_report(reads, targets, kind="amplicon", **kw)


def capture_report(reads: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    return region_report(reads, targets, kind="capture", **kw)


def region_ecdf(reads: DataFrame, targets: DataFrame, kind: str = "amplicon", ecdf_context: str = "CG", rows: list[int] | None = None, tolerance: int = 1, min_overlap: int = 1) -> DataFrame:
    """(bed_row, kind, beta, cum_frac): the distribution functions of read betas in and out of context, per target.

    ``rows``: the targets wanted; all, and the unmatched reads, by default.
    """
    c = context(ecdf_context)
    m = match_targets(reads, targets, kind, tolerance, min_overlap)
    if rows is not None:
        m = m.where(F.col("bed_row").isin(rows))
    out = beta("xm", c.out_meth, c.out_unmeth) if c.out_meth else F.lit(0.0)
    both = F.explode(F.array(F.struct(F.lit("context").alias("kind"), beta("xm", c.meth, c.unmeth).alias("beta")), F.struct(F.lit("out.of.context").alias("kind"), out.alias("beta"))))
    long = m.select("bed_row", both.alias("x")).select("bed_row", "x.kind", "x.beta")
    # Equal betas are counted first, so a window sees distinct values only.
    g = long.groupBy("bed_row", "kind", "beta").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bed_row", "kind")
    upto = F.sum("n").over(w.orderBy("beta").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("bed_row", "kind", "beta", (upto / F.sum("n").over(w).cast("double")).alias("cum_frac"))


def ecdf_at(ecdf: DataFrame, x: float) -> DataFrame:
    """(bed_row, kind, value): F(x)."""
    return ecdf.groupBy("bed_row", "kind").agg(F.coalesce(F.max(F.when(F.col("beta") <= x, F.col("cum_frac"))), F.lit(0.0)).alias("value"))


def reduce_intervals(targets: DataFrame) -> DataFrame:
    """(seqnames, start, end): unions of overlapping or adjacent intervals.

    Windows run inside (chromosome, megabase) cells first, so that a chromosome is not one task until
    its intervals have been merged cell by cell.
    """
    t = targets.select("seqnames", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    for cell in (F.floor(F.col("start") / 1_000_000), F.lit(0)):
        t = t.withColumn("_c", cell)
        w = Window.partitionBy("seqnames", "_c").orderBy("start", "end")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        t = t.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
        t = t.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        t = t.groupBy("seqnames", "_c", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("seqnames", "start", "end")
    return t
