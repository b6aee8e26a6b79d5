"""Per-read verdicts, cytosine reports and linearised methylated-haplotype load.

Reads: templid, rname, strand, start (1-based), xm (one character a reference base), seq if needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as st
from ..functions.contexts import beta, context, passes


def with_pass(reads: DataFrame, threshold: bool = True, threshold_context: str = "CG", min_sites: int = 2, min_beta: float = 0.5, max_out_beta: float = 0.1) -> DataFrame:
    """Add ``pass``: the read threshold, or true for all reads without thresholding."""
    verdict = passes(context(threshold_context), min_sites, min_beta, max_out_beta) if threshold else F.lit(True)
    return reads.withColumn("pass", verdict)


def read_betas(reads: DataFrame, name: str = "CG") -> DataFrame:
    """(templid, beta_in, beta_out) of each read."""
    c = context(name)
    return reads.select("templid", beta("xm", c.meth, c.unmeth).alias("beta_in"), (beta("xm", c.out_meth, c.out_unmeth) if c.out_meth else F.lit(0.0)).alias("beta_out"))


def bases(reads: DataFrame, *extra: Column | str) -> DataFrame:
    """One row a covered base: rname, strand, pos, c and extras. Gaps (``-``, ``+``) are left out before the shuffle."""
    chars = F.posexplode(F.split("xm", ""))
    out = reads.select("rname", "strand", "start", *extra, chars.alias("i", "c")).where(~F.col("c").isin("-", "+", ""))
    return out.withColumn("pos", (F.col("start") + F.col("i")).cast("int")).drop("start", "i")


def _winner(report: tuple[str, ...]) -> Column:
    """The class that more than half of the coverage agrees on, if the report shows it."""
    w = F.when(2 * F.col("n_h") > F.col("cov"), "CHH").when(2 * F.col("n_x") > F.col("cov"), "CHG").when(2 * F.col("n_z") > F.col("cov"), "CG")
    return F.when(w.isin(*report), w)


def _counts() -> list[Column]:
    low = F.lower(F.col("c"))
    return [F.count("*").alias("cov"), *[F.count_if(low == x).alias(f"n_{x}") for x in "hxz"]]


def _of_class(prefix: str) -> Column:
    return F.when(F.col("context") == "CHH", F.col(f"{prefix}h")).when(F.col("context") == "CHG", F.col(f"{prefix}x")).otherwise(F.col(f"{prefix}z"))


#: Class of a character of xm: none, h, x, z, H, X, Z; 7 for gaps.
_KIND = st.table({"hxzHXZ-+": "12345677"}, "0") - ord("0")

#: What a kernel is told of some reads that lie near each other: their bytes, offsets, rows in the batch, and the place of each byte.
Piece = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def per_position(group: tuple[str, ...], payload: str, columns: tuple[str, ...], of: Callable[[pa.RecordBatch, Piece, int], np.ndarray], most: int = st.CHUNK, wanted: dict[tuple, np.ndarray] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: sums by ``group`` and position over pieces of a batch, each of at most ``most`` bytes or one read.

    ``of(batch, piece, n)`` gives an n x columns array of sums by place; places with zeros only are left out, and those
    that ``wanted`` (sorted positions by group) does not name. Reads of a piece follow each other by start and gaps
    between them take no place, so n is at most its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = st.flat(b.column(payload))
            start, size = st.numbers(b.column("start")), np.diff(offsets)
            size[st.nulls(b.column("start"), b.column(payload))] = 0
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[b.column(g).to_pylist() for g in group], strict=True)):
                if size[i] and (wanted is None or key in wanted):
                    by.setdefault(key, []).append(i)
            for key, held in by.items():
                rows = np.array(held)
                rows = rows[np.argsort(start[rows], kind="stable")]
                for i, j in st.chunks(np.concatenate([[0], np.cumsum(size[rows])]), most):
                    yield from summed(b, key, rows[i:j], data, offsets, start, size)

    def summed(b: pa.RecordBatch, key: tuple, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        s, n = start[rows], size[rows]
        reach = np.maximum.accumulate(s + n)
        new = np.concatenate([[True], s[1:] > reach[:-1]])  # reads after a gap
        skipped = np.cumsum(np.where(new, s - np.concatenate([[0], reach[:-1]]), 0))
        o = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(o[-1]) + np.repeat(s - skipped - o[:-1], n)
        x = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows.tolist()])
        out = of(b, (x, o, rows, place), int(reach[-1] - skipped[-1]))
        there = np.flatnonzero(out.any(axis=1))
        if len(there):
            firsts = np.flatnonzero(new)
            pos = there + skipped[firsts][np.searchsorted(s[firsts] - skipped[firsts], there, "right") - 1]
            if wanted is not None:
                own = wanted[key]
                named = own[np.minimum(np.searchsorted(own, pos), len(own) - 1)] == pos
                there, pos = there[named], pos[named]
            names = [pa.repeat(pa.scalar(k, pa.string()), len(there)) for k in key]
            yield pa.RecordBatch.from_arrays([*names, pa.array(pos.astype(np.int32)), *[pa.array(c) for c in out[there].astype(np.int64).T]], [*group, "pos", *columns])

    return run


def per_position_sums(reads: DataFrame, group: tuple[str, ...], payload: str, columns: tuple[str, ...], of: Callable[[pa.RecordBatch, Piece, int], np.ndarray], most: int = st.CHUNK, wanted: dict[tuple, np.ndarray] | None = None) -> DataFrame:
    """``group``, pos and sums of ``columns``, not yet added up over the pieces of all batches."""
    schema = ", ".join([f"`{g}` string" for g in group] + ["pos int"] + [f"`{c}` long" for c in columns])
    return reads.mapInArrow(per_position(group, payload, columns, of, most, wanted), schema)


def _kinds(x: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """n x 8 counts of the classes of ``x`` by place."""
    return np.bincount(place * 8 + _KIND[x], minlength=n * 8).reshape(n, 8)


def cytosine_report(reads: DataFrame, threshold: bool = True, threshold_context: str = "CG", min_sites: int = 2, min_beta: float = 0.5, max_out_beta: float = 0.1, report_context: str | None = None) -> DataFrame:
    """rname, strand, pos, context, meth, unmeth: one shuffle on (rname, pos, strand); bases are counted in Arrow batches before it.

    Reads that fail the threshold count as unmethylated throughout.
    """
    shown = context(report_context or threshold_context).reported
    r = with_pass(reads, threshold, threshold_context, min_sites, min_beta, max_out_beta)
    r = r.select("rname", "strand", F.col("start").cast("int").alias("start"), F.when(F.col("pass"), F.col("xm")).otherwise(F.lower("xm")).alias("xm"))
    names = ("cov", *[f"n_{x}" for x in "hxz"], *[f"m_{x}" for x in "hxz"])

    def counts(b: pa.RecordBatch, piece: Piece, n: int) -> np.ndarray:
        k = _kinds(piece[0], piece[3], n)
        return np.column_stack([k[:, :7].sum(axis=1), k[:, 1:4] + k[:, 4:7], k[:, 4:7]])

    g = per_position_sums(r, ("rname", "strand"), "xm", names, counts).groupBy("rname", "pos", "strand").agg(*[F.sum(c).alias(c) for c in names])
    g = g.withColumn("context", _winner(shown)).where(F.col("context").isNotNull())
    return g.select("rname", "strand", "pos", "context", _of_class("m_").alias("meth"), (_of_class("n_") - _of_class("m_")).alias("unmeth"))


def _load(n: np.ndarray, cap: int) -> np.ndarray:
    """Number of sub-stretches, each weighed by its length, of a stretch of n sites, n capped."""
    k = np.minimum(n, cap).astype(np.int64)
    return k * (k + 1) * (k + 2) // 6


def _added(place: np.ndarray, value: np.ndarray, rows: int, n: int) -> np.ndarray:
    """Exact sums of ``value`` by place, at most ``rows`` of them a place: in halves where a double can't hold them."""
    if int(value.max(initial=0)) * rows < 2**53:
        return np.bincount(place, value, n).astype(np.int64)
    return (np.bincount(place, value >> 26, n).astype(np.int64) << 26) + np.bincount(place, value & (2**26 - 1), n).astype(np.int64)


def _stretches(x: np.ndarray, o: np.ndarray, meth: np.ndarray, unmeth: np.ndarray, cap: int) -> np.ndarray:
    """The load of each base: a read is cut after each unmethylated in-context base; between the first and the last
    methylated base of a part, every base carries the load of the part."""
    at = np.flatnonzero(meth)
    out = np.zeros(len(x) + 1, np.int64)
    if len(at):
        part = np.cumsum(unmeth)[at] + np.searchsorted(o, at, "right")  # rises with each cut and each read
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        s = _load(last - first + 1, cap)
        out[at[first]] += s
        np.subtract.at(out, at[last] + 1, s)
    return np.cumsum(out[:-1])


def mhl_report(reads: DataFrame, name: str = "CG", max_window: int = 0, min_length: int = 0, max_out_beta: float = 0.1) -> DataFrame:
    """rname, strand, pos, context, coverage, length, lmhl.

    Stretches of reads are found in Arrow batches, and loads are summed by position before the one shuffle.
    """
    c = context(name)
    cap = max_window or 65535
    sets = c.meth, c.unmeth, "".join(x for x in "ZXHU" if x not in c.meth), "".join(x for x in "zxhu" if x not in c.unmeth)
    is_meth, is_unmeth, is_out_meth, is_out_unmeth = (st.table({s: "1" * len(s)}, "0") == ord("1") for s in sets)
    names = ("cov", *[f"n_{x}" for x in "hxz"], "hs", "num", "den")

    def loads(b: pa.RecordBatch, piece: Piece, n: int) -> np.ndarray:
        x, o, rows, place = piece
        count = lambda which: np.add.reduceat(which[x], o[:-1], dtype=np.int64)
        hs, om = count(is_meth | is_unmeth), count(is_out_meth)
        out = om + count(is_out_unmeth)
        # Without out-of-context sites the fraction is undefined and the read stays.
        kept = (hs >= min_length) & ~((out > 0) & (om / np.maximum(out, 1) > max_out_beta))
        num = _stretches(x, o, is_meth[x], is_unmeth[x], cap)
        there = np.repeat(kept, np.diff(o)) & (_KIND[x] != 7)
        at, of = place[there], np.repeat(np.arange(len(rows)), np.diff(o))[there]
        k = _kinds(x[there], at, n)
        return np.column_stack([k[:, :7].sum(axis=1), k[:, 1:4] + k[:, 4:7], *[_added(at, v, len(rows), n) for v in (hs[of], num[there], _load(hs, cap)[of])]])

    r = reads.select("rname", "strand", F.col("start").cast("int").alias("start"), "xm")
    g = per_position_sums(r, ("rname", "strand"), "xm", names, loads).groupBy("rname", "pos", "strand").agg(*[F.sum(x).alias(x) for x in names])
    g = g.withColumn("context", _winner(c.reported)).where(F.col("context").isNotNull()).withColumn("coverage", _of_class("n_"))
    return g.select("rname", "strand", "pos", "context", "coverage", (F.col("hs") / F.col("coverage").cast("double")).alias("length"), F.coalesce(F.try_divide(F.col("num").cast("double"), F.col("den").cast("double")), F.lit(0.0)).alias("lmhl"))
