"""From alignment records to reads in reference space.

Alignments: qname, flag, rname, pos (1-based), mapq, cigar, pnext, tlen, seq, qual (Phred+33), xm, xg;
long reads have mm and ml (array of int) instead of xm. ``rec_no`` orders the records of a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as st

# Bits of the SAM flag.
UNMAPPED, PROPER, MATE_UNMAPPED, REVERSE, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 4, 2, 8, 16, 256, 512, 1024, 2048
SNIFFED = 1024
_KNOWN_TAGS = ("XM", "XG", "YD", "ZS", "MM", "ML")


class AlignmentError(ValueError):
    """The alignments can't be used as they are."""


def skip_mask(paired: bool = False, skip_duplicates: bool = False, skip_secondary: bool = True, skip_qcfail: bool = True, skip_supplementary: bool = True) -> int:
    bits = (SECONDARY, skip_secondary), (QCFAIL, skip_qcfail), (DUPLICATE, skip_duplicates), (SUPPLEMENTARY, skip_supplementary), (MATE_UNMAPPED, paired)
    return UNMAPPED + sum(b for b, on in bits if on)


def sniff(alignments: DataFrame) -> dict:
    """Counts over the first 1024 records, and what they say: paired, sorted by name, tagged (XM, MM or none)."""
    cols = {c.lower() for c in alignments.columns}
    head = alignments
    if "rec_no" in cols:  # numbers alone say which records come first, so whole ones are neither sorted nor made
        first = [r[0] for r in alignments.select("rec_no").orderBy("rec_no").limit(SNIFFED).collect()]
        last = max((x for x in first if x is not None), default=None)
        early = F.col("rec_no") <= last if last is not None else F.lit(False)
        head = alignments.where((early | F.col("rec_no").isNull()) if None in first else early).orderBy("rec_no")
    there = [F.when(F.col(t).isNotNull(), 1).alias(t.lower()) for t in _KNOWN_TAGS if t.lower() in cols]
    rows = head.select("flag", "qname", *there, *(["rec_no"] if "rec_no" in cols else [])).limit(SNIFFED).toPandas()
    n, proper = len(rows), int((rows["flag"].astype(int) & PROPER > 0).sum()) if len(rows) else 0
    same = int((rows["qname"].iloc[1:].to_numpy() == rows["qname"].iloc[:-1].to_numpy()).sum()) if n > 1 else 0
    tags = {t: int(rows[t.lower()].notna().sum()) for t in _KNOWN_TAGS if t.lower() in rows}
    has = {t for t, k in tags.items() if k}
    if not n:
        raise AlignmentError("no records")
    if "YD" in has and "XG" not in has or "ZS" in has and "XG" not in has:
        raise AlignmentError("strand tags are there, but no XG and XM: call methylation first")
    if "XG" in has and not has & {"XM", "MM"}:
        raise AlignmentError("XG without XM: call methylation first")
    if not has & {"MM", "XM"}:
        raise AlignmentError("neither XM nor MM tags: call methylation first")
    paired = proper > n // 2
    ordered = same > 0 and same >= min(n, proper) // 2
    if paired and not ordered and "MM" not in has:
        raise AlignmentError("paired records must be sorted by name")
    return {"records": n, "proper": proper, "templates": same, "tags": tags, "paired": paired, "sorted": ordered, "tagged": "MM" if "MM" in has else "XM"}


@lru_cache(1 << 12)
def pieces(cigar: str) -> tuple[tuple[int, int], ...]:
    """What the reference space of a read is made of, in order: (from, n) runs of the query, ``from`` -1 for a gap."""
    if not re.fullmatch(r"(?:[0-9]+[MIDNSHP=X])+", cigar):
        raise AlignmentError(f"unknown CIGAR operation: {cigar}")
    out, at = [], 0
    for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        if op in "M=X":
            out.append((at, int(n)))
        elif op in "DN":
            out.append((-1, int(n)))
        at += int(n) if op in "M=XIS" else 0
    return tuple(out)


def laid_out(payload: bytes, parts: tuple[tuple[int, int], ...], fill: bytes) -> bytes:
    """Query string -> reference space: insertions and soft clips go, deletions and skips become ``fill``."""
    if len(parts) == 1 and parts[0][0] == 0:
        return payload[: parts[0][1]]
    return b"".join([payload[a : a + n] if a >= 0 else fill * n for a, n in parts])


def masked(payload: bytes, qual: bytes | None, least: int, fill: bytes) -> bytes:
    """``fill`` where the base quality is below ``least``, and past the qualities of a read that has low ones."""
    if qual is None or least <= 0:
        return payload
    # Qualities are single characters, so they compare as bytes; a read without low ones is left as it is.
    x, q = np.frombuffer(payload, np.uint8), np.frombuffer(qual, np.uint8)[: len(payload)]
    low = q < 33 + least
    if not low.any():
        return payload
    return np.where(low, np.uint8(fill[0]), x[: len(q)]).tobytes() + fill * (len(x) - len(q))


def _layer(fill: str, least: int):
    """A column function of (payload, cigar, qualities): the payload in reference space, bases of low quality masked."""
    gap = fill.encode()

    def lay(payload: pa.Array, cigar: pa.Array, qual: pa.Array) -> pa.Array:
        quals = st.rows_of(qual) if least > 0 else [None] * len(payload)
        rows = zip(st.rows_of(payload), cigar.to_pylist(), quals, strict=True)
        return st.joined([None if x is None or c is None else laid_out(masked(x, q, least, gap), pieces(c), gap) for x, c, q in rows])

    return F.arrow_udf(lay, "string")


def project(payload: Column, cigar: Column, fill: str = "-") -> Column:
    """``laid_out`` as a column: strings are cut in Arrow batches, once, however many operations there are."""
    return _layer(fill, 0)(payload, cigar, F.lit(None).cast("string"))


def _projected(a: DataFrame, min_baseq: int, *keep: Column | str) -> DataFrame:
    """``keep``, seq and xm in reference space, with bases of low quality masked."""
    qual = F.col("qual") if min_baseq > 0 else F.lit(None).cast("string")
    return a.select(*keep, *[_layer(fill, min_baseq)(F.col(c), F.col("cigar"), qual).alias(c) for c, fill in (("seq", "N"), ("xm", "-"))])


def mask(payload: Column, qual: Column, least: int, fill: str) -> Column:
    """``masked`` as a column."""
    gap = fill.encode()

    def cover(x: pa.Array, q: pa.Array) -> pa.Array:
        return st.joined([None if a is None else masked(a, b, least, gap) for a, b in zip(st.rows_of(x), st.rows_of(q), strict=True)])

    return F.arrow_udf(cover, "string")(payload, qual) if least > 0 else payload


def strand_of(xg: Column) -> Column:
    return F.when(F.substring(xg, 1, 1) == "C", "+").otherwise("-")


def trimmed(reads: DataFrame, trim: int | tuple[int, int]) -> DataFrame:
    """Drop bases from both ends in reference orientation; reads that are trimmed away go."""
    t5, t3 = (trim, trim) if isinstance(trim, int) else trim
    if not t5 and not t3:
        return reads
    n = F.length("xm") - t5 - t3
    cut = reads.where(n > 0)
    return cut.withColumns({"seq": F.substring(F.col("seq"), F.lit(t5 + 1), n), "xm": F.substring(F.col("xm"), F.lit(t5 + 1), n), "start": F.col("start") + t5})


_OUT = ["templid", "rname", "strand", "start", "seq", "xm"]


def single_reads(alignments: DataFrame, min_mapq: int = 0, min_baseq: int = 0, trim: int | tuple[int, int] = 0, **skips) -> DataFrame:
    """Single-end records with XM and XG, one read each."""
    a = alignments.where((F.col("flag").bitwiseAND(skip_mask(False, **skips)) == 0) & (F.col("mapq") >= min_mapq) & F.col("xm").isNotNull() & F.col("xg").isNotNull())
    r = _projected(a, min_baseq, F.col("rec_no").alias("templid"), "rname", strand_of(F.col("xg")).alias("strand"), F.col("pos").cast("int").alias("start"))
    return trimmed(r, trim).select(*_OUT)


_PAIR = "templid long, rname string, strand string, start int, seq string, xm string"


def _overlaid(records: list[tuple], min_baseq: int) -> tuple:
    """The template of records (qname, rec_no, rname, strand, pos, left, span, cigar, seq, xm, qual) in order: those of ``_PAIR``."""
    _, no, rname, strand, _, _, span, *_ = records[0]
    parts = [(r[4], *[None if x is None or r[7] is None else laid_out(x, pieces(r[7]), f) for x, f in zip(r[8:], (b"N", b"-", b"!"), strict=True)]) for r in records]
    left = min((r[5] for r in records if r[5] is not None), default=None)
    ends = [r[0] + len(r[2]) - 1 for r in parts if r[0] is not None and r[2] is not None] + ([left + abs(span) - 1] if None not in (left, span) else [])
    if left is None or None in parts[0]:
        return no, rname, strand, left, None, None
    size = max(0, max(ends) - left + 1)
    if any(None in r for r in parts):  # a mate without qualities or a CIGAR leaves no base to tell
        return no, rname, strand, left, b"N" * size, b"-" * size
    best, base, site = np.full(size, 33 + max(min_baseq - 1, 0), np.uint8), np.full(size, ord("N"), np.uint8), np.full(size, ord("-"), np.uint8)
    for pos, seq, xm, qual in parts:
        n = min(len(xm), len(qual))
        q, own = np.frombuffer(qual, np.uint8)[:n], np.frombuffer(seq.ljust(n, b"\0"), np.uint8)[:n]
        here = slice(pos - left, pos - left + n)
        better = q > best[here]
        for to, of in ((best, q), (base, own), (site, np.frombuffer(xm, np.uint8)[:n])):
            np.copyto(to[here], of, where=better)
    return no, rname, strand, left, base.tobytes().replace(b"\0", b""), site.tobytes()


def paired_reads(alignments: DataFrame, min_mapq: int = 0, min_baseq: int = 0, trim: int | tuple[int, int] = 0, **skips) -> DataFrame:
    """Proper pairs merged into templates: at each position the strictly better base wins, the first record on a tie.

    One shuffle on the name moves whole records; sorted by name and number, those of a template follow each other, and
    are projected and laid over each other in Arrow batches.
    """
    a = alignments.where((F.col("flag").bitwiseAND(skip_mask(True, **skips)) == 0) & (F.col("flag").bitwiseAND(PROPER) != 0) & (F.col("mapq") >= min_mapq) & F.col("xm").isNotNull() & F.col("xg").isNotNull())
    p = a.select("qname", F.col("rec_no").cast("long").alias("rec_no"), "rname", strand_of(F.col("xg")).alias("strand"), F.col("pos").cast("int").alias("pos"), F.least("pos", "pnext").cast("int").alias("left"), F.col("tlen").cast("int").alias("span"), "cigar", "seq", "xm", "qual")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(templates: list[tuple]) -> pa.RecordBatch:
            no, rname, strand, left, seq, xm = zip(*templates, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(rname, pa.string()), pa.array(strand, pa.string()), pa.array(left, pa.int32()), st.joined(list(seq)), st.joined(list(xm))], ["templid", "rname", "strand", "start", "seq", "xm"])

        for b in batches:
            done = []
            for r in zip(*[c.to_pylist() for c in b.columns[:8]], *[st.rows_of(c) for c in b.columns[8:]], strict=True):
                if held and held[0][0] != r[0]:
                    done.append(_overlaid(held, min_baseq))
                    held = []
                held.append(r)
            if done:
                yield out(done)
        if held:
            yield out([_overlaid(held, min_baseq)])

    return trimmed(p.repartition("qname").sortWithinPartitions("qname", "rec_no").mapInArrow(merge, _PAIR), trim).select(*_OUT)


_COMPLEMENT = st.table({"ACGTNacgtnRYSWKMBDHV": "TGCANtgcanYRSWMKVHDB"})
# A, C, G, T, N as 0 to 4, ambiguity codes that context lookup reads as one base among them, all else 5.
_CODE = st.table({"ACGTNYSKWDV": "01234011234"}, "5") - ord("0")


def _contexts(reverse: bool) -> np.ndarray:
    """Context of the first base (forward) or of the last base (reverse) of each 3-mer of codes, as bytes."""
    out = np.full((6, 6, 6), ord("."), np.uint8)
    for a in range(5):
        for b in range(5):
            for c in range(5):
                x, y, z = (3 - v if v < 4 else v for v in (c, b, a)) if reverse else (a, b, c)
                out[a, b, c] = ord("." if x != 1 else "z" if y == 2 else "x" if z == 2 else "h")
    return out.reshape(-1)


_CONTEXT = _contexts(False), _contexts(True)


def parse_mm(seq: np.ndarray, mm: str | None, ml: np.ndarray | None, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """By MM strand and position in SEQ: the probability of 5mC, -3 if absent, and that of the best other modification, or -2."""
    original = _COMPLEMENT[seq][::-1] if reverse else seq
    n, taken = len(seq), 0
    own, other = np.full((2, n), -3, np.int32), np.full((2, n), -2, np.int32)
    for entry in (mm or "").strip(";").split(";"):
        m = re.match(r"([A-Za-z])([+-])([a-zA-Z]+|\d+)[.?]?((?:,\d+)*)$", entry)
        if not m:
            continue
        base, strand, codes, deltas = m.groups()
        kinds = [codes] if codes.isdigit() else list(codes)
        where = np.arange(n) if base == "N" else np.flatnonzero(original == ord(base.upper()))
        at = np.cumsum(np.fromstring(deltas[1:], np.int64, sep=",") + 1) - 1 if deltas else np.zeros(0, np.int64)
        inside = int(np.searchsorted(at, len(where)))
        pos = where[at[:inside]]
        pos = n - 1 - pos if reverse else pos
        for j, kind in enumerate(kinds):
            k = taken + j + len(kinds) * np.arange(inside)
            p = np.full(inside, -1, np.int32)
            if ml is not None:
                p[k < len(ml)] = ml[k[k < len(ml)]]
            to = (own if kind in ("m", "27551") else other)[int(strand == "-")]
            to[pos] = np.maximum(to[pos], p)
        taken += len(kinds) * len(at)
    return own, other


def _long_strands(seq: bytes, mm: str | None, ml: np.ndarray | None, reverse: bool, min_prob: int, highest_prob: bool) -> list[tuple[str, bytes]]:
    up = np.frombuffer(seq.upper(), np.uint8)
    n = len(up)
    code = np.full(n + 4, 4, np.int16)
    code[2 : n + 2] = _CODE[up]
    three = code[:-2] * 36 + code[1:-1] * 6 + code[2:]
    xm = [_CONTEXT[0][three[2:]], _CONTEXT[1][three[:n]]]
    modified = [False, False]
    own, other = parse_mm(up, mm, ml, reverse)
    for s in (0, 1):
        t = abs(int(reverse) - s)
        hit = (own[s] > -3) & (own[s] >= min_prob) & (xm[t] != ord("."))
        if highest_prob:
            hit &= own[s] > other[s]
        xm[t][hit] -= 32
        modified[t] = bool(hit.any())
    return [("+-"[t], xm[t].tobytes()) for t in (0, 1) if modified[t] or t == int(reverse)]


def long_read_strands(seq: str, mm: str | None, ml: list[int] | None, reverse: bool, min_prob: int = -1, highest_prob: bool = True) -> list[tuple[str, str]]:
    """(strand, xm in query space) of a long read: its own strand always, the other one if it is modified."""
    return [(s, x.decode()) for s, x in _long_strands(seq.encode(), mm, None if ml is None else np.asarray(ml, np.int64), reverse, min_prob, highest_prob)]


def long_reads(alignments: DataFrame, min_mapq: int = 0, min_baseq: int = 0, min_prob: int = -1, highest_prob: bool = True, trim: int | tuple[int, int] = 0, **skips) -> DataFrame:
    """Reads with MM/ML tags: one or two strand copies each, in reference space, found in Arrow batches."""
    a = alignments.where((F.col("flag").bitwiseAND(skip_mask(False, **skips)) == 0) & (F.col("mapq") >= min_mapq))
    qual = F.col("qual") if min_baseq > 0 else F.lit(None).cast("string")
    a = a.select(F.col("rec_no").cast("long").alias("templid"), "rname", F.col("pos").cast("int").alias("start"), F.col("flag").cast("int").alias("flag"), "cigar", "seq", qual.alias("qual"), "mm", F.col("ml").cast("array<int>").alias("ml"))

    def strands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, strand, seqs, xms = [], [], [], []
            ml = b.column(8)
            ends, values, none = ml.offsets.to_numpy(), ml.values.to_numpy(zero_copy_only=False), st.nulls(ml)
            for i, (f, c, s, q, m) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), st.rows_of(b.column(5)), st.rows_of(b.column(6)), b.column(7).to_pylist(), strict=True)):
                for t, x in _long_strands(s, m, None if none[i] else values[ends[i] : ends[i + 1]], bool(f & REVERSE), min_prob, highest_prob):
                    rows.append(i)
                    strand.append(t)
                    seqs.append(None if c is None else laid_out(masked(s, q, min_baseq, b"N"), pieces(c), b"N"))
                    xms.append(None if c is None else laid_out(masked(x, q, min_baseq, b"-"), pieces(c), b"-"))
            own = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(strand, pa.string()), own[2], st.joined(seqs), st.joined(xms)], ["templid", "rname", "strand", "start", "seq", "xm"])

    return trimmed(a.mapInArrow(strands, _PAIR), trim).select(*_OUT)


def preprocess(alignments: DataFrame, paired: bool | None = None, min_prob: int = -1, highest_prob: bool = True, **options) -> DataFrame:
    """Reads from alignments, by whichever of the three ways the first records call for. Reads pass through."""
    if {"templid", "xm", "start"} <= set(alignments.columns):
        return alignments
    seen = sniff(alignments)
    if paired is not None and paired != seen["paired"]:
        raise AlignmentError(f"records are {'paired' if seen['paired'] else 'single'}-end, the option says otherwise")
    if seen["tagged"] == "MM":
        return long_reads(alignments, min_prob=min_prob, highest_prob=highest_prob, **options)
    return (paired_reads if seen["paired"] else single_reads)(alignments, **options)
