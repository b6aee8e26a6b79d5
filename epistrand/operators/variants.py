"""Single-nucleotide variants: base counts by read verdict and strand, allele rules, exact tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as st
from ..functions.exact import fisher_exact
from .reports import Piece, per_position_sums, with_pass

BROADCAST_VARIANTS = 100_000
_BASE = st.table({"ACGT": "0123"}, "4") - ord("0")
_GROUPS = [(m, s) for m in ("M", "U") for s in ("+", "-")]


def single_nucleotide(variants: DataFrame) -> DataFrame:
    """One row an alternative allele (comma-separated ones expanded), single bases only."""
    v = variants.withColumn("alt", F.explode(F.split("alt", ",")))
    return v.where((F.length("ref") == 1) & (F.length("alt") == 1))


def check_chromosomes(reads: DataFrame, variants: DataFrame) -> None:
    """Raise if no variant's chromosome is among the reads'."""
    known = reads.select(F.col("rname").alias("seqnames")).distinct()
    if variants.limit(1).count() and not variants.join(known, "seqnames", "left_semi").limit(1).count():
        raise ValueError("variants and reads share no chromosome; check the naming style")


def chromosome_style(name: Column, style: str) -> Column:
    """``UCSC``: chr1, chrM; ``NCBI``: 1, MT."""
    if style not in ("UCSC", "NCBI"):
        raise ValueError("style is UCSC or NCBI")
    bare = F.regexp_replace(name, "^chr", "")
    if style == "NCBI":
        return F.when(bare == "M", "MT").otherwise(bare)
    return F.concat(F.lit("chr"), F.when(bare == "MT", "M").otherwise(bare))


def base_counts(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants with 16 counts: [M|U][+|-][A|C|G|T], reads by verdict (``pass``) and strand. Other bases are dropped.

    Bases are counted by position in Arrow batches; positions without a variant go before the shuffle, in the batch if
    variants are few. Uncovered variants have zeros.
    """
    # Alleles of one site share a name and a position, so counts are made by position.
    v = variants.select(F.col("seqnames").alias("vchr"), F.col("pos").alias("vpos")).distinct()
    few, wanted = v.limit(BROADCAST_VARIANTS + 1).toArrow(), None
    if few.num_rows <= BROADCAST_VARIANTS:
        v, wanted = F.broadcast(v), {}
        for name, pos in zip(few["vchr"].to_pylist(), few["vpos"].to_pylist(), strict=True):
            if pos is not None:
                wanted.setdefault((name,), []).append(pos)
        wanted = {k: np.sort(np.array(x, np.int64)) for k, x in wanted.items()}
    names = tuple(f"{m}{s}{b}" for m, s in _GROUPS for b in "ACGT")

    def counts(b: pa.RecordBatch, piece: Piece, n: int) -> np.ndarray:
        x, o, rows, place = piece
        four = np.repeat(st.numbers(b.column("four"))[rows], np.diff(o))
        base = _BASE[x]
        kept = base < 4
        return np.bincount(place[kept] * 16 + four[kept] * 4 + base[kept], minlength=n * 16).reshape(n, 16)

    four = F.when(F.col("pass"), 0).otherwise(2) + F.when(F.col("strand") != "-", 0).otherwise(1)
    r = reads.where((F.col("start") >= 0) & F.col("pass").isNotNull() & F.col("strand").isNotNull() & F.col("rname").isNotNull())
    p = per_position_sums(r.select("rname", F.col("start").cast("int").alias("start"), four.alias("four"), "seq"), ("rname",), "seq", names, counts, wanted=wanted)
    g = p.join(v, (F.col("rname") == F.col("vchr")) & (F.col("pos") == F.col("vpos"))).groupBy("vchr", "vpos").agg(*[F.sum(f"`{c}`").alias(c) for c in names])
    out = variants.join(g, (variants["seqnames"] == g["vchr"]) & (variants["pos"] == g["vpos"]), "left")
    return out.select(*variants.columns, *[F.coalesce(F.col(f"`{m}{s}{b}`"), F.lit(0)).alias(f"{m}{s}{b}") for m, s in _GROUPS for b in "ACGT"])


def allele(group: str, strand: str, base: str, other: str) -> Column:
    """Reads of an allele. Conversion turns C into T on ``+`` and G into A on ``-``: the converted base counts as
    well, and nothing can be told if it is the other allele."""
    kept, turned = ("C", "T") if strand == "+" else ("G", "A")
    own = F.col(base)
    plain = F.when(own == "A", F.col(f"`{group}{strand}A`")).when(own == "C", F.col(f"`{group}{strand}C`")).when(own == "G", F.col(f"`{group}{strand}G`")).when(own == "T", F.col(f"`{group}{strand}T`"))
    pair = F.array_sort(F.array(F.col(base), F.col(other)))
    undecided = pair == F.array(*[F.lit(x) for x in sorted((kept, turned))])
    both = F.col(f"`{group}{strand}{kept}`") + F.col(f"`{group}{strand}{turned}`")
    return F.when(undecided, F.lit(None)).when(own == kept, both).otherwise(plain).cast("long")


def variant_report(reads: DataFrame, variants: DataFrame, test: bool = True, threshold: bool = True, **thresholds) -> DataFrame:
    """name, seqnames, range, REF, ALT, eight allele counts, SumRef, SumAlt and the exact tests ``FEp+``, ``FEp-``."""
    v = single_nucleotide(variants)
    check_chromosomes(reads, v)
    c = base_counts(with_pass(reads, threshold, **thresholds), v)
    names = [(f"{m}{s}{a}", m, s, a) for m, s in _GROUPS for a in ("Ref", "Alt")]
    c = c.select("name", "seqnames", F.col("pos").alias("range"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), *[allele(m, s, "ref" if a == "Ref" else "alt", "alt" if a == "Ref" else "ref").alias(n) for n, m, s, a in names])
    for a in ("Ref", "Alt"):
        c = c.withColumn(f"Sum{a}", sum((F.coalesce(F.col(f"`{m}{s}{a}`"), F.lit(0)) for m, s in _GROUPS), F.lit(0)).cast("long"))
    if test:
        for s in "+-":
            c = c.withColumn(f"FEp{s}", fisher_exact(*[F.col(f"`{m}{s}{a}`") for a in ("Ref", "Alt") for m in ("M", "U")]))
    return c
