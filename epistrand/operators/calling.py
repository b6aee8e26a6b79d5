"""Methylation calling: XM strings from bisulfite reads and the reference genome."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import strings as st
from .alignments import UNMAPPED

#: Bases of a genome tile, and of the next tile that it holds as well, so that a short read needs one tile.
TILE, OVERLAP = 16_384, 1_024


def strand_tag(alignments: DataFrame) -> Column:
    """CT or GA from XG, else YD (r: GA), else ZS (leading ``-``: GA); null without any."""
    has = {c.lower() for c in alignments.columns}
    by = []
    if "xg" in has:
        by.append(F.when(F.col("xg").isNotNull(), F.when(F.substring("xg", 1, 1) == "C", "CT").otherwise("GA")))
    if "yd" in has:
        by.append(F.when(F.col("yd").isNotNull(), F.when(F.substring("yd", 1, 1) == "r", "GA").otherwise("CT")))
    if "zs" in has:
        by.append(F.when(F.col("zs").isNotNull(), F.when(F.substring("zs", 1, 1) == "-", "GA").otherwise("CT")))
    return F.coalesce(*by) if by else F.lit(None).cast("string")


@lru_cache(1 << 12)
def _ops(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]


def reference_in_query_space(cigar: str, genome: bytes, pos: int) -> bytes:
    """Reference under each read base: matches copy it; mismatches (X), insertions and soft clips are N; two flanking
    bases on either side, N beyond the contig."""
    at = pos - 1
    out = [genome[max(at - 2, 0) : max(at, 0)].rjust(2, b"N")]
    for n, op in _ops(cigar):
        if op in "M=":
            out.append(genome[at : at + n].ljust(n, b"N"))
        elif op in "XIS":
            out.append(b"N" * n)
        at += n if op in "M=XDN" else 0
    return b"".join([*out, genome[at : at + 2].ljust(2, b"N")])


def _calls(base: str, turned: str, mate: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of bytes: what a reference base counts (1 if it is the one called, or missing), a mate, and a read base (1, 2 if converted)."""
    own, near, read = np.zeros(256, np.uint8), np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    own[[0, ord(base)]], near[ord(mate)] = 1, 1
    read[[ord(base), ord(base.lower())]], read[[ord(turned), ord(turned.lower())]] = 1, 2
    return own, near, read


_CALLS = _calls("G", "A", "C"), _calls("C", "T", "G")
#: By (read base, whether the next but one is a mate, whether the next is): the character called.
_CALLED = np.frombuffer(b"....HXZZhxzz", np.uint8)


def call_string(seq: bytes, ref: bytes, plus: bool) -> bytes:
    """One character a read base: context letter, upper case if the base is unconverted, else ``.``. ``ref`` has two flanks."""
    n = max(1, len(seq))
    r, b = np.frombuffer(ref.ljust(n + 4, b"\0"), np.uint8), np.frombuffer(seq or b".", np.uint8)
    own, near, read = _CALLS[plus]
    mate = near[r]
    one, two = (mate[3 : n + 3], mate[4 : n + 4]) if plus else (mate[1 : n + 1], mate[:n])
    return _CALLED[own[r[2 : n + 2]] * read[b] * 4 + one * 2 + two].tobytes()


@F.arrow_udf(StringType())
def _call(seq: pa.Array, cigar: pa.Array, genome: pa.Array, pos: pa.Array, tag: pa.Array) -> pa.Array:
    rows = zip(st.rows_of(seq), cigar.to_pylist(), st.rows_of(genome), pos.to_pylist(), tag.to_pylist(), strict=True)
    return st.joined([None if None in x else call_string(x[0], reference_in_query_space(*x[1:4]), x[4] == "CT") for x in rows])


def check_genome(header: DataFrame, genome: DataFrame) -> None:
    """Raise unless every target of the header stands in the genome with the same name, length and order."""
    h = [(r[0], r[1]) for r in header.orderBy("rid").select("rname", "rlen").collect()]
    g = [(r[0], r[1]) for r in genome.orderBy("rid").select("rname", "rlen").collect()]
    if h != g[: len(h)]:
        raise ValueError("the genome does not match the header of the alignments")


def tiles(genome: DataFrame) -> DataFrame:
    """(rname, tile, bases): contigs cut into tiles of ``TILE`` bases in one pass, each with the first ``OVERLAP`` bases of the next."""
    cut = genome.select("rname", F.regexp_extract_all("seq", F.lit(f".{{1,{TILE}}}"), F.lit(0)).alias("t"))
    cut = cut.select("rname", F.posexplode(F.arrays_zip(F.col("t").alias("own"), F.slice("t", F.lit(2), F.size("t")).alias("next"))).alias("tile", "x"))
    return cut.select("rname", F.col("tile").cast("long").alias("tile"), F.concat("x.own", F.coalesce(F.substring("x.next", 1, OVERLAP), F.lit(""))).alias("bases"))


def call_methylation(alignments: DataFrame, genome: DataFrame) -> DataFrame:
    """All records, with xg and xm filled in where they are called: mapped records with a strand tag and no xm yet.

    Reads are joined to the tile of the genome that they start in, never to a whole contig.
    """
    a = alignments if "xm" in alignments.columns else alignments.withColumn("xm", F.lit(None).cast("string"))
    a = a if "xg" in a.columns else a.withColumn("xg", F.lit(None).cast("string"))
    tag = strand_tag(a)
    spans = F.transform(F.filter(F.arrays_zip(*[F.regexp_extract_all("cigar", F.lit(r"(\d+)([MDN=X])"), F.lit(i)).alias(n) for i, n in ((1, "n"), (2, "op"))]), lambda x: x["op"].isNotNull()), lambda x: x["n"].cast("long"))
    need = F.col("pos") + F.aggregate(spans, F.lit(0).cast("long"), lambda x, y: x + y) + 1  # the last base and two more
    a = a.withColumns({"_tile": F.floor((F.greatest(F.col("pos") - 2, F.lit(1)) - 1) / TILE), "_need": need})
    short = F.coalesce(F.col("_need") <= (F.col("_tile") + 1) * TILE + OVERLAP, F.lit(True))
    t = tiles(genome)
    one = t.select(F.col("rname").alias("_rname"), F.col("tile").alias("_t"), F.col("bases").alias("_genome"))
    few = a.where(short).join(one, (F.col("rname") == F.col("_rname")) & (F.col("_tile") == F.col("_t")), "left").drop("_rname", "_t")
    # Longer reads gather their tiles by record.
    many = a.where(~short).select(F.col("rec_no").alias("_rec"), F.col("rname").alias("_rname"), F.explode(F.sequence(F.col("_tile"), F.floor((F.col("_need") - 1) / TILE))).alias("_t"))
    parts = many.join(t.select("rname", "tile", F.substring("bases", 1, TILE).alias("part")), (F.col("_rname") == F.col("rname")) & (F.col("_t") == F.col("tile")))
    parts = parts.groupBy("_rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "").alias("_genome"))
    j = few.unionByName(a.where(~short).join(parts, F.col("rec_no") == F.col("_rec"), "left").drop("_rec"))
    called = F.col("xm").isNull() & tag.isNotNull() & (F.col("flag").bitwiseAND(UNMAPPED) == 0) & F.col("_genome").isNotNull()
    at = F.col("pos") - F.col("_tile") * TILE
    xm = _call(F.col("seq"), F.col("cigar"), F.col("_genome"), at, tag)
    return j.withColumns({"xm": F.when(called, xm).otherwise(F.col("xm")), "xg": F.when(called, tag).otherwise(F.col("xg")), "called": called}).drop("_genome", "_tile", "_need")


def call_summary(called: DataFrame) -> DataFrame:
    return called.agg(F.count("*").alias("nrecs"), F.count_if("called").alias("ncalled"))
