"""Methylation patterns of reads over one region, and the choice of the commonest ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.contexts import context
from ..functions.hashing import fnv1a_hex, site_bytes

# How far a reverse-strand site is moved, by context.
STRAND_OFFSET = {"CG": 1, "CHG": 2, "CHH": 0, "CxG": 0, "CX": 0}


def pattern_bases(reads: DataFrame, seqnames: str, start: int, end: int, name: str = "CG", min_overlap: int = 1, min_context_freq: float = 0.01, clip: bool = False, strand_offset: int | None = None, highlight: tuple[int, ...] = (), compat_clip: bool = False) -> DataFrame:
    """(templid, strand, start, end, pos, code, beta_of) of the retained positions of every read that overlaps.

    A position is retained if at least ``min_context_freq`` of the overlapping reads have a site there;
    highlighted positions show the base instead, unshifted. ``compat_clip`` clips reads that start
    before the region as the first implementation of this report did: as many bases again are lost at the end.
    """
    c = context(name)
    shift = STRAND_OFFSET[name] if strand_offset is None else strand_offset
    stop = F.col("start") + F.length("xm") - 1
    own = reads.where(F.col("rname") == seqnames).withColumn("_end", stop)
    own = own.where(F.least(F.col("_end"), F.lit(end)) - F.greatest(F.col("start"), F.lit(start)) + 1 >= min_overlap)
    marks = sorted({p for p in highlight if start <= p <= end})
    # Clipped reads are cut to the region before they are taken apart.
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0)) if clip else F.lit(0)
    cut = lambda c: F.substring(c, skip + 1, F.greatest(F.lit(end) - F.col("start") - skip + 1, F.lit(0))) if clip else F.col(c)
    sites = own.select("templid", "strand", "start", "_end", F.posexplode(F.split(cut("xm"), "")).alias("i", "code"), cut("seq").alias("seq")).withColumn("at", F.col("start") + skip + F.col("i"))
    if clip:
        inside = F.col("at").between(start, end) & (F.col("at") <= F.col("_end"))
        if compat_clip:
            lost = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
            inside = inside & (F.col("at") <= F.least(F.col("_end"), F.lit(end)) - lost)
        sites = sites.where(inside)
    in_context = F.col("code").rlike(f"[{c.meth}{c.unmeth}]")
    shifted = sites.where(in_context).withColumn("pos", (F.col("at") - F.when(F.col("strand") == "-", shift).otherwise(0)).cast("int"))
    shifted = shifted.where(~F.col("pos").isin(marks)) if marks else shifted
    total = own.agg(F.count("*").alias("total"))  # one row; reads that are left without a site count, too
    common = shifted.groupBy("pos").agg(F.count("*").alias("n")).join(F.broadcast(total), F.col("n") >= min_context_freq * F.col("total")).select("pos")
    rows = shifted.join(common, "pos", "left_semi").select("templid", "strand", "start", "_end", "pos", "code", F.lit(True).alias("site"))
    if marks:
        base = F.expr("substring(seq, i + 1, 1)")
        shown = sites.where(F.col("at").isin(marks)).select("templid", "strand", "start", "_end", F.col("at").cast("int").alias("pos"), F.when(base.isin("A", "C", "G", "T"), base).otherwise("N").alias("code"), F.lit(False).alias("site"))
        rows = rows.unionByName(shown.join(rows.select("templid").distinct(), "templid", "left_semi"))
    return rows.select("templid", "strand", "start", F.col("_end").alias("end"), "pos", "code", "site")


def patterns(reads: DataFrame, seqnames: str, start: int, end: int, name: str = "CG", **options) -> DataFrame:
    """templid, strand, start, end, nbase, beta, codes (pos:code in order) and pattern, its id, of reads with any retained site."""
    c = context(name)
    b = pattern_bases(reads, seqnames, start, end, name, **options)
    upper = F.count_if(F.col("site") & F.col("code").rlike(f"[{c.meth}]"))
    g = b.groupBy("templid", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_if("site").alias("nbase"), upper.alias("_m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["code"])), ",").alias("codes"))
    g = g.where("nbase > 0").withColumn("beta", F.col("_m") / F.col("nbase").cast("double"))
    return g.select("templid", "strand", "start", "end", "nbase", "beta", "codes", F.upper(F.lpad(F.hex(F.xxhash64("codes")), 16, "0")).alias("pattern"))


def fnv_ids(base_rows: DataFrame) -> DataFrame:
    """(templid, pattern): FNV-1a ids of patterns without highlighted positions, from ``pattern_bases``."""
    sites = F.array_sort(F.collect_list(F.struct("pos", "code")))
    data = F.unhex(F.array_join(F.transform("s", lambda x: site_bytes(x["pos"], x["code"])), ""))
    g = base_rows.where("site").groupBy("templid").agg(sites.alias("s"))
    return g.select("templid", fnv1a_hex(data).alias("pattern"))


def beta_density(pattern_rows: DataFrame, n: int = 2048) -> DataFrame:
    """(x, y): the density of betas over ``n`` points between the least and the largest one, patterns weighed by their counts.

    A Gaussian kernel; the bandwidth is 0.9 times the smaller of standard deviation and quartile range over 1.34,
    over the fifth root of the number of patterns. Betas of a region take few values, so they are summed first.
    """
    u = unique_patterns(pattern_rows)
    s = u.agg(F.count("*").alias("k"), F.stddev_samp("beta").alias("sd"), (F.percentile("beta", F.lit(0.75)) - F.percentile("beta", F.lit(0.25))).alias("iqr"), F.min("beta").alias("lo"), F.max("beta").alias("hi"), F.sum("count").alias("total"))
    low = F.when((F.col("iqr") > 0) & (F.col("iqr") / 1.34 < F.col("sd")), F.col("iqr") / 1.34).otherwise(F.col("sd"))
    low = F.when(low > 0, low).when(F.abs("lo") > 0, F.abs("lo")).otherwise(1.0)
    s = s.where("k > 0").select("lo", "hi", "total", (0.9 * low * F.pow("k", F.lit(-0.2))).alias("bw"))
    grid = F.broadcast(s).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (n - 1))
    at = u.groupBy("beta").agg(F.sum("count").alias("c")).agg(F.collect_list(F.struct("beta", "c")).alias("at"))  # distinct betas only
    z = lambda b: F.exp(-0.5 * F.pow((F.col("x") - b) / F.col("bw"), F.lit(2)))
    y = F.aggregate("at", F.lit(0.0), lambda acc, b: acc + b["c"] / F.col("total") * z(b["beta"])) / (F.col("bw") * (2 * math.pi) ** 0.5)
    return grid.join(F.broadcast(at)).select("x", y.alias("y"))


def wide(pattern_rows: DataFrame, base_rows: DataFrame, positions: list[int] | None = None) -> DataFrame:
    """The wide table: one column a position of the region, those given or all (which takes a pass to list them)."""
    cols = base_rows.groupBy("templid").pivot("pos", positions).agg(F.first("code"))
    return pattern_rows.join(cols, "templid")


def unique_patterns(pattern_rows: DataFrame) -> DataFrame:
    """(pattern, codes, nbase, beta, count) of distinct patterns."""
    return pattern_rows.groupBy("pattern", "codes", "nbase", "beta").agg(F.count("*").alias("count"))


def select_patterns(pattern_rows: DataFrame, nbins: int = 10, per_bin: int | list[int] = 2, lo: float = 0.0, hi: float = 1.0, order_by: str = "beta") -> DataFrame:
    """The commonest patterns of each beta bin, with bin and display rank (best = largest).

    Bins are closed on the left, the last one on both sides; ties go to the smaller pattern text.
    """
    if order_by not in ("beta", "count"):
        raise ValueError("order_by is beta or count")
    u = unique_patterns(pattern_rows).where(F.col("beta").between(lo, hi))
    u = u.withColumn("bin", F.least(F.width_bucket(F.col("beta"), F.lit(lo), F.lit(hi), F.lit(nbins)), F.lit(nbins)).cast("int"))
    per = [per_bin] * nbins if isinstance(per_bin, int) else per_bin
    most = F.element_at(F.array(*[F.lit(int(min(x, 2**31 - 1))) for x in per]), F.col("bin"))
    in_bin = Window.partitionBy("bin").orderBy(F.col("count").desc(), "codes")
    u = u.withColumn("_r", F.row_number().over(in_bin)).where(F.col("_r") <= most).drop("_r")
    first, second = ("beta", "count") if order_by == "beta" else ("count", "beta")
    return u.withColumn("rank", F.row_number().over(Window.orderBy(F.col(first).asc(), F.col(second).asc(), F.col("codes").desc())))


def bin_counts(selected: DataFrame, nbins: int = 10) -> DataFrame:
    """(bin, n): selected patterns of every bin, empty ones too."""
    bins = selected.sparkSession.range(1, nbins + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(selected.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
