"""BED, VCF and FASTA sources, and the TSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Variants meet the regions they are restricted to by chromosome and bin.
BIN = 65_536


def read_bed(spark: SparkSession, path: str, zero_based: bool = False) -> DataFrame:
    """bed_row, seqnames, start, end, width, strand and the further columns of a tab-separated file.

    A first line whose second field is no number is a header. Rows are numbered in file order, at the read.
    """
    lines = [x[0] for x in spark.read.text(path, wholetext=False).where(F.trim("value") != "").limit(1).collect()]
    if not lines:
        return spark.createDataFrame([], "bed_row int, seqnames string, start int, end int, width int, strand string")
    fields = lines[0].split("\t")
    header = not fields[1].strip().lstrip("-").isdigit()
    extra = fields[3:] if header else [f"V{i + 4}" for i in range(len(fields) - 3)]
    # A target file is small, and its row order is part of its meaning: it is read as one text.
    whole = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r", ""), "\n").alias("l"))
    rows = whole.select(F.posexplode(F.filter("l", lambda x: F.trim(x) != "")).alias("i", "line")).where(F.col("i") >= int(header))
    f = F.split("line", "\t")
    shift = 1 if zero_based else 0
    out = rows.select((F.col("i") + 1 - int(header)).cast("int").alias("bed_row"), f[0].alias("seqnames"), (f[1].cast("int") + shift).alias("start"), f[2].cast("int").alias("end"), F.lit("*").alias("strand"), *[F.get(f, F.lit(k + 3)).alias(n) for k, n in enumerate(extra)])
    return out.withColumn("width", F.col("end") - F.col("start") + 1).select("bed_row", "seqnames", "start", "end", "width", "strand", *extra)


def read_vcf(spark: SparkSession, path: str, regions: DataFrame | None = None, style: str | None = None) -> DataFrame:
    """name, seqnames, pos, ref, alt; restricted to ``regions`` (reduced first) and renamed to ``style`` if given."""
    from ..operators.regions import reduce_intervals
    from ..operators.variants import chromosome_style

    f = F.split("value", "\t")
    v = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    v = v.select(f[0].alias("seqnames"), f[1].cast("int").alias("pos"), f[2].alias("name"), f[3].alias("ref"), f[4].alias("alt"))
    if style:
        v = v.withColumn("seqnames", chromosome_style(F.col("seqnames"), style))
    unnamed = F.concat(F.col("seqnames"), F.lit(":"), F.col("pos").cast("string"), F.lit("_"), F.col("ref"), F.lit("/"), F.col("alt"))
    v = v.withColumn("name", F.when(F.col("name") == ".", unnamed).otherwise(F.col("name")))
    if regions is not None:
        bins = F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN)))
        r = reduce_intervals(regions).select(F.col("seqnames").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"), bins.alias("_bin"))
        v = v.join(r, (F.col("seqnames") == F.col("_s")) & (F.floor(F.col("pos") / BIN) == F.col("_bin")) & F.col("pos").between(F.col("_a"), F.col("_b")), "left_semi")
    return v.select("name", "seqnames", "pos", "ref", "alt")


def clean_bases(seq):
    """Upper case; all but A, C, G and T become N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """rid, rname, rlen, seq of a plain or gzipped FASTA file. A record begins with a line that begins with ``>``;
    ``rid`` rises with the order of the records in a file."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\s]+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = r.select(F.monotonically_increasing_id().alias("rid"), head.alias("rname"), clean_bases(body).alias("seq"))
    return rows.select("rid", "rname", F.length("seq").cast("long").alias("rlen"), "seq")


def check_fasta(genome: DataFrame, index: list[tuple[str, int]]) -> None:
    """Raise unless names and lengths are those of the index (.fai)."""
    if [(r[0], r[1]) for r in genome.orderBy("rid").select("rname", "rlen").collect()] != list(index):
        raise ValueError("sequences do not match the index")


def write_report(report: DataFrame, path: str, gzip: bool = False, order: list[str] | None = None, single: bool = True) -> None:
    """Tab-separated, with a header, unquoted. ``single``: one file; else one a partition, for large reports."""
    out = report.orderBy(*order) if order else report
    out = out.coalesce(1) if single else out
    w = out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").option("nullValue", "NA")
    w.option("compression", "gzip" if gzip else "none").csv(path)
