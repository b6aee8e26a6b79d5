"""One-call reports: from alignments (a BAM path or a DataFrame) to a report, and to a file if one is named.

Every function takes alignments or reads as ``preprocess`` does, and passes ``options`` on to it. Reports
go to the file in the order that their rows have in a coordinate-sorted report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import alignments as al
from .operators import calling, patterns, regions, reports, variants
from .sources import bam, text

CYTOSINE_ORDER = ["rname", "pos", "strand"]
REGION_ORDER = ["bed_row"]
VARIANT_ORDER = ["seqnames", "range", "name", "ALT"]


def reads_of(spark: SparkSession, source: str | DataFrame, **options) -> DataFrame:
    """Reads of a BAM path (comma-separated paths) or of a DataFrame of alignments or reads."""
    if isinstance(source, str):
        bam.register(spark)
        source = spark.read.format("epibam").load(source)
    return al.preprocess(source, **options)


def _targets_of(spark: SparkSession, bed: str | DataFrame, zero_based: bool) -> DataFrame:
    return text.read_bed(spark, bed, zero_based) if isinstance(bed, str) else bed


def _given(report: DataFrame, path: str | None, gzip: bool, order: list[str]) -> DataFrame:
    if path is not None:
        text.write_report(report, path, gzip=gzip, order=order)
    return report


def cytosine_report(spark: SparkSession, source: str | DataFrame, report_file: str | None = None, gzip: bool = False, threshold: bool = True, preprocess: dict | None = None, **options) -> DataFrame:
    """Counts of methylated and unmethylated cytosines, of all reads or thresholded ones."""
    out = reports.cytosine_report(reads_of(spark, source, **(preprocess or {})), threshold=threshold, **options)
    return _given(out, report_file, gzip, CYTOSINE_ORDER)


def mhl_report(spark: SparkSession, source: str | DataFrame, report_file: str | None = None, gzip: bool = False, preprocess: dict | None = None, **options) -> DataFrame:
    """The linearised methylated-haplotype load of every cytosine."""
    out = reports.mhl_report(reads_of(spark, source, **(preprocess or {})), **options)
    return _given(out, report_file, gzip, CYTOSINE_ORDER)


def bed_report(spark: SparkSession, source: str | DataFrame, bed: str | DataFrame, kind: str = "amplicon", report_file: str | None = None, gzip: bool = False, zero_based: bool = False, preprocess: dict | None = None, **options) -> DataFrame:
    """Reads and their VEF by target region; unmatched reads stand last."""
    out = regions.region_report(reads_of(spark, source, **(preprocess or {})), _targets_of(spark, bed, zero_based), kind, **options)
    if report_file is not None:
        from pyspark.sql import functions as F

        text.write_report(out.orderBy(F.col("bed_row").asc_nulls_last()), report_file, gzip=gzip)
    return out


def amplicon_report(spark: SparkSession, source: str | DataFrame, bed: str | DataFrame, **options) -> DataFrame:
    return bed_report(spark, source, bed, "amplicon", **options)


def capture_report(spark: SparkSession, source: str | DataFrame, bed: str | DataFrame, **options) -> DataFrame:
    return bed_report(spark, source, bed, "capture", **options)


def bed_ecdf(spark: SparkSession, source: str | DataFrame, bed: str | DataFrame, kind: str = "amplicon", zero_based: bool = False, preprocess: dict | None = None, **options) -> DataFrame:
    """Distribution functions of read betas by target region."""
    return regions.region_ecdf(reads_of(spark, source, **(preprocess or {})), _targets_of(spark, bed, zero_based), kind, **options)


def vcf_report(spark: SparkSession, source: str | DataFrame, vcf: str | DataFrame, bed: str | DataFrame | None = None, style: str | None = None, report_file: str | None = None, gzip: bool = False, zero_based: bool = False, preprocess: dict | None = None, **options) -> DataFrame:
    """Allele counts and exact tests by variant, restricted to the regions of ``bed`` if one is given."""
    near = None if bed is None else _targets_of(spark, bed, zero_based)
    v = text.read_vcf(spark, vcf, near, style) if isinstance(vcf, str) else vcf
    out = variants.variant_report(reads_of(spark, source, **(preprocess or {})), v, **options)
    return _given(out, report_file, gzip, VARIANT_ORDER)


def extract_patterns(spark: SparkSession, source: str | DataFrame, seqnames: str, start: int, end: int, preprocess: dict | None = None, **options) -> DataFrame:
    """Methylation patterns of the reads over one region."""
    return patterns.patterns(reads_of(spark, source, **(preprocess or {})), seqnames, start, end, **options)


def call_methylation(spark: SparkSession, source: str | DataFrame, genome: str | DataFrame) -> DataFrame:
    """Alignments with XM and XG called from the genome."""
    if isinstance(source, str):
        bam.register(spark)
        source = spark.read.format("epibam").load(source)
    g = text.read_fasta(spark, genome) if isinstance(genome, str) else genome
    return calling.call_methylation(source, g)
