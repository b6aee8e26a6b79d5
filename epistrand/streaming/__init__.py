"""Incremental reports: counts per cytosine add up, so batches of reads can be folded into a running table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import _counts, bases, with_pass


def cytosine_counts(reads: DataFrame, **thresholds) -> DataFrame:
    """Streaming or batch reads -> additive counts by (rname, pos, strand); use output mode ``complete`` or ``update``."""
    r = with_pass(reads, **thresholds)
    b = bases(r.withColumn("xm", F.when(F.col("pass"), F.col("xm")).otherwise(F.lower("xm"))))
    return b.groupBy("rname", "pos", "strand").agg(*_counts(), *[F.count_if(F.col("c") == x.upper()).alias(f"m_{x}") for x in "hxz"])
