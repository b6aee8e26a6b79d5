"""Cases of the third round's findings: work in proportion to the reads, and results as before."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epistrand.operators import alignments as al
from epistrand.operators import regions
from epistrand.plans import catalog
from epistrand.sources import bam


def within(seconds: float, run):
    began = time.time()
    out = run()
    assert time.time() - began < seconds
    return out


def test_long_reads_are_cut_once(spark):
    n = 120_000
    a = bam.simulate(spark, xm="Zz.h" * (n // 4), seq="ACGT" * (n // 4), qual="I" * n, cigar=f"2S5M3I2D{n - 10}M", xg="CT")
    r = within(20, lambda: al.trimmed(al.single_reads(a), (3, 2)).select("start", F.length("xm"), F.length("seq"), F.substring("xm", 1, 8), F.substring("seq", 1, 8)).collect())
    assert [tuple(x)[1:] for x in r] == [(n - 8, n - 8, "z.--.hZz", "CGNNGTAC"[:8])]


def test_sniffing_makes_no_whole_records(spark):
    seq = F.when(F.col("rec_no") > 5000, F.raise_error(F.lit("made"))).otherwise(F.lit("AC"))
    a = spark.range(20_000).select((F.lit(19_999) - F.col("id")).alias("rec_no"), F.lit("q").alias("qname"), F.lit(0).alias("flag"), F.lit("Zz").alias("xm"), seq.alias("seq"))
    seen = al.sniff(a)
    assert (seen["records"], seen["tags"], seen["tagged"]) == (1024, {"XM": 1024}, "XM")


def test_long_modified_reads_are_read_at_once():
    n = 1_000_000
    got = within(1, lambda: al.long_read_strands("ACGT" * (n // 4), "C+m" + ",0" * (n // 4) + ";", [255, 0] * (n // 8), False, min_prob=128))
    assert len(got) == 1 and got[0][0] == "+" and got[0][1] == ".Z...z.." * (n // 8)


def test_long_pairs_are_merged_at_once(spark):
    n = 200_000
    a = bam.simulate(spark, qname="p", flag=[99, 147], pos=[1, 3], pnext=[3, 1], tlen=[n + 2, -n - 2], xm=["Z" * n, "z" * n], seq=["A" * n, "C" * n], qual=["I" * n, "F" + "K" * (n - 1)], xg=["CT", "GA"], cigar=f"{n}M")
    r = within(20, lambda: al.paired_reads(a).select("start", F.length("xm"), F.substring("xm", 1, 5), F.substring("seq", n - 2, 5)).collect())
    assert [tuple(x) for x in r] == [(1, n + 2, "ZZZzz", "CCCCC")]


@pytest.mark.parametrize("name", ["read_threshold", "trim_reads", "cigar_project", "pair_merge", "long_reads"])
def test_no_query_makes_a_row_of_characters(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "transform(" not in plan


@pytest.mark.parametrize(("kind", "most"), [("amplicon", 10**6), ("capture", 10**6), ("amplicon", 0), ("capture", 0)])
def test_targets_over_each_other_are_not_paired_with_reads(spark, monkeypatch, kind, most):
    n = 60_000  # reads that match each of the targets: pairs would be 10^9
    reads = spark.range(n // 3).select(F.col("id").alias("templid"), F.lit("c").alias("rname"), F.lit("+").alias("strand"), F.lit(5000).alias("start"), F.repeat(F.lit("z"), 200).alias("xm"))
    targets = spark.range(n).select((F.lit(n + 6) - F.col("id")).cast("int").alias("bed_row"), F.lit("c").alias("seqnames"), (F.lit(5000) + F.col("id") % 3).cast("int").alias("start"), F.lit(5300).alias("end"))
    monkeypatch.setattr(regions, "BROADCAST_TARGETS", most)
    got = within(30, lambda: regions.match_targets(reads, targets, kind, **({"tolerance": 2} if kind == "amplicon" else {"min_overlap": 150})).groupBy("bed_row").count().collect())
    assert [tuple(x) for x in got] == [(7, n // 3)]


@pytest.mark.parametrize("name", ["call_methylation", "call_cigar"])
def test_calls_make_no_row_of_characters(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_calls_of_odd_records():
    from epistrand.operators import calling

    ref = calling.reference_in_query_space("1S2M1I1D1X2M", b"ACGTCGAC", 3)
    assert ref == b"ACNGTNNACNN"
    assert calling.call_string(b"", b"NNNN", True) == b"." and calling.call_string(b"cCTG", b"NNCGCANN", True) == b"Z.h."
    assert calling.call_string(b"GGAC", b"NNCGGANN", False) == b".Zx."


def test_fasta_is_written_by_all_tasks(spark, monkeypatch):
    seen = []
    read = catalog.text.read_fasta
    monkeypatch.setattr(catalog.text, "read_fasta", lambda s, path: seen.append(path) or read(s, path))
    got = catalog.queries()["fasta_round_trip"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and len(list(Path(seen[0].removeprefix("file:")).glob("part-*"))) > 1


@pytest.mark.parametrize("name", ["cytosine_report_vef", "mhl_report", "base_freqs"])
def test_bases_are_counted_before_they_are_rows(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_reports_of_reads_far_apart(spark, monkeypatch):
    from epistrand.operators import reports

    monkeypatch.setattr(reports.st, "CHUNK", 4)
    r = spark.createDataFrame([(i, "c", "+", s, "Z-ZzzZx") for i, s in enumerate([2_000_000_000, 1, 5, 1])], "templid long, rname string, strand string, start int, xm string")
    got = {x.pos: (x.coverage, x.length, x.lmhl) for x in reports.mhl_report(r, max_out_beta=1.0).collect()}
    assert sorted(got) == [1, 3, 4, 5, 6, 8, 9, 10, 2_000_000_000, 2_000_000_002, 2_000_000_003, 2_000_000_004, 2_000_000_005]
    assert got[1][:2] == (2, 5.0) and abs(got[1][2] - 4 / 35) < 1e-12 and got[4][2] == 0.0


def test_clipped_patterns_take_only_the_region_apart(spark):
    plan = catalog.queries()["patterns_long"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split(substring(" in plan
