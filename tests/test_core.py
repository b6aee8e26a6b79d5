"""Documented cases: exact small tables, error contracts and properties."""

import random

import pytest
from pyspark.sql import functions as F

from epistrand import api, streaming
from epistrand.functions import hashing
from epistrand.functions.contexts import context
from epistrand.functions.exact import fisher_two_sided
from epistrand.operators import alignments as al
from epistrand.operators import calling, patterns, regions, reports, variants
from epistrand.sources import bam, text

READS = ["...Z..x.h..x..h.", "...Z..z.h..x..h.", "...Z..z.h..X..h.", "...Z..z.h..z-.h."]
A, B = "AGCTCTCCAGAGTCGNACGCCATYCGCGCGCCACCA", "AGGATCTCTAGCGGATCGGCGGGGGATATGCCATAT"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(i, "chr1", "+", 1, x, "ACGT" * 4) for i, x in enumerate(READS)], "templid long, rname string, strand string, start int, xm string, seq string")


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_threshold_and_cytosine_report(four):
    assert [r[0] for r in reports.with_pass(four).orderBy("templid").select("pass").collect()] == [False, True, False, False]
    cols = ("pos", "context", "meth", "unmeth")
    assert table(reports.cytosine_report(four, report_context="CX"), *cols) == [(4, "CG", 1, 3), (7, "CG", 0, 3), (9, "CHH", 0, 4), (12, "CHG", 0, 3), (15, "CHH", 0, 4)]
    assert table(reports.cytosine_report(four, threshold=False, report_context="CX"), *cols) == [(4, "CG", 4, 0), (7, "CG", 0, 3), (9, "CHH", 0, 4), (12, "CHG", 1, 2), (15, "CHH", 0, 4)]


def test_region_report_and_ecdf(spark, four):
    t = spark.createDataFrame([(1, "chr1", 1, 100), (2, "chr9", 1, 5)], "bed_row int, seqnames string, start int, end int")
    got = table(regions.capture_report(four, t), "bed_row", "`nreads+`", "`nreads-`", "VEF")
    assert got == [(1, 4, 0, 0.25), (2, None, None, None)]
    assert all(r[0] is None for r in regions.capture_report(four, t, threshold=False).select("VEF").collect())
    assert regions.match_targets(four, t, "amplicon").where("bed_row = 1").count() == 4
    e = regions.region_ecdf(four, t, "capture", rows=[1])
    assert {(r.kind, r.value) for r in regions.ecdf_at(e, 0.5).collect()} == {("context", 0.75), ("out.of.context", 1.0)}


def test_region_matching_by_bins_equals_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    r = spark.createDataFrame([(i, "c", "+", rng.randrange(1, 9000), "z" * rng.randrange(1, 6000)) for i in range(60)], "templid long, rname string, strand string, start int, xm string")
    t = spark.createDataFrame([(i, "c", s := rng.randrange(1, 12000), s + rng.randrange(0, 3000)) for i in range(1, 80)], "bed_row int, seqnames string, start int, end int")
    for kind, kw in (("capture", {"min_overlap": 7}), ("amplicon", {"tolerance": 40})):
        few = table(regions.match_targets(r, t, kind, **kw), "templid", "bed_row")
        monkeypatch.setattr(regions, "BROADCAST_TARGETS", 1)
        assert table(regions.match_targets(r, t, kind, **kw), "templid", "bed_row") == few
        monkeypatch.undo()


def test_haplotype_load(spark):
    r = spark.createDataFrame([(0, "c", "+", 1, "zZZZ")], "templid long, rname string, strand string, start int, xm string")
    assert [x[1] for x in table(reports.mhl_report(r), "pos", "lmhl")] == [0, 0.5, 0.5, 0.5]
    two = spark.createDataFrame([(i, "c", "+", 1, "Zz" * 5000) for i in range(2)], "templid long, rname string, strand string, start int, xm string")
    row = reports.mhl_report(two, max_window=1).agg(F.sum("coverage"), F.sum("length"), F.sum("lmhl")).first()
    assert tuple(row) == (20000, 1e8, 5000.0)


def test_simulated_counts(spark):
    a = bam.simulate(spark, pos=[1, 2, 3, 4, 5, 6], xm=["ZZZzzZZZ", "ZZzzzzZZ"], xg=["CT", "AG"])
    rows = reports.cytosine_report(al.single_reads(a), threshold=False)
    assert tuple(rows.agg(F.count("*"), F.sum("meth"), F.sum("unmeth")).first()) == (24, 30, 18)
    xm = ["Z" * 10] + ["".join("Z" if j == i % 10 else "z" for j in range(10)) for i in range(999)]
    vef = reports.cytosine_report(al.single_reads(bam.simulate(spark, xm=xm, xg="CT")))
    assert tuple(vef.agg(F.sum("meth"), F.sum("unmeth")).first()) == (10, 9990)
    with pytest.raises(ValueError):
        bam.simulate(spark, xm="Z", xb=[["a", "b"]])
    assert [bam.array_code(v) for v in ([1], [200], [-200], [60000], [-60000], [3_000_000_000], [0.5])] == list("cCsSiIf")


LONG = [
    (A, 0, "C+m,2,2,1,4,1;C+76792,6,7;N+n,15;", [102, 128, 153, 179, 161, 187, 212, 169], {}, {7, 18, 21, 32}),
    (A, 0, "C+m,2,2,1,4,1;C+76792,6,7;N+n,15;", [102, 128, 153, 179, 161, 187, 212, 169], {"min_prob": 160, "highest_prob": False}, {32, 35}),
    (A, 0, "C+m,2,2,1,4,1;C+27551,6,7;N+n,15;", [102, 128, 153, 179, 161, 187, 212, 169], {}, {7, 18, 20, 21, 32, 35}),
    (A, 0, "C+m,2,2,1,4,1;C+27551,6,7;N+n,15;", [102, 128, 153, 179, 161, 187, 212, 169], {"min_prob": 160}, {20, 32, 35}),
    (B, 0, "C+m,1,3,0;G-m,0,2,0,4;G+o,4;", [128, 153, 179, 115, 141, 166, 192, 102], {}, {-2, 8, -13, -14, -23, 31, 32}),
    (B, 0, "C+m,2,0,0;G-m,3,1,1;", [128, 153, 179, 128, 153, 179], {}, {12, -13, 17, -18, 20, -21}),
    (B, 16, "C+m,5,1,1;G-m,2,0,0;", [128, 153, 179, 128, 153, 179], {}, {12, -13, 17, -18, 20, -21}),
]


@pytest.mark.parametrize(("seq", "flag", "mm", "ml", "options", "meth"), LONG)
def test_long_reads(seq, flag, mm, ml, options, meth):
    got = al.long_read_strands(seq, mm, ml, bool(flag & 16), **options)
    assert {(i + 1) * (1 if s == "+" else -1) for s, xm in got for i, c in enumerate(xm) if c in "ZXH"} == meth


def test_long_reads_in_spark(spark):
    a = bam.simulate(spark, seq=A, mm=LONG[0][2], ml=LONG[0][3])
    r = al.preprocess(a)
    sites = table(reports.cytosine_report(r, threshold=False, report_context="CX"), "pos")
    assert [s[0] for s in sites] == [3, 5, 7, 8, 14, 18, 20, 21, 25, 27, 29, 31, 32, 34, 35]


def test_cigar_and_trimming(spark):
    a = bam.simulate(spark, xm="abCDefGHIj", cigar="2S3M1I2M2D2M1H", seq="ACGTACGTAC", xg="CT")
    r = al.single_reads(a).first()
    assert (r.xm, r.seq) == ("CDeGH--Ij", "GTAGTNNAC")
    assert al.single_reads(a, trim=(2, 3)).first().xm == "eGH-"
    assert al.single_reads(a, trim=9).count() == 0
    with pytest.raises(Exception, match="CIGAR"):
        al.single_reads(bam.simulate(spark, xm="ZZ", cigar="2Q", xg="CT")).collect()


def test_pair_merge(spark):
    a = bam.simulate(spark, qname="p", flag=[99, 147], pos=[1, 3], pnext=[3, 1], tlen=[6, -6], xm=["ZZZZ", "zzzz"], seq=["AAAA", "CCCC"], qual=["IIII", "FKIF"], xg=["CT", "GA"], cigar="4M")
    r = al.paired_reads(a).first()
    assert (r.xm, r.seq, r.strand, r.start) == ("ZZZzzz", "AAACCC", "+", 1)
    low = bam.simulate(spark, qname="p", flag=[99, 147], pos=[1, 2], pnext=[2, 1], tlen=[3, -3], xm=["ZZ", "zz"], seq="AC", qual=["!I", "II"], xg="CT", cigar="2M")
    assert al.paired_reads(low).first().xm == "-Zz"


def test_sniff_errors(spark):
    empty = bam.simulate(spark, xm="Z", xg="CT").limit(0)
    for df, says in (
        (empty, "no records"), (bam.simulate(spark, xg="CT"), "without XM"), (bam.simulate(spark, yd="f"), "strand tags"),
        (bam.simulate(spark, zs="+"), "strand tags"), (bam.simulate(spark), "neither"), (bam.simulate(spark, xm=["Z"] * 4, xg="CT", flag=99), "sorted"),
    ):
        with pytest.raises(al.AlignmentError, match=says):
            al.sniff(df)
    with pytest.raises(al.AlignmentError, match="single-end"):
        al.preprocess(bam.simulate(spark, xm="Z", xg="CT"), paired=True)
    assert al.skip_mask() == 4 + 256 + 512 + 2048 and al.skip_mask(True, skip_duplicates=True) == 4 + 8 + 256 + 512 + 1024 + 2048


def test_calling(spark):
    g = spark.createDataFrame([(0, "chrS", 6, "ACAACG"), (1, "far", 3, "CNN")], "rid long, rname string, rlen long, seq string")
    a = bam.simulate(spark, seq="ACCG", cigar="2M2D2M", xg="CT", tlen=0)
    c = calling.call_methylation(a, g)
    assert c.first().xm == ".HZ." or c.first().xm == ".XZ."
    again = calling.call_methylation(c.drop("called"), g)
    assert again.first().xm == c.first().xm and tuple(calling.call_summary(again).first()) == (1, 0)
    ga = calling.call_methylation(bam.simulate(spark, seq="ACAACA", yd="r", tlen=0), g).first()
    assert (ga.xg, ga.xm) == ("GA", ".....z")
    with pytest.raises(ValueError):
        calling.check_genome(g.withColumn("rlen", F.col("rlen") + 1), g)


def test_variants(spark, four):
    v = spark.createDataFrame([("a", "chr1", 2, "C", "T"), ("b", "chr1", 3, "G", "A,T"), ("c", "chr1", 1, "AC", "A")], "name string, seqnames string, pos int, ref string, alt string")
    r = {(x["name"], x["ALT"]): x for x in variants.variant_report(four, v).collect()}
    assert set(r) == {("a", "T"), ("b", "A"), ("b", "T")}
    assert r["a", "T"]["M+Ref"] is None and r["b", "A"]["M+Ref"] == 1 and r["b", "A"]["U+Ref"] == 3
    assert r["b", "T"]["SumRef"] == 4 and r["b", "T"]["FEp+"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        variants.check_chromosomes(four, v.withColumn("seqnames", F.lit("chr7")))
    import numpy as np

    fact = np.concatenate([[0], np.cumsum(np.log(np.arange(1, 50)))])
    assert fisher_two_sided(3, 1, 1, 3, fact) == pytest.approx(34 / 70) and fisher_two_sided(10, 0, 0, 10, fact) == pytest.approx(2 / 184756)


def test_patterns(spark):
    r = spark.createDataFrame([(0, "c", "+", 1, "Z..Z", "ACGT"), (1, "c", "+", 1, "Z..z", "ACGT"), (2, "c", "-", 2, "Z..Z", "ACGT"), (3, "c", "+", 1, "....", "ACGT")], "templid long, rname string, strand string, start int, xm string, seq string")
    p = patterns.patterns(r, "c", 1, 10)
    assert table(p, "templid", "nbase", "beta", "codes") == [(0, 2, 1.0, "1:Z,4:Z"), (1, 2, 0.5, "1:Z,4:z"), (2, 2, 1.0, "1:Z,4:Z")]
    assert patterns.patterns(r, "c", 50, 60).count() == 0
    same = patterns.patterns(r, "c", 1, 10, highlight=(3, 3, 99))
    assert table(same, "templid", "codes")[0] == (0, "1:Z,3:G,4:Z")
    top = patterns.select_patterns(p, per_bin=1)
    assert table(top, "bin", "count", "codes") == [(6, 1, "1:Z,4:z"), (10, 2, "1:Z,4:Z")]
    assert sum(x.n for x in patterns.bin_counts(top).collect()) == 2
    wide = patterns.wide(p, patterns.pattern_bases(r, "c", 1, 10))
    assert {"1", "4"} <= set(wide.columns)


def test_files(spark, tmp_path):
    (tmp_path / "t.bed").write_text("chr\tstart\tend\tname\nchr1\t1\t10\ta\nchr1\t5\t20\tb\n\nchr2\t1\t2\tc\n")
    bed = text.read_bed(spark, str(tmp_path / "t.bed"))
    assert table(bed, "bed_row", "seqnames", "start", "end", "width", "name")[1] == (2, "chr1", 5, 20, 16, "b")
    assert table(regions.reduce_intervals(bed), "seqnames", "start", "end") == [("chr1", 1, 20), ("chr2", 1, 2)]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\n1\t7\t.\tA\tG\t.\n2\t9\trs1\tC\tT\t.\n")
    assert table(text.read_vcf(spark, str(tmp_path / "v.vcf"), bed, "UCSC"), "name", "pos") == [("chr1:7_A/G", 7)]
    (tmp_path / "g.fa").write_text(">one x > y\nACGR\nacg\n>two\nTT\n")
    g = text.read_fasta(spark, str(tmp_path / "g.fa"))
    assert table(g, "rname", "rlen", "seq") == [("one", 7, "ACGNACG"), ("two", 2, "TT")]
    text.check_fasta(g, [("one", 7), ("two", 2)])
    with pytest.raises(ValueError):
        text.check_fasta(g, [("one", 7)])
    text.write_report(bed.select("seqnames", "start"), str(tmp_path / "out"), order=["bed_row"])
    assert next((tmp_path / "out").glob("part*.csv")).read_text().splitlines()[:2] == ["seqnames\tstart", "chr1\t1"]


def test_bam_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.bam")
    rows = bam.simulate(spark, pos=[1, 5, 9], xm=["ZZz", "zxh.H"], xg="CT", ml=[1, 2, 200]).orderBy("rec_no").toPandas().to_dict("records")
    out = [{**r, "tags": {"XM": r["xm"], "XG": r["xg"], "ML": [int(v) for v in r["ml"]]}} for r in rows]
    assert bam.write_bam(iter(out), path, [("chrS", 1000)]) == 3
    bam.register(spark)
    got = spark.read.format("epibam").load(path).orderBy("rec_no").collect()
    assert [(g.qname, g.pos, g.seq, g.xm, list(g.ml)) for g in got] == [(r["qname"], r["pos"], r["seq"], r["xm"], [1, 2, 200]) for r in rows]


def test_cut_bam_files_raise(spark, tmp_path):
    path = tmp_path / "x.bam"
    rows = bam.simulate(spark, pos=[1, 5, 9, 20], xm="ZZz", xg="CT").toPandas().to_dict("records")
    bam.write_bam(iter([{**r, "tags": {"XM": r["xm"]}} for r in rows]), str(path), [("chrS", 1000)])
    assert len(list(bam.read_records(str(path)))) == 4
    import gzip

    whole = b"".join(bam._stream(str(path)))
    for n in (len(whole) - 2, len(whole) - 60):  # inside the last record, or its size
        path.write_bytes(gzip.compress(whole[:n]))
        with pytest.raises(ValueError, match="cut short"):
            list(bam.read_records(str(path)))
    path.write_bytes(gzip.compress(whole)[:-12])
    with pytest.raises(ValueError, match="cut short"):
        list(bam.read_records(str(path)))


def test_targets_are_looked_up_as_by_join(spark, monkeypatch):
    import random

    r = random.Random(3)
    reads = spark.createDataFrame([(i, r.choice("ab"), "+", r.randrange(1, 30_000), "Z" * r.choice([1, 40, 300, 9_000, 20_000]), "") for i in range(120)], "templid long, rname string, strand string, start int, xm string, seq string")
    targets = spark.createDataFrame([(i, r.choice("abc"), s, s + r.randrange(1, 6_000)) for i in range(60) for s in [r.randrange(1, 30_000)]], "bed_row int, seqnames string, start int, end int")
    for kind, options in (("amplicon", {"tolerance": 150}), ("capture", {"min_overlap": 20})):
        got = table(regions.match_targets(reads, targets, kind, **options), "templid", "bed_row")
        monkeypatch.setattr(regions, "BROADCAST_TARGETS", 0)
        assert got == table(regions.match_targets(reads, targets, kind, **options), "templid", "bed_row")
        monkeypatch.undo()
        assert any(b is not None for _, b in got)


def test_calling_over_tiles(spark, monkeypatch):
    import random

    r = random.Random(4)
    seq = "".join(r.choice("ACGT") for _ in range(300))
    g = spark.createDataFrame([(0, "c", 300, seq)], "rid long, rname string, rlen long, seq string")
    rows = [(i, 0, "c", p, f"{n}M", seq[p - 1 : p - 1 + n], "CT" if i % 2 else "GA") for i, (p, n) in enumerate([(1, 300), (1, 10), (30, 5), (31, 40), (64, 64), (290, 11), (33, 200)])]
    a = spark.createDataFrame(rows, "rec_no long, flag int, rname string, pos int, cigar string, seq string, xg string")
    whole = table(calling.call_methylation(a, g), "rec_no", "xm")
    monkeypatch.setattr(calling, "TILE", 32)
    monkeypatch.setattr(calling, "OVERLAP", 8)
    assert table(calling.call_methylation(a, g), "rec_no", "xm") == whole and len(whole) == 7


def test_one_call_reports(spark, tmp_path):
    path = str(tmp_path / "x.bam")
    rows = bam.simulate(spark, pos=[9, 1, 5], xm=["ZZz", "zxh.H", "Z.Z"], xg="CT").orderBy("rec_no").toPandas().to_dict("records")
    bam.write_bam(iter([{**r, "tags": {"XM": r["xm"], "XG": r["xg"]}} for r in rows]), path, [("chrS", 1000)])
    out = api.cytosine_report(spark, path, report_file=str(tmp_path / "cx"), threshold=False, report_context="CX")
    lines = next((tmp_path / "cx").glob("part*.csv")).read_text().splitlines()
    assert len(lines) == 1 + out.count() and [int(x.split("\t")[2]) for x in lines[1:]] == sorted(x.pos for x in out.collect())
    (tmp_path / "t.bed").write_text("chrS\t1\t5\nchrS\t900\t990\n")
    api.capture_report(spark, path, str(tmp_path / "t.bed"), report_file=str(tmp_path / "bed"))
    assert [x.split("\t")[0] for x in next((tmp_path / "bed").glob("part*.csv")).read_text().splitlines()[1:3]] == ["1", "2"]
    assert api.mhl_report(spark, path).count() > 0 and api.extract_patterns(spark, path, "chrS", 1, 20).count() == 3


def test_fnv_ids(spark, four):
    known = {b"": "CBF29CE484222325", b"a": "AF63DC4C8601EC8C", b"foobar": "85944171F73967E8"}  # of the published test suite
    got = spark.createDataFrame([(k,) for k in [*known, None]], "d binary").select("d", hashing.fnv1a_hex("d").alias("h")).collect()
    assert {None if r.d is None else bytes(r.d): r.h for r in got} == {**known, None: None}
    ids = table(patterns.fnv_ids(patterns.pattern_bases(four, "chr1", 1, 16)), "templid", "pattern")
    of = {i: p for i, p in ids}
    assert of[1] == of[2] != of[3] and all(len(p) == 16 for p in of.values())
    z = hashing.fnv1a_64([bytes([4, 0, 0, 0, 7, 7, 0, 0, 0, 15])])[0]
    assert of[1] == f"{int(z):016X}"


def test_streaming_counts(spark, tmp_path):
    reads = spark.createDataFrame([(i, "chr1", "+", 1, x, "") for i, x in enumerate(READS)], "templid long, rname string, strand string, start int, xm string, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    s = streaming.cytosine_counts(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("cx_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert table(spark.table("cx_counts"), *s.columns) == table(streaming.cytosine_counts(reads), *s.columns)


def test_contexts_are_checked(four):
    with pytest.raises(ValueError):
        context("CXX")
    assert reports.cytosine_report(four, threshold_context="CX", report_context="CX").count() == 5


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
