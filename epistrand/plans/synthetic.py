"""Deterministic reads, targets, variants and alignments from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import strings as st
from ..functions.contexts import n_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASES_OF = "ACGTACGTACGTACGTACGTACGTACN"
SPAN = 20_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores if the scan has few splits: the reader can't split a row group, so most may be empty."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < 4 * n else df


_LETTER = st.table({UPPER + LOWER: LOWER + LOWER}, "-")
_BASE = st.table({LOWER + "-": BASES_OF})[_LETTER]


def _site_table() -> np.ndarray:
    """The character of xm by (start % 4, whether templid is no multiple of 3, place % 12 or that plus 12, byte of the text)."""
    out = np.full((4, 2, 24, 256), ord("."), np.uint8)
    for start in range(4):
        for third in range(2):
            for i in range(24):
                at = (start + i % 12) % 4
                for byte in range(256):
                    c = chr(_LETTER[byte])
                    z = "Z" if c != "-" and ((c < "n" and third) or c < "c") else "z"
                    site = (z, "X" if c == "q" else "x", "H" if c == "j" else "h", ".")[at]
                    out[start, third, i, byte] = ord("-" if c == "-" and i % 3 == 0 else site)
    return out.reshape(-1)


_SITE = _site_table()
_TURNED = st.table({"ACGT": "CGTA"})


@F.arrow_udf(StringType())
def _as_letters(text: pa.Array) -> pa.Array:
    return st.of_chars(text, lambda x, o, rows: _LETTER[x])


@F.arrow_udf(StringType())
def _as_bases(text: pa.Array) -> pa.Array:
    return st.of_chars(text, lambda x, o, rows: _BASE[x])


@F.arrow_udf(StringType())
def _turned(seq: pa.Array) -> pa.Array:
    return st.of_chars(seq, lambda x, o, rows: _TURNED[x])


@F.arrow_udf(StringType())
def _as_sites(text: pa.Array, start: pa.Array, templid: pa.Array) -> pa.Array:
    row = (st.numbers(start) % 4 * 2 + (st.numbers(templid) % 3 != 0)).astype(np.uint16) * 24

    def one(x: np.ndarray, o: np.ndarray, rows: slice) -> np.ndarray:
        kind = np.repeat(row[rows], np.diff(o)) + st.cycle(o, 12)
        return _SITE[(kind.astype(np.int32) << 8) | x]

    return st.of_chars(text, one)


@F.arrow_udf(StringType())
def _converted(text: pa.Array, templid: pa.Array) -> pa.Array:
    """Bases with every third one converted: C to T on even ids, G to A on odd ones."""
    even = st.numbers(templid) % 2 == 0

    def one(x: np.ndarray, o: np.ndarray, rows: slice) -> np.ndarray:
        b = _BASE[x]
        third, plus = st.cycle(o, 3) % 3 == 0, np.repeat(even[rows], np.diff(o))
        b[third & plus & (b == ord("C"))] = ord("T")
        b[third & ~plus & (b == ord("G"))] = ord("A")
        return b

    return st.of_chars(text, one)


@F.arrow_udf(StringType())
def _fifths(text: pa.Array, templid: pa.Array) -> pa.Array:
    """Qualities: ``+`` where place and id make a multiple of five, else ``F``."""
    first = st.numbers(templid) % 5
    return st.of_chars(text, lambda x, o, rows: np.where(st.cycle(o, 5, first=first[rows]) % 5 == 0, np.uint8(ord("+")), np.uint8(ord("F"))))


@F.arrow_udf(StringType())
def _qualities(seq: pa.Array, first: pa.Array, step: pa.Array) -> pa.Array:
    """Qualities that rise by ``step`` from ``first``, modulo 41."""
    at, by = st.numbers(first) % 41, int(st.numbers(step)[0]) if len(step) else 1
    return st.of_chars(seq, lambda x, o, rows: 33 + st.cycle(o, 41, by, at[rows]) % 41)


@F.arrow_udf(ArrayType(IntegerType()))
def _probabilities(n: pa.Array, templid: pa.Array) -> pa.Array:
    """For each of ``n`` sites (k * 37 + id) % 256, k from 1."""
    sizes, ids = st.numbers(n), st.numbers(templid)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    k = np.arange(1, offsets[-1] + 1) - np.repeat(offsets[:-1], sizes)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(((k * 37 + np.repeat(ids, sizes)) % 256).astype(np.int32)))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """templid, rname, strand, start, text and n, its characters: texts with letters, bases and sites are made of it in Arrow batches."""
    strand = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")
    start = (F.lit(1) + (F.col("doc_id") * 37) % SPAN).cast("int")
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where("text <> ''"))
    return docs.select(F.col("doc_id").alias("templid"), F.col("lang").alias("rname"), strand.alias("strand"), start.alias("start"), "text", F.length("text").alias("n"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """templid, rname, strand, start, t: whole texts as lower-case letters and ``-``."""
    return _documents(spark, sf_dir).select("templid", "rname", "strand", "start", _as_letters("text").alias("t"))


def _reads(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    xm = _as_sites("text", "start", "templid")
    return _documents(spark, sf_dir).select("templid", "rname", "strand", "start", xm.alias("xm"), _as_bases("text").alias("seq"), *more)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir)


def _lang(key: str):
    k = F.col(key) % 4
    return F.when(k == 0, "en").when(k == 1, "fr").when(k == 2, "de").otherwise("es")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    start = (1 + (k * 53) % SPAN).cast("int")
    return _table(spark, sf_dir, "supplier").select(k.cast("int").alias("bed_row"), _lang("s_suppkey").alias("seqnames"), start.alias("start"), (start + 199 + k % 300).cast("int").alias("end"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    base = lambda i: F.expr(f"substring('ACGT', cast({i} as int) + 1, 1)")
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("rs"), k.cast("string")).alias("name"), _lang("p_partkey").alias("seqnames"), (1 + (k * 17) % SPAN).cast("int").alias("pos"), base("p_partkey % 4").alias("ref"), base("(p_partkey % 4 + 1 + (p_partkey div 4) % 3) % 4").alias("alt"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document; long ones have clips, an insertion and a deletion."""
    r = _reads(spark, sf_dir, "text", "n")
    n = F.col("n")
    cigar = F.when(n < 20, F.concat(n.cast("string"), F.lit("M"))).otherwise(F.concat(F.lit("2S5M3I2D"), (n - 10).cast("string"), F.lit("M")))
    qual = _fifths("text", "templid")
    flag = F.when(F.col("templid") % 11 == 0, 256).when(F.col("templid") % 13 == 0, 1024).when(F.col("templid") % 17 == 0, 4).otherwise(0)
    return r.select(F.col("templid").alias("rec_no"), F.concat(F.lit("q"), F.col("templid").cast("string")).alias("qname"), flag.alias("flag"), "rname", F.col("start").alias("pos"), (F.col("templid") % 60).cast("int").alias("mapq"), cigar.alias("cigar"), "seq", "xm", qual.alias("qual"), F.when(F.col("strand") == "+", "CT").otherwise("GA").alias("xg"))


def genome_and_reads(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """A contig a document, and one bisulfite read over the whole of it: every third base is converted."""
    d = _documents(spark, sf_dir)
    genome = d.select(F.col("templid").alias("rid"), F.col("templid").cast("string").alias("rname"), F.col("n").cast("long").alias("rlen"), _as_bases("text").alias("seq"))
    even = F.col("templid") % 2 == 0
    a = d.select(F.col("templid").alias("rec_no"), F.lit(0).alias("flag"), F.col("templid").cast("string").alias("rname"), F.lit(1).alias("pos"), F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar"), _converted("text", "templid").alias("seq"), F.when(even, "CT").otherwise("GA").alias("xg"), *more)
    return genome, a


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two proper records a document of three letters or more: its first and its last two thirds, with qualities and bases of their own."""
    r = _reads(spark, sf_dir, "n").where("n >= 3").withColumn("a", F.expr("cast(n * 2 div 3 as int)"))

    def record(no: int, first: Column, flag: int, step: int, turn: bool) -> DataFrame:
        seq, xm = (F.substring(F.col(c), first, F.col("a")) for c in ("seq", "xm"))
        seq, xm = (_turned(seq), F.lower(xm)) if turn else (seq, xm)
        qual = _qualities(seq, (first - 1) * step + F.col("templid") * no, F.lit(step))
        pos = (F.col("start") + first - 1).cast("int")
        return r.select((F.col("templid") * 2 + no - 1).alias("rec_no"), F.concat(F.lit("q"), F.col("templid").cast("string")).alias("qname"), F.lit(flag).alias("flag"), "rname", pos.alias("pos"), F.lit(60).alias("mapq"), F.concat(F.col("a").cast("string"), F.lit("M")).alias("cigar"), F.col("start").alias("pnext"), F.col("n").alias("tlen"), seq.alias("seq"), xm.alias("xm"), qual.alias("qual"), F.when(F.col("strand") == "+", "CT").otherwise("GA").alias("xg"))

    return record(1, F.lit(1), 99, 7, False).unionByName(record(2, F.col("n") - F.col("a") + 1, 147, 5, True))


def long_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long read a document: every C of the original strand has a probability of 5mC; every third read runs backwards."""
    r = _reads(spark, sf_dir, F.col("n").alias("size"))
    reverse = F.col("templid") % 3 == 0
    n = F.when(reverse, n_of("seq", "G")).otherwise(n_of("seq", "C"))
    ml = _probabilities(n, "templid")
    return r.select(F.col("templid").alias("rec_no"), F.concat(F.lit("q"), F.col("templid").cast("string")).alias("qname"), F.when(reverse, 16).otherwise(0).alias("flag"), "rname", F.col("start").alias("pos"), F.lit(60).alias("mapq"), F.concat(F.col("size").cast("string"), F.lit("M")).alias("cigar"), "seq", F.repeat(F.lit("I"), F.col("size")).alias("qual"), F.when(n > 0, F.concat(F.lit("C+m"), F.repeat(F.lit(",0"), n))).alias("mm"), F.when(n > 0, ml).alias("ml"))


def raw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with several alternative alleles, insertions and deletions among them."""
    k = F.col("name").substr(F.lit(3), F.lit(20)).cast("long")
    turned = F.translate("alt", "ACGT", "CGTA")
    other = F.when(turned == F.col("ref"), F.translate("ref", "ACGT", "CGTA")).otherwise(turned)
    alt = F.when(k % 5 == 0, F.concat("alt", F.lit(","), other)).when(k % 7 == 0, F.concat("alt", F.lit(",AC"))).when(k % 11 == 0, F.lit("GG")).otherwise(F.col("alt"))
    return variants(spark, sf_dir).withColumn("alt", alt).withColumn("ref", F.when(k % 13 == 0, F.concat("ref", F.lit("T"))).otherwise(F.col("ref")))


def clipped_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As ``genome_and_reads``, for reads of 30 bases and more with a soft clip, an insertion, a deletion, a skip and mismatches."""
    genome, a = genome_and_reads(spark, sf_dir, "n")
    n = F.col("n")
    a = a.where(n >= 30).withColumn("cigar", F.concat(F.lit("2S5M3I2D4X3N"), (n - 19).cast("string"), F.lit("M5S")))
    return genome, a.drop("n")


LETTERS_SQL = f"""letters AS (
  SELECT doc_id AS templid, lang AS rname, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
         CAST(1 + (doc_id * 37) % {SPAN} AS INTEGER) AS start, regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z]', '-', 'g') AS t
  FROM documents WHERE text <> '')"""
READS_SQL = f"""{LETTERS_SQL}, reads AS (
  SELECT templid, rname, strand, start, translate(t, '{LOWER}-', '{BASES_OF}') AS seq,
         array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE
           WHEN c = '-' AND (i - 1) % 3 = 0 THEN '-'
           WHEN (start + i - 1) % 4 = 0 THEN CASE WHEN c <> '-' AND ((c < 'n' AND templid % 3 <> 0) OR c < 'c') THEN 'Z' ELSE 'z' END
           WHEN (start + i - 1) % 4 = 1 THEN CASE WHEN c = 'q' THEN 'X' ELSE 'x' END
           WHEN (start + i - 1) % 4 = 2 THEN CASE WHEN c = 'j' THEN 'H' ELSE 'h' END ELSE '.' END), '') AS xm
  FROM letters)"""
LANG_SQL = "CASE {k} % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"
TARGETS_SQL = f"""targets AS (
  SELECT CAST(s_suppkey AS INTEGER) AS bed_row, {LANG_SQL.format(k="s_suppkey")} AS seqnames, CAST(1 + (s_suppkey * 53) % {SPAN} AS INTEGER) AS start,
         CAST(1 + (s_suppkey * 53) % {SPAN} + 199 + s_suppkey % 300 AS INTEGER) AS "end" FROM supplier)"""
VARIANTS_SQL = f"""variants AS (
  SELECT 'rs' || p_partkey AS name, {LANG_SQL.format(k="p_partkey")} AS seqnames, CAST(1 + (p_partkey * 17) % {SPAN} AS INTEGER) AS pos,
         substr('ACGT', CAST(p_partkey % 4 + 1 AS BIGINT), 1) AS ref, substr('ACGT', CAST((p_partkey % 4 + 1 + (p_partkey // 4) % 3) % 4 + 1 AS BIGINT), 1) AS alt FROM part)"""
PAIRS_SQL = f"""{READS_SQL}, paired AS (SELECT templid, rname, strand, start, seq, xm, length(xm) AS n, length(xm) * 2 // 3 AS a FROM reads WHERE length(xm) >= 3)"""
RAW_VARIANTS_SQL = f"""{VARIANTS_SQL}, raw_variants AS (SELECT name, seqnames, pos, CASE WHEN k % 13 = 0 THEN ref || 'T' ELSE ref END AS ref,
  CASE WHEN k % 5 = 0 THEN alt || ',' || CASE WHEN translate(alt, 'ACGT', 'CGTA') = ref THEN translate(ref, 'ACGT', 'CGTA') ELSE translate(alt, 'ACGT', 'CGTA') END WHEN k % 7 = 0 THEN alt || ',AC' WHEN k % 11 = 0 THEN 'GG' ELSE alt END AS alt
  FROM (SELECT *, CAST(substr(name, 3) AS BIGINT) AS k FROM variants))"""
