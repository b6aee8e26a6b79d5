"""All core queries by name, and their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contexts import CONTEXTS
from ..operators import alignments as al
from ..operators import calling, patterns, regions, reports, variants
from ..sources import text
from . import synthetic as syn

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _n(chars: str, xm: str = "xm") -> str:
    return f"(length({xm}) - length(regexp_replace({xm}, '[{chars}]', '', 'g')))" if chars else "0"


def _pass_sql(name: str = "CG", min_sites: int = 2, min_beta: float = 0.5, max_out: float = 0.1) -> str:
    c = CONTEXTS[name]
    m, u, om, ou = _n(c.meth), _n(c.unmeth), _n(c.out_meth), _n(c.out_unmeth)
    return f"CASE WHEN {m} = 0 OR {m} + {u} < {min_sites} OR {m} / ({m} + {u})::DOUBLE < {min_beta} THEN false WHEN {om} > 0 AND {om} / ({om} + {ou})::DOUBLE > {max_out} THEN false ELSE true END"


_PASSED = f"{syn.READS_SQL}, passed AS (SELECT *, {_pass_sql()} AS pass FROM reads)"


@_query("reads_synth", f"WITH {syn.READS_SQL} SELECT templid, rname, strand, start, xm, seq FROM reads")
def reads_synth(spark: SparkSession, sf: str) -> DataFrame:
    return syn.reads(spark, sf)


@_query("read_threshold", f"WITH {_PASSED} SELECT templid, pass FROM passed")
def read_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return reports.with_pass(syn.reads(spark, sf)).select("templid", "pass")


_m, _u = _n("Z"), _n("z")


@_query("read_beta", f"WITH {syn.READS_SQL} SELECT templid, round(CASE WHEN {_m} + {_u} = 0 THEN 0 ELSE {_m} / ({_m} + {_u})::DOUBLE END, 9) AS beta_in, round(CASE WHEN {_n('XHxh')} = 0 THEN 0 ELSE {_n('XH')} / {_n('XHxh')}::DOUBLE END, 9) AS beta_out FROM reads")
def read_beta(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.read_betas(syn.reads(spark, sf)), "beta_in", "beta_out")


_BASES = "bases AS (SELECT rname, strand, CAST(start + i AS INTEGER) AS pos, c FROM (SELECT rname, strand, start, unnest(string_split(x, '')) AS c, unnest(range(length(x))) AS i FROM src) WHERE c NOT IN ('-', '+'))"


def _cx_sql(threshold: bool, shown: tuple[str, ...]) -> str:
    x = "CASE WHEN pass THEN xm ELSE lower(xm) END" if threshold else "xm"
    counts = ", ".join(f"count(*) FILTER (lower(c) = '{k}') AS n_{k}, count(*) FILTER (c = '{k.upper()}') AS m_{k}" for k in "hxz")
    pick = lambda p: f"CASE context WHEN 'CHH' THEN {p}h WHEN 'CHG' THEN {p}x ELSE {p}z END"
    return f"""WITH {_PASSED}, src AS (SELECT rname, strand, start, {x} AS x FROM passed), {_BASES},
g AS (SELECT rname, pos, strand, count(*) AS cov, {counts} FROM bases GROUP BY ALL),
w AS (SELECT *, CASE WHEN 2 * n_h > cov THEN 'CHH' WHEN 2 * n_x > cov THEN 'CHG' WHEN 2 * n_z > cov THEN 'CG' END AS context FROM g)
SELECT rname, strand, pos, context, {pick('m_')} AS meth, {pick('n_')} - ({pick('m_')}) AS unmeth FROM w WHERE context IN ({', '.join(repr(s) for s in shown)})"""


def _add_cytosine(name: str, threshold: bool, shown: str) -> None:
    @_query(name, _cx_sql(threshold, CONTEXTS[shown].reported))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return reports.cytosine_report(syn.reads(spark, sf), threshold=threshold, report_context=shown)


for _name, _t, _c in (("vef", True, "CG"), ("beta", False, "CG"), ("cx", True, "CX"), ("chg", False, "CHG"), ("chh", False, "CHH"), ("cxg", True, "CxG")):
    _add_cytosine(f"cytosine_report_{_name}", _t, _c)


def _mhl_sql(cap: int, least: int, max_out: float = 0.1) -> str:
    s = lambda n: f"(least({n}, {cap}) * (least({n}, {cap}) + 1) * (least({n}, {cap}) + 2) // 6)"
    counts = ", ".join(f"count(*) FILTER (lower(c) = '{k}') AS n_{k}" for k in "hxz")
    return f"""WITH {syn.READS_SQL},
kept AS (SELECT *, {_n('Zz')} AS hs FROM reads WHERE {_n('Zz')} >= {least} AND NOT ({_n('XHU')} > {max_out} * {_n('XHUxhu')} AND {_n('XHUxhu')} > 0 AND {_n('XHU')} / greatest({_n('XHUxhu')}, 1)::DOUBLE > {max_out})),
b AS (SELECT templid, rname, strand, start, hs, unnest(string_split(xm, '')) AS c, unnest(range(length(xm))) AS i FROM kept),
isl AS (SELECT *, sum(CASE WHEN c = 'z' THEN 1 ELSE 0 END) OVER (PARTITION BY templid ORDER BY i) AS g FROM b),
st AS (SELECT *, count(*) FILTER (c = 'Z') OVER w AS m, min(CASE WHEN c = 'Z' THEN i END) OVER w AS a, max(CASE WHEN c = 'Z' THEN i END) OVER w AS z FROM isl WINDOW w AS (PARTITION BY templid, g)),
v AS (SELECT rname, strand, CAST(start + i AS INTEGER) AS pos, c, hs, CASE WHEN i BETWEEN a AND z THEN {s('m')} ELSE 0 END AS num, {s('hs')} AS den FROM st WHERE c NOT IN ('-', '+')),
q AS (SELECT rname, pos, strand, count(*) AS cov, {counts}, sum(hs) AS hs, sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den FROM v GROUP BY ALL)
SELECT rname, strand, pos, 'CG' AS context, n_z AS coverage, round(hs / n_z::DOUBLE, 9) AS length, round(CASE WHEN den = 0 THEN 0 ELSE num / den END, 9) AS lmhl FROM q WHERE 2 * n_z > cov AND 2 * n_h <= cov AND 2 * n_x <= cov"""


def _add_mhl(name: str, window: int, least: int) -> None:
    @_query(name, _mhl_sql(window or 65535, least))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(reports.mhl_report(syn.reads(spark, sf), max_window=window, min_length=least), "length", "lmhl")


for _name, _w, _l in (("mhl_report", 0, 0), ("mhl_window1", 1, 0), ("mhl_minlen", 0, 100)):
    _add_mhl(_name, _w, _l)

TOLERANCE, OVERLAP = 30, 20
_ON = {
    "amplicon": f"(abs(r.start - t.start) <= {TOLERANCE} OR abs(r.start + length(r.xm) - 1 - t.\"end\") <= {TOLERANCE})",
    "capture": f"least(r.start + length(r.xm) - 1, t.\"end\") - greatest(r.start, t.start) + 1 >= {OVERLAP}",
}


def _matched(kind: str) -> str:
    return f"""{_PASSED}, {syn.TARGETS_SQL}, f AS (SELECT templid, min(bed_row) AS bed_row FROM reads r JOIN targets t ON r.rname = t.seqnames AND {_ON[kind]} GROUP BY templid),
matched AS (SELECT p.*, f.bed_row FROM passed p LEFT JOIN f USING (templid))"""


def _region_sql(kind: str, threshold: bool) -> str:
    vef = "round(count(*) FILTER (pass) / count(*)::DOUBLE, 9)" if threshold else "CAST(NULL AS DOUBLE)"
    return f"""WITH {_matched(kind)}, g AS (SELECT bed_row, count(*) FILTER (strand = '+') AS "nreads+", count(*) FILTER (strand = '-') AS "nreads-", {vef} AS "VEF" FROM matched GROUP BY bed_row)
SELECT coalesce(t.bed_row, g.bed_row) AS bed_row, t.seqnames, t.start, t."end", g."nreads+", g."nreads-", g."VEF" FROM targets t FULL JOIN g ON t.bed_row = g.bed_row"""


def _options(kind: str) -> dict:
    return {"tolerance": TOLERANCE} if kind == "amplicon" else {"min_overlap": OVERLAP}


def _add_region(kind: str) -> None:
    @_query(f"match_{kind}", f"WITH {_matched(kind)} SELECT templid, bed_row FROM matched")
    def match(spark: SparkSession, sf: str) -> DataFrame:
        return regions.match_targets(syn.reads(spark, sf), syn.targets(spark, sf), kind, **_options(kind)).select("templid", "bed_row")

    for threshold in (True, False):

        @_query(f"{kind}_report" + ("" if threshold else "_nothreshold"), _region_sql(kind, threshold))
        def report(spark: SparkSession, sf: str, threshold: bool = threshold) -> DataFrame:
            out = regions.region_report(syn.reads(spark, sf), syn.targets(spark, sf), kind, threshold=threshold, **_options(kind))
            return _rounded(out, "VEF")


for _kind in ("amplicon", "capture"):
    _add_region(_kind)


@_query("bed_ecdf", f"""WITH {_matched('capture')}, l AS (
SELECT bed_row, 'context' AS kind, CASE WHEN {_n('Zz')} = 0 THEN 0 ELSE {_n('Z')} / {_n('Zz')}::DOUBLE END AS beta FROM matched
UNION ALL SELECT bed_row, 'out.of.context', CASE WHEN {_n('XHxh')} = 0 THEN 0 ELSE {_n('XH')} / {_n('XHxh')}::DOUBLE END FROM matched)
SELECT DISTINCT bed_row, kind, round(beta, 9) AS beta, round(cume_dist() OVER (PARTITION BY bed_row, kind ORDER BY beta), 9) AS cum_frac FROM l""")
def bed_ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(regions.region_ecdf(syn.reads(spark, sf), syn.targets(spark, sf), "capture", min_overlap=OVERLAP), "beta", "cum_frac")


@_query("interval_reduce", f"""WITH {syn.TARGETS_SQL}, a AS (SELECT *, max("end") OVER (PARTITION BY seqnames ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM targets),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seqnames ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT seqnames, min(start) AS start, max("end") AS "end" FROM b GROUP BY seqnames, g""")
def interval_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return regions.reduce_intervals(syn.targets(spark, sf))


_GROUPS = [(m, s) for m in "MU" for s in "+-"]
_FREQS = f"""{_PASSED}, {syn.VARIANTS_SQL}, hits AS (
  SELECT v.name, r.pass, r.strand, substr(r.seq, v.pos - r.start + 1, 1) AS b FROM passed r JOIN variants v ON r.rname = v.seqnames AND v.pos BETWEEN r.start AND r.start + length(r.seq) - 1),
freqs AS (SELECT v.name, v.seqnames, v.pos, v.ref, v.alt, {', '.join(f'''count(*) FILTER (h.pass = {'true' if m == 'M' else 'false'} AND h.strand = '{s}' AND h.b = '{b}') AS "{m}{s}{b}"''' for m, s in _GROUPS for b in 'ACGT')}
  FROM variants v LEFT JOIN hits h USING (name) GROUP BY ALL)"""


@_query("base_freqs", f"WITH {_FREQS} SELECT * FROM freqs")
def base_freqs(spark: SparkSession, sf: str) -> DataFrame:
    return variants.base_counts(reports.with_pass(syn.reads(spark, sf)), syn.variants(spark, sf))


def _allele_sql(m: str, s: str, a: str) -> str:
    own, other = ("ref", "alt") if a == "Ref" else ("alt", "ref")
    kept, turned = ("C", "T") if s == "+" else ("G", "A")
    plain = " ".join(f"WHEN {own} = '{b}' THEN \"{m}{s}{b}\"" for b in "ACGT" if b != kept)
    return f"CASE WHEN {own} IN ('{kept}', '{turned}') AND {other} IN ('{kept}', '{turned}') THEN NULL WHEN {own} = '{kept}' THEN \"{m}{s}{kept}\" + \"{m}{s}{turned}\" {plain} END"


_ALLELES = ", ".join(f'{_allele_sql(m, s, a)} AS "{m}{s}{a}"' for m, s in _GROUPS for a in ("Ref", "Alt"))
_SUMS = ", ".join(" + ".join(f'coalesce("{m}{s}{a}", 0)' for m, s in _GROUPS) + f' AS "Sum{a}"' for a in ("Ref", "Alt"))


@_query("variant_counts", f'WITH {_FREQS}, al AS (SELECT name, seqnames, pos AS "range", ref AS "REF", alt AS "ALT", {_ALLELES} FROM freqs) SELECT *, {_SUMS} FROM al')
def variant_counts(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_report(syn.reads(spark, sf), syn.variants(spark, sf), test=False)


def _fisher_sql(s: str) -> str:
    a, b, c, d = (f'"{m}{s}{x}"' for x in ("Ref", "Alt") for m in "MU")
    lf = lambda x: f"lgamma(({x})::DOUBLE + 1)"
    n = f"({a} + {b} + {c} + {d})"
    lp = lambda x: f"({lf(f'{a} + {b}')} + {lf(f'{c} + {d}')} + {lf(f'{a} + {c}')} + {lf(f'{b} + {d}')} - {lf(n)} - {lf(x)} - {lf(f'{a} + {b} - {x}')} - {lf(f'{a} + {c} - {x}')} - {lf(f'{d} - {a} + {x}')})"
    xs = f"range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1)"
    return f"CASE WHEN {n} IS NULL THEN NULL ELSE round(least(1.0, list_sum(list_transform({xs}, lambda x: CASE WHEN {lp('x')} <= {lp(a)} + 1e-7 THEN exp({lp('x')}) ELSE 0 END))), 6) END"


@_query("fisher_p", f"""WITH {_FREQS}, al AS (SELECT name, {_ALLELES} FROM freqs) SELECT name, {_fisher_sql('+')} AS "FEp+", {_fisher_sql('-')} AS "FEp-" FROM al""")
def fisher_p(spark: SparkSession, sf: str) -> DataFrame:
    r = variants.variant_report(syn.reads(spark, sf), syn.variants(spark, sf))
    return r.select("name", F.round("`FEp+`", 6).alias("FEp+"), F.round("`FEp-`", 6).alias("FEp-"))


REGION = ("en", 5000, 5300)
_PAT = f"""{syn.READS_SQL}, own AS (SELECT *, start + length(xm) - 1 AS stop FROM reads WHERE rname = 'en' AND least(start + length(xm) - 1, 5300) - greatest(start, 5000) + 1 >= 1),
s AS (SELECT templid, strand, start, stop, start + i AS spot, c, CAST(start + i - CASE WHEN strand = '-' THEN 1 ELSE 0 END AS INTEGER) AS pos, substr(seq, i + 1, 1) AS b FROM
  (SELECT templid, strand, start, stop, seq, unnest(string_split(xm, '')) AS c, unnest(range(length(xm))) AS i FROM own)),
cut AS (SELECT * FROM s WHERE spot BETWEEN 5000 AND 5300)"""


def _pattern_sql(marks: tuple[int, ...] = ()) -> str:
    drop = f" AND pos NOT IN ({', '.join(map(str, marks))})" if marks else ""
    body = f"""WITH {_PAT}, sites AS (SELECT * FROM cut WHERE c IN ('Z', 'z'){drop}),
common AS (SELECT pos FROM sites GROUP BY pos HAVING count(*) >= 0.01 * (SELECT count(*) FROM own)),
k AS (SELECT templid, strand, start, stop, pos, c AS code, true AS site FROM sites SEMI JOIN common USING (pos))"""
    if marks:
        body += f""", l AS (SELECT * FROM k UNION ALL SELECT templid, strand, start, stop, CAST(spot AS INTEGER), b, false FROM cut WHERE spot IN ({', '.join(map(str, marks))}) AND templid IN (SELECT templid FROM k))"""
    else:
        body += ", l AS (SELECT * FROM k)"
    return body + """, p AS (SELECT templid, strand, min(start) AS start, CAST(max(stop) AS INTEGER) AS "end", count(*) FILTER (site) AS nbase, round(count(*) FILTER (site AND code = 'Z') / count(*) FILTER (site)::DOUBLE, 9) AS beta, string_agg(pos || ':' || code, ',' ORDER BY pos, code) AS codes FROM l GROUP BY templid, strand)"""


def _patterns(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return _rounded(patterns.patterns(syn.reads(spark, sf), *REGION, "CG", clip=True, **kw), "beta")


@_query("patterns_long", _pattern_sql() + " SELECT templid, pos, code FROM l")
def patterns_long(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.pattern_bases(syn.reads(spark, sf), *REGION, "CG", clip=True).select("templid", "pos", "code")


@_query("patterns_reads", _pattern_sql() + " SELECT * FROM p")
def patterns_reads(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf).drop("pattern")


@_query("patterns_highlight", _pattern_sql((5010, 5100)) + " SELECT * FROM p")
def patterns_highlight(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf, highlight=(5010, 5100, 5100, 9999)).drop("pattern")


_UNIQUE = ", u AS (SELECT codes, nbase, beta, count(*) AS count FROM p GROUP BY ALL)"


@_query("patterns_unique", _pattern_sql() + _UNIQUE + " SELECT * FROM u")
def patterns_unique(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.unique_patterns(_patterns(spark, sf)).drop("pattern")


@_query("patterns_topk_per_bin", _pattern_sql() + _UNIQUE + """, b AS (SELECT *, CAST(least(floor(beta * 10) + 1, 10) AS INTEGER) AS bin FROM u),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY count DESC, codes) <= 2)
SELECT *, CAST(row_number() OVER (ORDER BY beta, count, codes DESC) AS INTEGER) AS rank FROM t""")
def patterns_topk_per_bin(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.select_patterns(_patterns(spark, sf)).drop("pattern")


_ALIGNED = f"""{syn.READS_SQL}, aligned AS (SELECT templid, rname, strand, start, length(xm) AS n, seq, templid % 60 AS mapq,
  CASE WHEN templid % 11 = 0 THEN 256 WHEN templid % 13 = 0 THEN 1024 WHEN templid % 17 = 0 THEN 4 ELSE 0 END AS flag,
  xm, array_to_string(list_transform(string_split(xm, ''), lambda c, i: CASE WHEN (i - 1 + templid) % 5 = 0 THEN '-' ELSE c END), '') AS xq,
  array_to_string(list_transform(string_split(seq, ''), lambda c, i: CASE WHEN (i - 1 + templid) % 5 = 0 THEN 'N' ELSE c END), '') AS sq FROM reads)"""
_PROJ = "CASE WHEN n < 20 THEN {x} ELSE substr({x}, 3, 5) || '{f}{f}' || substr({x}, 11) END"


@_query("flag_filter", f"WITH {_ALIGNED} SELECT templid, flag FROM aligned WHERE flag & {al.skip_mask()} = 0 AND mapq >= 10")
def flag_filter(spark: SparkSession, sf: str) -> DataFrame:
    a = syn.alignments(spark, sf)
    return a.where((F.col("flag").bitwiseAND(al.skip_mask()) == 0) & (F.col("mapq") >= 10)).select(F.col("rec_no").alias("templid"), "flag")


@_query("cigar_project", f"WITH {_ALIGNED} SELECT templid, rname, strand, start, {_PROJ.format(x='sq', f='N')} AS seq, {_PROJ.format(x='xq', f='-')} AS xm FROM aligned WHERE flag & {al.skip_mask()} = 0")
def cigar_project(spark: SparkSession, sf: str) -> DataFrame:
    return al.single_reads(syn.alignments(spark, sf), min_baseq=20)


@_query("trim_reads", f"WITH {_ALIGNED}, p AS (SELECT templid, rname, strand, start, {_PROJ.format(x='seq', f='N')} AS seq, {_PROJ.format(x='xm', f='-')} AS xm FROM aligned WHERE flag & {al.skip_mask()} = 0) SELECT templid, rname, strand, start + 3 AS start, substr(seq, 4, length(xm) - 5) AS seq, substr(xm, 4, length(xm) - 5) AS xm FROM p WHERE length(xm) > 5")
def trim_reads(spark: SparkSession, sf: str) -> DataFrame:
    return al.trimmed(al.single_reads(syn.alignments(spark, sf)), (3, 2))


_CALLED = f"""{syn.LETTERS_SQL}, g AS (SELECT templid, translate(t, '{syn.LOWER}-', '{syn.BASES_OF}') AS g FROM letters),
r AS (SELECT templid, string_split('NN' || g || 'NN', '') AS l, g, list_transform(string_split(g, ''), lambda c, i: CASE WHEN (i - 1) % 3 = 0 AND templid % 2 = 0 AND c = 'C' THEN 'T' WHEN (i - 1) % 3 = 0 AND templid % 2 = 1 AND c = 'G' THEN 'A' ELSE c END) AS q FROM g)
SELECT templid, CASE WHEN templid % 2 = 0 THEN 'CT' ELSE 'GA' END AS xg, array_to_string(CASE WHEN templid % 2 = 0
 THEN list_transform(q, lambda c, i: CASE WHEN l[i + 2] <> 'C' OR c NOT IN ('C', 'T') THEN '.' WHEN l[i + 3] = 'G' THEN CASE WHEN c = 'C' THEN 'Z' ELSE 'z' END WHEN l[i + 4] = 'G' THEN CASE WHEN c = 'C' THEN 'X' ELSE 'x' END ELSE CASE WHEN c = 'C' THEN 'H' ELSE 'h' END END)
 ELSE list_transform(q, lambda c, i: CASE WHEN l[i + 2] <> 'G' OR c NOT IN ('G', 'A') THEN '.' WHEN l[i + 1] = 'C' THEN CASE WHEN c = 'G' THEN 'Z' ELSE 'z' END WHEN l[i] = 'C' THEN CASE WHEN c = 'G' THEN 'X' ELSE 'x' END ELSE CASE WHEN c = 'G' THEN 'H' ELSE 'h' END END) END, '') AS xm FROM r"""


@_query("call_methylation", "WITH " + _CALLED)
def call_methylation(spark: SparkSession, sf: str) -> DataFrame:
    genome, a = syn.genome_and_reads(spark, sf)
    return calling.call_methylation(a, genome).select(F.col("rec_no").alias("templid"), "xg", "xm")


_MERGED = f"""{syn.PAIRS_SQL}, places AS (SELECT templid, rname, strand, start, n, a, unnest(string_split(seq, '')) AS b, unnest(string_split(xm, '')) AS c, unnest(range(n)) AS j FROM paired),
q AS (SELECT templid, rname, strand, start, j, b, c,
  CASE WHEN j < a THEN (j * 7 + templid) % 41 ELSE 0 END AS q1, CASE WHEN j >= n - a THEN (j * 5 + templid * 2) % 41 ELSE 0 END AS q2 FROM places),
w AS (SELECT *, CASE WHEN q1 > 9 AND q1 >= q2 THEN 1 WHEN q2 > 9 THEN 2 ELSE 0 END AS won FROM q)
SELECT templid * 2 AS templid, rname, strand, start,
  string_agg(CASE won WHEN 1 THEN b WHEN 2 THEN translate(b, 'ACGT', 'CGTA') ELSE 'N' END, '' ORDER BY j) AS seq,
  string_agg(CASE won WHEN 1 THEN c WHEN 2 THEN lower(c) ELSE '-' END, '' ORDER BY j) AS xm FROM w GROUP BY ALL"""


@_query("pair_merge", f"WITH {_MERGED}")
def pair_merge(spark: SparkSession, sf: str) -> DataFrame:
    return al.paired_reads(syn.pairs(spark, sf), min_baseq=10)


@_query("sniff_counts", f"""WITH {syn.PAIRS_SQL}, f AS (SELECT templid * 2 + k AS rec_no, 'q' || templid AS qname FROM paired, (SELECT unnest([0, 1]) AS k)),
h AS (SELECT *, lag(qname) OVER (ORDER BY rec_no) AS before FROM (SELECT * FROM f ORDER BY rec_no LIMIT 1024))
SELECT count(*) AS records, count(*) AS proper, count(*) FILTER (before = qname) AS templates, count(*) AS n_xm, count(*) AS n_xg, true AS paired, true AS sorted, 'XM' AS tagged FROM h""")
def sniff_counts(spark: SparkSession, sf: str) -> DataFrame:
    seen = al.sniff(syn.pairs(spark, sf))
    row = {k: seen[k] for k in ("records", "proper", "templates", "paired", "sorted", "tagged")} | {f"n_{t.lower()}": seen["tags"][t] for t in ("XM", "XG")}
    return spark.createDataFrame([row], "records long, proper long, templates long, n_xm long, n_xg long, paired boolean, sorted boolean, tagged string")


_LONG = f"""{syn.READS_SQL}, e AS (SELECT templid, rname, start, templid % 3 = 0 AS rev, unnest(string_split(seq, '')) AS b, unnest(range(length(seq))) AS i FROM reads),
k AS (SELECT *, lag(b, 2, 'N') OVER w AS b2, lag(b, 1, 'N') OVER w AS b1, lead(b, 1, 'N') OVER w AS a1, lead(b, 2, 'N') OVER w AS a2,
  sum(CASE WHEN b = CASE WHEN rev THEN 'G' ELSE 'C' END THEN 1 ELSE 0 END) OVER (PARTITION BY templid ORDER BY CASE WHEN rev THEN -i ELSE i END) AS k FROM e WINDOW w AS (PARTITION BY templid ORDER BY i)),
x AS (SELECT *, CASE WHEN NOT rev AND b = 'C' THEN CASE WHEN a1 = 'G' THEN 'z' WHEN a2 = 'G' THEN 'x' ELSE 'h' END
  WHEN rev AND b = 'G' THEN CASE WHEN b1 = 'C' THEN 'z' WHEN b2 = 'C' THEN 'x' ELSE 'h' END ELSE '.' END AS c, (k * 37 + templid) % 256 AS p FROM k),
longs AS (SELECT templid, rname, CASE WHEN rev THEN '-' ELSE '+' END AS strand, start, string_agg(CASE WHEN p >= 128 THEN upper(c) ELSE c END, '' ORDER BY i) AS xm FROM x GROUP BY ALL)"""


@_query("long_reads", f"WITH {_LONG} SELECT * FROM longs")
def long_reads(spark: SparkSession, sf: str) -> DataFrame:
    return al.long_reads(syn.long_alignments(spark, sf), min_prob=128).drop("seq")


@_query("snv_rows", f"WITH {syn.RAW_VARIANTS_SQL}, a AS (SELECT name, seqnames, pos, ref, unnest(string_split(alt, ',')) AS alt FROM raw_variants) SELECT * FROM a WHERE length(ref) = 1 AND length(alt) = 1")
def snv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return variants.single_nucleotide(syn.raw_variants(spark, sf))


@_query("chromosome_styles", f"""WITH {syn.VARIANTS_SQL}, c AS (SELECT name, CASE CAST(substr(name, 3) AS BIGINT) % 4 WHEN 0 THEN 'MT' WHEN 1 THEN 'chrM' WHEN 2 THEN 'chr7' ELSE 'X' END AS chr FROM variants)
SELECT name, CASE chr WHEN 'MT' THEN 'chrM' WHEN 'X' THEN 'chrX' ELSE chr END AS ucsc, CASE chr WHEN 'chrM' THEN 'MT' WHEN 'chr7' THEN '7' ELSE chr END AS ncbi FROM c""")
def chromosome_styles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("name", 3, 20).cast("long") % 4
    c = syn.variants(spark, sf).select("name", F.when(k == 0, "MT").when(k == 1, "chrM").when(k == 2, "chr7").otherwise("X").alias("chr"))
    return c.select("name", variants.chromosome_style(F.col("chr"), "UCSC").alias("ucsc"), variants.chromosome_style(F.col("chr"), "NCBI").alias("ncbi"))


_FREQS_RAW = _FREQS.replace(syn.VARIANTS_SQL, f"{syn.RAW_VARIANTS_SQL.replace('variants AS (', 'simple AS (', 1).replace('FROM variants)', 'FROM simple)')}, variants AS (SELECT name, seqnames, pos, ref, alt FROM (SELECT name, seqnames, pos, ref, unnest(string_split(alt, ',')) AS alt FROM raw_variants) WHERE length(ref) = 1 AND length(alt) = 1), sites AS (SELECT DISTINCT name, seqnames, pos FROM variants)").replace("FROM passed r JOIN variants v", "FROM passed r JOIN sites v")


@_query("variant_counts_multiallelic", f'WITH {_FREQS_RAW}, al AS (SELECT name, seqnames, pos AS "range", ref AS "REF", alt AS "ALT", {_ALLELES} FROM freqs) SELECT *, {_SUMS} FROM al')
def variant_counts_multiallelic(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_report(syn.reads(spark, sf), syn.raw_variants(spark, sf), test=False)


_CLIPPED = _CALLED.replace("string_split('NN' || g || 'NN', '') AS l", "string_split('NN' || 'NN' || substr(g, 1, 5) || 'NNN' || 'NNNN' || rpad(substr(g, 15, length(g) - 19), CAST(length(g) - 19 AS INTEGER), 'N') || 'NNNNN' || 'NN', '') AS l").replace(" FROM g)\nSELECT", " FROM g WHERE length(g) >= 30)\nSELECT").replace("'NNNNN' || 'NN'", "'NNNNN' || rpad(substr(g, length(g) - 4, 2), 2, 'N')")


@_query("call_cigar", "WITH " + _CLIPPED)
def call_cigar(spark: SparkSession, sf: str) -> DataFrame:
    genome, a = syn.clipped_reads(spark, sf)
    return calling.call_methylation(a, genome).select(F.col("rec_no").alias("templid"), "xg", "xm")


@_query("call_summary", f"WITH {syn.LETTERS_SQL} SELECT count(*) AS nrecs, count(*) FILTER (templid % 5 <> 0) AS ncalled FROM letters")
def call_summary(spark: SparkSession, sf: str) -> DataFrame:
    genome, a = syn.genome_and_reads(spark, sf)
    a = a.withColumn("xg", F.when(F.col("rec_no") % 5 != 0, F.col("xg")))  # without a strand tag nothing is called
    return calling.call_summary(calling.call_methylation(a, genome))


@_query("strand_tags", f"""WITH {syn.LETTERS_SQL} SELECT templid, CASE templid % 6 WHEN 0 THEN 'CT' WHEN 1 THEN 'GA' WHEN 2 THEN 'GA' WHEN 3 THEN 'CT' WHEN 4 THEN 'GA' END AS xg FROM letters""")
def strand_tags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("templid") % 6
    a = syn.letters(spark, sf).select("templid", F.when(k == 0, "CT").when(k == 1, "GA").alias("xg"), F.when(k == 2, "r").when(k == 3, "f").alias("yd"), F.when(k == 4, "-+").alias("zs"))
    return a.select("templid", calling.strand_tag(a).alias("xg"))


@_query("bed_ecdf_rows", _SQL["bed_ecdf"].replace("FROM matched", "FROM matched WHERE bed_row IN (1, 3, 5)"))
def bed_ecdf_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = regions.region_ecdf(syn.reads(spark, sf), syn.targets(spark, sf), "capture", rows=[1, 3, 5], min_overlap=OVERLAP)
    return _rounded(e, "beta", "cum_frac")


@_query("bin_counts", _SQL["patterns_topk_per_bin"].replace("SELECT *, CAST(row_number() OVER (ORDER BY beta, count, codes DESC) AS INTEGER) AS rank FROM t", "SELECT CAST(i AS INTEGER) AS bin, (SELECT count(*) FROM t WHERE t.bin = i) AS n FROM (SELECT unnest(range(1, 11)) AS i)"))
def bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.bin_counts(patterns.select_patterns(_patterns(spark, sf)))


@_query("beta_density", _pattern_sql() + _UNIQUE + """, ds AS (SELECT count(*) AS k, stddev_samp(beta) AS sd, quantile_cont(beta, 0.75) - quantile_cont(beta, 0.25) AS iqr, min(beta) AS lo, max(beta) AS hi, sum(count) AS total FROM u),
dw AS (SELECT lo, hi, total, 0.9 * CASE WHEN iqr > 0 AND iqr / 1.34 < sd THEN iqr / 1.34 WHEN sd > 0 THEN sd WHEN abs(lo) > 0 THEN abs(lo) ELSE 1.0 END * pow(k, -0.2) AS bw FROM ds WHERE k > 0),
dg AS (SELECT *, lo + i * (hi - lo) / 63 AS x FROM dw, (SELECT unnest(range(64)) AS i))
SELECT round(x, 6) AS x, round((SELECT sum(count / total * exp(-0.5 * pow((x - beta) / bw, 2))) FROM u) / (bw * sqrt(2 * pi())), 6) AS y FROM dg""")
def beta_density(spark: SparkSession, sf: str) -> DataFrame:
    d = patterns.beta_density(_patterns(spark, sf), 64)
    return d.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_SHOWN = [5003, 5007, 5011, 5099, 5103]


@_query("patterns_wide", _pattern_sql() + f", c AS (SELECT templid, {', '.join(f'max(code) FILTER (pos = {x}) AS \"{x}\"' for x in _SHOWN)} FROM l GROUP BY templid) SELECT p.templid, p.codes, c.* EXCLUDE (templid) FROM p JOIN c USING (templid)")
def patterns_wide(spark: SparkSession, sf: str) -> DataFrame:
    reads = syn.reads(spark, sf)
    b = patterns.pattern_bases(reads, *REGION, "CG", clip=True)
    w = patterns.wide(_patterns(spark, sf), b, _SHOWN)
    return w.select("templid", "codes", *[F.col(f"`{x}`") for x in _SHOWN])


def _written(spark: SparkSession, lines: DataFrame, single: bool = False) -> str:
    """The path of ``lines`` as text in the folder that executors share: a file a partition, or one if their order matters."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(top or tempfile.mkdtemp()).rstrip('/')}/round-trip-{uuid.uuid4().hex}"
    (lines.coalesce(1) if single else lines).write.text(path)
    return path


@_query("vcf_round_trip", f"WITH {syn.RAW_VARIANTS_SQL} SELECT CASE WHEN CAST(substr(name, 3) AS BIGINT) % 3 = 0 THEN seqnames || ':' || pos || '_' || ref || '/' || alt ELSE name END AS name, seqnames, pos, ref, alt FROM raw_variants")
def vcf_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.substring("name", 3, 20).cast("long") % 3 == 0, ".").otherwise(F.col("name"))
    v = syn.raw_variants(spark, sf).select(F.concat_ws("\t", "seqnames", F.col("pos").cast("string"), name, "ref", "alt", F.lit("."), F.lit("PASS"), F.lit(".")).alias("value"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "value string")
    return text.read_vcf(spark, _written(spark, head.union(v)))


@_query("vcf_regions", f"WITH {syn.VARIANTS_SQL}, {syn.TARGETS_SQL} SELECT * FROM variants v WHERE EXISTS (SELECT 1 FROM targets t WHERE t.seqnames = v.seqnames AND v.pos BETWEEN t.start AND t.\"end\" AND t.bed_row <= 20)")
def vcf_regions(spark: SparkSession, sf: str) -> DataFrame:
    v = syn.variants(spark, sf).select(F.concat_ws("\t", "seqnames", F.col("pos").cast("string"), "name", "ref", "alt").alias("value"))
    return text.read_vcf(spark, _written(spark, v), syn.targets(spark, sf).where("bed_row <= 20"))


@_query("bed_round_trip", f"WITH {syn.TARGETS_SQL} SELECT CAST(row_number() OVER (ORDER BY bed_row) AS INTEGER) AS bed_row, seqnames, start, \"end\", CAST(\"end\" - start + 1 AS INTEGER) AS width, '*' AS strand, 't' || bed_row AS V4 FROM targets")
def bed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    t = syn.targets(spark, sf).orderBy("bed_row").select(F.concat_ws("\t", "seqnames", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.concat(F.lit("t"), F.col("bed_row").cast("string"))).alias("value"))
    return text.read_bed(spark, _written(spark, t, single=True), zero_based=True)


@_query("fasta_round_trip", f"WITH {syn.LETTERS_SQL} SELECT 'c' || templid AS rname, length(t) AS rlen, translate(t, '{syn.LOWER}-', '{syn.BASES_OF}') AS seq FROM letters WHERE t <> ''")
def fasta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    g, _ = syn.genome_and_reads(spark, sf)
    lines = F.concat(F.lit(">c"), F.col("rname"), F.lit(" of > many\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")).alias("value")
    return text.read_fasta(spark, _written(spark, g.where("seq <> ''").select(lines))).drop("rid")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
