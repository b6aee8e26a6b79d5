"""BAM as a Python data source (``format("epibam")``), a BGZF writer, and simulated alignments."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "rec_no long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, xm string, xg string, yd string, zs string, mm string, ml array<int>"
# Codes of the BAM format.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _stream(path: str) -> Iterator[bytes]:
    """Inflated BGZF (or gzip) members in order."""
    with open(path, "rb") as f:
        d, open_member = zlib.decompressobj(31), False
        while chunk := f.read(1 << 20):
            while chunk:
                yield d.decompress(chunk)
                chunk = d.unused_data
                if d.eof:
                    d = zlib.decompressobj(31)
                    open_member = False
                else:
                    open_member = True
    if open_member:
        raise ValueError(f"{path}: the last block is cut short")


class _Bytes:
    """Takes bytes off a stream of parts; each byte is copied once."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buffer, self.at = parts, b"", 0

    def take(self, n: int, may_end: bool = False) -> bytes:
        """The next ``n`` bytes; nothing at the end of the stream if it may end here."""
        if len(self.buffer) - self.at < n:
            got = [self.buffer[self.at :]]
            have = len(got[0])
            while have < n and (more := next(self.parts, None)) is not None:
                got.append(more)
                have += len(more)
            self.buffer, self.at = b"".join(got), 0
            if have < n:
                if have or not may_end:
                    raise ValueError("the file is cut short")
                return b""
        out = self.buffer[self.at : self.at + n]
        self.at += n
        return out


def _tags(data: bytes) -> dict:
    out, at = {}, 0
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[tag], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            out[tag] = list(struct.unpack_from(f"<{n}{_CODES[sub]}", data, at + 5))
            at += 5 + n * _SIZES[sub]
        else:
            out[tag] = chr(data[at]) if kind == "A" else struct.unpack_from("<" + _CODES[kind], data, at)[0]
            at += _SIZES[kind]
    return out


def read_records(path: str) -> Iterator[tuple]:
    s = _Bytes(_stream(path))
    if s.take(4) != b"BAM\1":
        raise ValueError(f"{path}: not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        n = struct.unpack("<i", s.take(4))[0]
        names.append(s.take(n)[:-1].decode())
        s.take(4)
    no = 0
    while size := s.take(4, may_end=True):
        b = s.take(struct.unpack("<i", size)[0])
        rid, pos, l_name, mapq, _, n_ops, flag, l_seq, nrid, npos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
        at = 32
        qname, at = b[at : at + l_name - 1].decode(), at + l_name
        cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", b, at)) or "*"
        at += 4 * n_ops
        packed = b[at : at + (l_seq + 1) // 2]
        seq = "".join(_BASES[x >> 4] + _BASES[x & 15] for x in packed)[:l_seq]
        at += (l_seq + 1) // 2
        qual = "".join(chr(min(q, 93) + 33) for q in b[at : at + l_seq])
        t = _tags(b[at + l_seq :])
        ref = lambda i: names[i] if i >= 0 else "*"
        yield (no, qname, flag, ref(rid), pos + 1, mapq, cigar, ref(nrid), npos + 1, tlen, seq, qual, t.get("XM"), t.get("XG"), t.get("YD"), t.get("ZS"), t.get("MM", t.get("Mm")), t.get("ML", t.get("Ml")))
        no += 1


class BamSource(DataSource):
    """``spark.read.format("epibam").load(path)``: one partition a file; a record's fields need all bytes before it.
    The path is a comma-separated list of files that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "epibam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BamReader([p for p in self.options["path"].split(",") if p])


class _BamReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = [p.removeprefix("file://") for p in paths]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_records(partition.value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def array_code(values: list) -> str:
    """Smallest BAM array type that holds the numbers; ``f`` for fractions."""
    if not values or any(isinstance(v, (str, bytes, bool)) or v is None for v in values):
        raise ValueError("array tags hold numbers only")
    if any(isinstance(v, float) for v in values):
        return "f"
    lo, hi = min(values), max(values)
    for code, a, b in (("c", -128, 127), ("C", 0, 255), ("s", -32768, 32767), ("S", 0, 65535), ("i", -(2**31), 2**31 - 1), ("I", 0, 2**32 - 1)):
        if a <= lo and hi <= b:
            return code
    raise ValueError("integers of an array tag exceed 32 bits")


def _bgzf(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _record(row: dict, ids: dict[str, int]) -> bytes:
    import re

    ops = [(int(n) << 4) | _OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq, qual = row["seq"] or "", row["qual"] or ""
    packed = bytes((_BASES.index(a) << 4) | _BASES.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
    tags = b""
    for tag, v in row["tags"].items():
        if v is None:
            continue
        if isinstance(v, str):
            tags += tag.encode() + b"Z" + v.encode() + b"\0"
        elif isinstance(v, list):
            code = array_code(v)
            tags += tag.encode() + b"B" + code.encode() + struct.pack(f"<I{len(v)}{_CODES[code]}", len(v), *v)
        else:
            tags += tag.encode() + (b"f" + struct.pack("<f", v) if isinstance(v, float) else b"i" + struct.pack("<i", v))
    name = row["qname"].encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ids.get(row["rname"], -1), row["pos"] - 1, len(name), row["mapq"], 0, len(ops), row["flag"], len(seq), ids.get(row["rnext"], -1), row["pnext"] - 1, row["tlen"])
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(c) - 33 for c in qual) + tags
    return struct.pack("<i", len(body)) + body


def write_bam(rows: Iterator[dict], path: str, targets: list[tuple[str, int]]) -> int:
    """Write records (dicts with ``tags``) on the driver, as the simulator does; returns how many."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in targets).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(targets))
    for n, k in targets:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    ids, count = {n: i for i, (n, _) in enumerate(targets)}, 0
    with open(path, "wb") as f:
        for row in rows:
            out += _record(row, ids)
            count += 1
            while len(out) >= 60_000:
                f.write(_bgzf(out[:60_000]))
                out = out[60_000:]
        if out:
            f.write(_bgzf(out))
        f.write(_EOF)
    return count


_DEFAULTS = {"flag": 0, "rname": "chrS", "pos": 1, "mapq": 60, "rnext": "chrS", "pnext": 1}
_KINDS = {"qname": "string", "flag": "int", "rname": "string", "pos": "int", "mapq": "int", "cigar": "string", "rnext": "string", "pnext": "int", "tlen": "int", "seq": "string", "qual": "string"}


def simulate(spark: SparkSession, seed: int = 1, **params) -> DataFrame:
    """As many alignments as the longest parameter has values; shorter ones are recycled.

    Fields default to q0001.., flag 0, chrS, position 1, quality 60, ``<length>M``, random bases and ``F``.
    Other names are tags (xm, xg, mm, ml, ...).
    """
    lists = {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in params.items() if v is not None}
    lists = {k: [v] if k == "ml" and v and not isinstance(v[0], (list, tuple)) else v for k, v in lists.items()}
    n = max((len(v) for v in lists.values()), default=1)
    df = spark.range(n).withColumnRenamed("id", "rec_no")
    pick = lambda v: F.element_at(F.array(*[F.array(*[F.lit(y) for y in x]) if isinstance(x, (list, tuple)) else F.lit(x) for x in v]), (F.col("rec_no") % len(v) + 1).cast("int"))
    for k, v in lists.items():
        if any(isinstance(x, (list, tuple)) for x in v):
            array_code([y for x in v for y in x])
        df = df.withColumn(k, pick(v).cast(_KINDS[k]) if k in _KINDS else pick(v))
    if "qname" not in lists:
        df = df.withColumn("qname", F.format_string("q%04d", F.col("rec_no") + 1))
    for k, v in _DEFAULTS.items():
        if k not in lists:
            df = df.withColumn(k, F.lit(v).cast(_KINDS[k]))
    if "seq" not in lists:
        size = F.length("xm") if "xm" in lists else F.when(F.col("tlen") > 0, F.col("tlen")).otherwise(10) if "tlen" in lists else F.lit(10)
        df = df.withColumn("seq", F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.col("rec_no"), i, F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1))), ""))
    if "cigar" not in lists:
        df = df.withColumn("cigar", F.concat(F.length("seq").cast("string"), F.lit("M")))
    if "tlen" not in lists:
        df = df.withColumn("tlen", F.length("seq"))
    if "qual" not in lists:
        df = df.withColumn("qual", F.repeat(F.lit("F"), F.length("seq")))
    return df
