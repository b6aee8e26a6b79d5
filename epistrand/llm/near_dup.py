"""MinHash near-duplicates with HyperMinHash registers.

1. A document's set is its distinct word shingles, as 64-bit hashes. Equal sets form one class.
2. Each class gets 128 registers of 16 bits: the leading-zero count of a bucket's least hash and the
   10 bits after its leading one. Sets of at most 640 shingles take the least of 128 permutations;
   sets of at least 512 take the least of 128 hash ranges, which is cheaper. Both kinds are kept
   between 512 and 640, so that any two sets with similarity 0.8 or more share a kind.
3. Bands of 4 registers give 32 keys a kind; two sets of similarity s share none with probability
   (1 - s^4)^32, 5e-8 at 0.8. Classes that share a key are candidates.
4. Within a key, every class is first compared with eight leaders only; of the leaders of all its keys,
   with the ``MET`` that it shares most keys with. So a class costs ``MET`` pairs at most here, however
   large its groups are, and step 5 settles what this leaves open. Candidates whose register agreement, corrected for chance collisions, is five standard errors below the threshold go (3e-7
   of the pairs at the threshold itself, fewer above it); the rest are confirmed on full sets. Connected components follow.
5. To lose no link, members of a key that are still in different components are compared: pair by
   pair in keys of at most ``FEW`` members, else by an index on their differences from the shingles
   that most of their group hold (``_by_difference``), which is exact and joins only members that
   share rare differences. A group of copies is one component by then and costs nothing.

Nulls: a null text, or one without words, has an empty set and is linked with nothing. A null id is
a document of its own. Equal rows are members of one class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ._common import components, frugal, lookup, stage
from ._words import mix64, word_hashes

REGISTERS, BAND, MANTISSA = 128, 4, 10
#: Largest set with permutation registers, and smallest set with range registers.
MOST_PERMUTED, LEAST_RANGED = 640, 512
#: Leaders of a key, leaders that a class is compared with first, and likeliest partners of a class that are confirmed first.
LEADERS, MET, TRIED = 8, 12, 6
#: Members of a key whose pairs are compared one by one; those of larger keys meet by their differences.
FEW = 16
#: Chance that unequal least hashes of similar-sized sets share a register (Yu and Weber 2020).
COLLISION = 0.1699919487 / (1 << MANTISSA)

_RNG = np.random.default_rng(20240)
_MUL = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)
_ORDERS = [int(x) for x in _RNG.integers(-(1 << 62), 1 << 62, LEADERS)]


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = mix64(h) * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(mix64(h + np.uint64(k)))


def set_id(hashes: np.ndarray) -> int:
    return int((mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(hashes))).astype(np.int64))


def _registers(least: np.ndarray) -> bytes:
    """HyperMinHash registers of 32-bit least hashes."""
    m, e = np.frexp(least.astype(np.float64))
    mantissa = np.maximum((m * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return ((32 - e).astype(np.uint16) << np.uint16(MANTISSA) | mantissa).tobytes()


def permuted(hashes: np.ndarray) -> bytes:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    y = (x ^ hashes.astype(np.uint32) * np.uint32(0x85EBCA6B))[:, None] * _MUL
    y += _ADD
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    return _registers(y.min(axis=0))


def ranged(hashes: np.ndarray) -> bytes:
    """``hashes`` are sorted, so the least of a range is its first; an empty range borrows from the next full one."""
    first = np.searchsorted(hashes, _BOUNDS)
    end = np.append(first[1:], len(hashes))
    value = (hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(7) >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(end > first)
    at = full[np.searchsorted(full, np.arange(REGISTERS)) % len(full)]
    gap = ((at - np.arange(REGISTERS)) % REGISTERS).astype(np.uint32)
    return _registers(np.where(gap == 0, value[at], (value[at] ^ gap * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, sid, a, b): set size, set id and the registers of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, a, b = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text or "", k)
                n.append(len(s))
                sid.append(set_id(s))
                a.append(permuted(s) if 0 < len(s) <= MOST_PERMUTED else None)
                b.append(ranged(s) if len(s) >= LEAST_RANGED else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "n_shingles", "sid", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, sid long, a binary, b binary")


def _band_keys() -> Column:
    width = 2 * BAND
    keys = [F.when(F.col(kind).isNotNull(), F.xxhash64(F.substring(kind, width * i + 1, width), F.lit(i), F.lit(kind))) for kind in ("a", "b") for i in range(REGISTERS // BAND)]
    return F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull()))


@F.pandas_udf(DoubleType())
def agreement(a1: pd.Series, b1: pd.Series, a2: pd.Series, b2: pd.Series) -> pd.Series:
    """Collision-corrected similarity estimate; the larger one if both kinds are there."""
    out = np.zeros(len(a1))
    for x, y in ((a1, a2), (b1, b2)):
        both = np.flatnonzero(x.notna().to_numpy() & y.notna().to_numpy())
        if len(both):
            p = np.frombuffer(b"".join(x.iloc[both]), np.uint16).reshape(len(both), REGISTERS)
            q = np.frombuffer(b"".join(y.iloc[both]), np.uint16).reshape(len(both), REGISTERS)
            same = (p == q).mean(axis=1)
            out[both] = np.maximum(out[both], (same - COLLISION) / (1 - COLLISION))
    return pd.Series(out)


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(x, y, est) of the pairs whose estimate reaches ``least``."""
    left = classes.select(F.col("sid").alias("x"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    right = classes.select(F.col("sid").alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    est = pairs.join(left, "x").join(right, "y").select("x", "y", agreement("a1", "b1", "a2", "b2").alias("est"))
    return stage(est, "estimates").where(F.col("est") >= least)  # staged, since a filter on it would run the function twice


def _sets(docs: DataFrame, sketched: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(sid, items) of the classes in ``needed`` (distinct sid), made anew from one document each, so that sets of all documents are never stored."""
    who = stage(sketched.select("sid", "doc_id").join(needed, "sid").groupBy("sid").agg(F.min("doc_id").alias("_id")).select("sid", "_id"), "who")
    id_rows = docs.select(F.col("doc_id").alias("_doc"), "text")
    texts = lookup(id_rows, who.select("_id").distinct(), F.col("_doc").eqNullSafe(F.col("_id")), "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "", k) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sid", "items"])

    # Rows of one id may differ in text, so the class asked for is looked up again.
    made = texts.select("text").mapInArrow(frugal(run), "sid long, items array<long>")
    return stage(made.join(needed, "sid", "left_semi").dropDuplicates(["sid"]), "sets")


def _confirmed(docs: DataFrame, sketched: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of set ids with den * intersection >= num * union, on full sets read again from the texts."""
    needed = pairs.select(F.col("x").alias("sid")).union(pairs.select(F.col("y").alias("sid"))).distinct()
    sets = _sets(docs, sketched, needed, k)
    both = pairs.join(sets.select(F.col("sid").alias("x"), F.col("items").alias("p")), "x").join(sets.select(F.col("sid").alias("y"), F.col("items").alias("q")), "y")
    common = F.size(F.array_intersect("p", "q"))
    return both.where(F.lit(den) * common >= F.lit(num) * (F.size("p") + F.size("q") - common)).select("x", "y")


def _by_difference(docs: DataFrame, sketched: DataFrame, many: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(x, y): candidate pairs of different components within each group of ``many`` (grp, sid, root), an index exact for the rest.

    The centre M of a group holds the shingles that more than half of its members hold, and D(x) is
    the symmetric difference of x and M. Since |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, two members
    are linked exactly if they share (w(x) + w(y)) / 2 differences, with w(x) = |D(x)| - c |x| and
    c = (den - num) / (den + num). So whoever has w(x) + w(y) <= 0 is linked without a look, and also to
    the member of least w: one pair a member settles all of those. Of the others, one at least is far:
    w(x) > -w_least. Differences are sorted by how few members have them, and a pair that shares t of
    them shares one among the first |D| - t + 1 of both (prefix filter), at places that leave room for
    t. A group of edited copies differs from its centre in edits that few others have, so its members meet seldom.
    """
    sets = _sets(docs, sketched, many.select("sid").distinct(), k)
    of = many.join(sets, "sid")
    size = many.groupBy("grp").agg(F.count("*").alias("g"))
    held = of.select("grp", F.explode("items").alias("el")).groupBy("grp", "el").agg(F.count("*").alias("df"))
    held = stage(lookup(held, size, "grp", "inner"), "held")
    core = held.where(2 * F.col("df") > F.col("g")).groupBy("grp").agg(F.collect_list("el").alias("centre"))
    centred = lookup(of, core, "grp", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    odd = F.explode_outer(F.array_union(F.array_except("items", "centre"), F.array_except("centre", "items")))
    odd = centred.select("grp", "sid", "root", F.size("items").alias("n"), odd.alias("el"))
    rare = held.select("grp", "el", F.when(2 * F.col("df") > F.col("g"), F.col("g") - F.col("df")).otherwise(F.col("df")).alias("f"))
    c = (den - num) / (den + num)
    sorted_d = odd.join(rare, ["grp", "el"], "left").groupBy("grp", "sid", "root", "n").agg(F.sort_array(F.collect_list(F.when(F.col("el").isNotNull(), F.struct("f", "el")))).alias("d"))
    members = stage(sorted_d.withColumn("w", F.size("d") - c * F.col("n")), "differences")
    least = stage(members.groupBy("grp").agg(F.min(F.struct("w", "sid")).alias("m")).select("grp", F.col("m.w").alias("w_least"), F.col("m.sid").alias("hub")), "hubs")
    members = lookup(members, least, "grp", "inner")
    near = F.col("w") + F.col("w_least") <= 1e-9
    linked = members.where(near & (F.col("sid") != F.col("hub"))).select(F.col("sid").alias("a"), F.col("hub").alias("b"))
    # All components with a near member are one.
    mains = stage(members.where(near | (F.col("sid") == F.col("hub"))).select("grp", "root").distinct().withColumn("main", F.lit(True)), "mains")
    members = lookup(members, mains, ["grp", "root"]).withColumn("main", F.coalesce("main", F.lit(False)))

    def index(rows: DataFrame, other_w: Column) -> DataFrame:
        """Places in the prefix against partners of ``other_w`` or more, of differences that another member has too."""
        t = F.greatest(F.lit(1), F.ceil((F.col("w") + other_w) / 2 - 1e-9))
        first = F.slice("d", 1, F.greatest(F.lit(0), F.size("d") - t + 1).cast("int"))
        return rows.select("grp", "sid", "root", "main", "w", F.size("d").alias("nd"), F.posexplode(first).alias("at", "e")).where("e.f > 1").select("grp", F.col("e.el").alias("el"), "sid", "root", "main", "w", (F.col("nd") - F.col("at")).alias("room"))

    # Partners of a far member x have w above -w(x), and x has w above -w_least.
    far = members.where(~F.col("main"))
    probe = index(far, F.col("w_least")).select("grp", "el", F.col("sid").alias("x"), F.col("root").alias("rx"), F.col("w").alias("wx"), F.col("room").alias("room_x"))
    build = index(members, -F.col("w_least")).select("grp", "el", F.col("sid").alias("y"), F.col("root").alias("ry"), "main", F.col("w").alias("wy"), F.col("room").alias("room_y"))
    t = (F.col("wx") + F.col("wy")) / 2 - 1e-9
    met = probe.join(build, ["grp", "el"]).where((F.col("rx") != F.col("ry")) & (F.col("main") | (F.col("x") < F.col("y"))) & (F.least("room_x", "room_y") >= t))
    pairs = linked.union(met.select("x", "y"))
    return pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at similarity num/den or more, ``k``-word shingles.

    ``num / den`` is 0.8 or more: below that, two linked sets might have no kind of registers in common.
    """
    if num * 10 < den * 8:
        raise ValueError("similarity must be 0.8 or more")
    sketched = stage(sketches(docs, k), "sketches")
    classes = stage(sketched.where("n_shingles > 0").groupBy("sid").agg(F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    least = num / den - 5 * (num / den * (1 - num / den) / REGISTERS) ** 0.5

    keys = classes.select("sid", _band_keys().alias("key"))
    # A leader is the least class of the key in one of several orders, found with map-side combine.
    led = keys.groupBy("key").agg(F.count("*").alias("n"), *[F.min(F.col("sid").bitwiseXOR(F.lit(o))).alias(f"l{i}") for i, o in enumerate(_ORDERS)]).where("n > 1")
    led = stage(led.select("key", F.array_distinct(F.array(*[F.col(f"l{i}").bitwiseXOR(F.lit(o)) for i, o in enumerate(_ORDERS)])).alias("leaders")), "keys")
    members = stage(keys.join(led, "key").select("key", "sid", "leaders"), "members")
    # Dealt by class once, before leaders are rows, for the counts and their ranks; a class has few keys.
    first = members.select("sid", "leaders").repartition("sid").select("sid", F.explode("leaders").alias("leader")).where("sid != leader").groupBy("sid", "leader").agg(F.count("*").alias("shared"))
    likely = Window.partitionBy("sid").orderBy(F.col("shared").desc(), "leader")
    first = first.withColumn("r", F.row_number().over(likely)).where(f"r <= {MET}")
    first = first.select(F.least("sid", "leader").alias("x"), F.greatest("sid", "leader").alias("y")).distinct()
    first = stage(_estimated(first, classes, least), "pairs")
    # The likeliest partners of either side suffice to form the components.
    best = Window.partitionBy("x").orderBy(F.col("est").desc(), "y")
    other = Window.partitionBy("y").orderBy(F.col("est").desc(), "x")
    tried = stage(first.withColumn("r", F.row_number().over(best)).withColumn("s", F.row_number().over(other)).where(f"r <= {TRIED} or s <= {TRIED}").select("x", "y"), "pairs")
    links = stage(_confirmed(docs, sketched, tried, k, num, den), "links")

    roots = components(links, "x", "y")
    placed = members.select("key", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    placed = stage(placed, "placed")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("c"), F.sum("n").alias("n")).where("c > 1").select("key", F.col("m.root").alias("largest"), "n")
    open_keys = stage(placed.join(largest, "key"), "open")
    few = open_keys.where(F.col("n") <= FEW)
    x, y = few.select("key", F.col("sid").alias("x"), F.col("root").alias("rx")), few.select("key", F.col("sid").alias("y"), F.col("root").alias("ry"))
    rest = x.join(y, "key").where((F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry"))).select("x", "y")
    many = open_keys.where(F.col("n") > FEW).select(F.col("largest").alias("grp"), "sid", "root").distinct()
    rest = stage(rest.union(_by_difference(docs, sketched, stage(many, "groups"), k, num, den)).distinct(), "rest")
    rest = stage(_estimated(rest, classes, least).select("x", "y").join(tried, ["x", "y"], "left_anti"), "pairs")
    more = stage(_confirmed(docs, sketched, rest, k, num, den), "links")

    new = components(links.union(more), "x", "y")
    ids = sketched.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    ids = ids.join(new.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "id", "copies", "root")
    ids = stage(ids.where("root is not null or copies > 1"), "ids")
    named = ids.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("id").alias("least"))
    ids = stage(ids.join(named, F.col("root") == F.col("r"), "left").select("sid", F.coalesce("least", "id").alias("component")), "components")
    out = lookup(sketched.select("doc_id", "n_shingles", "sid"), ids, "sid").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
