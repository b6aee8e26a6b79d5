"""Substring dedup: fuzzy passages shared by documents, by collinear chaining of k-mer seeds.

1. A document's seeds are the least hashes of its 5-word shingles in every window of 16 (minimisers),
   so any two copies of 20 words or more share one.
2. Each seed is joined to its first occurrence in the corpus (smallest document, then position),
   found with map-side combine; occurrences are never paired with each other, so a passage that
   many documents share costs one row an occurrence.
3. Matches between two documents are chained: the best chain ends with the heaviest sum of seeds less
   gap costs, and predecessors come from a Fenwick tree over positions in the earlier document.
4. The stretches that chains span, with some context, are fetched from both texts and aligned: all
   shared shingles are chained again, and maximal-scoring segments of aligned shingles with at least
   ``least`` words and a shingle similarity of ``similarity`` or more are the passages.

5. What is left open is looked for again, with keys that few documents hold. Seeds that some earlier
   document has too, but that no passage covers yet, are paired with those 15 to 45 words on; such a
   pair is joined to its first holder. Wherever a pair has an earlier holder, all 50-word windows
   around it are hashed in all its holders, and each is joined to its own first holder; so every
   verbatim repeat of ``least`` words is found, whichever documents hold its parts. No step pairs the
   holders of one key with each other.

A verbatim repeat may miss fewer than 20 words at its ends, where all seeds are covered already. A
fuzzy passage (with edits) is found if two of its seeds are first held together by a document that
shares the passage; this can fail only where other documents hold all such pairs of it.

``remove`` cuts every passage from the later document; its first occurrence stays.

Nulls: a null text has no passage. A document is a distinct pair of id and text: rows that repeat
both are one document, not compared with itself; rows without an id, with an id that is no integer,
or whose id stands over several texts come before all others, in the order of a hash. A repeat
inside one document is no passage. Ties (equal texts) go to the smaller id. Texts of any length are
read whole; extra columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType
from pyspark.sql.window import Window

from ._common import frugal, lookup, stage
from ._words import hashed, mix64, word_hashes
from .toxicity import segments

K, WINDOW = 5, 16
#: Weight of a seed, and cost of each word of gap on either side.
SEED, GAP = 8.0, 0.05
#: Words around a chain that are aligned too.
CONTEXT = 60
#: Stretches whose slices of one document are cut together.
SLICES = 256
#: A seed with more rows than this, and than one of ``SHARES`` equal parts of all rows, is split; so at most ``SHARES`` seeds are.
LEAST_SHARE, SHARES = 5_000, 100_000


def shingles(w: np.ndarray, k: int = K) -> np.ndarray:
    if len(w) < k:
        return np.zeros(0, np.uint64)
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = mix64(h) * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return mix64(h)


def window_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words, put together from windows of 1, 2, 4 ... words; not those of ``shingles``."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    part, span, out, done = w, 1, None, 0

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mix64(mix64(x[: len(y)]) * np.uint64(0x9E3779B97F4A7C15) + y)

    while True:
        if n & span:
            out = part[done:] if out is None else joined(out, part[done:])
            done += span
        if done == n:
            return mix64(out)
        part = joined(part, part[span:])
        span *= 2


def minimisers(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of every window, each once."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= window:
        return np.array([int(h.argmin())])
    # The least of each window, then of those the greatest over a position's windows: it is the position's own hash where that is least in one.
    low, top = _slid(h, window, np.minimum), np.zeros(len(h) + window - 1, h.dtype)
    top[window - 1 : len(h)] = low
    at = np.flatnonzero(h == _slid(top, window, np.maximum))
    tied = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (np.diff(at) < window)) + 1
    if not len(tied):
        return at
    keep = np.ones(len(at), bool)  # of equal hashes in one window the first counts, so a later one needs a window that starts behind it
    for x in np.split(tied, range(65536, len(tied), 65536)):
        starts = at[x - 1, None] + np.arange(1, window)
        inside = (starts <= at[x, None]) & (starts < len(low))
        keep[x] = (inside & (low[np.minimum(starts, len(low) - 1)] == h[at[x], None])).any(axis=1)
    return at[keep]


def _slid(h: np.ndarray, window: int, of: np.ufunc) -> np.ndarray:
    """``of`` over every window, by doubling."""
    span = 1
    while span < window:
        step = min(span, window - span)
        h, span = of(h[:-step], h[step:]), span + step
    return h


def chains(p: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
    """Index arrays of disjoint chains of matches (p, a), sorted by p; both positions rise along a chain."""
    if len(p) == 0:
        return []
    dp, da = np.diff(p), np.diff(a)
    if (dp > 0).all() and (da > 0).all():  # already one line: cut it where a gap costs more than a seed
        cut = np.flatnonzero(GAP * (dp + da) >= SEED) + 1
        return np.split(np.arange(len(p)), cut)
    order = np.lexsort((-a, p))  # of equal p, none may follow another
    places = np.unique(a).tolist()
    best: list[tuple[float, int]] = [(-1.0, -1)] * (len(places) + 1)
    score, back = np.zeros(len(p)), np.full(len(p), -1)
    for i in order.tolist():
        line = GAP * float(p[i] + a[i])
        r = bisect_left(places, a[i])  # predecessors have smaller a
        top, j = -1.0, -1
        x = r
        while x > 0:
            if best[x][0] > top:
                top, j = best[x]
            x -= x & -x
        gain = top - line
        score[i] = SEED + max(0.0, gain)
        back[i] = j if gain > 0 else -1
        value = (score[i] + line, i)
        x = r + 1
        while x <= len(places):
            if value[0] > best[x][0]:
                best[x] = value
            x += x & -x
    used = np.zeros(len(p), bool)
    out = []
    for i in np.lexsort((p, -score)).tolist():
        if used[i]:
            continue
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(back[i])
        out.append(np.array(chain[::-1]))
    return out


def align(d: np.ndarray, a: np.ndarray, diagonal: int, least: int, similarity: float, parts: tuple = ()) -> list[tuple[int, int, int, int, float]]:
    """(first, last, other first, other last, similarity) of the passages shared by two word-hash arrays; ends are inclusive.

    ``diagonal`` is where the chain stands: position in ``a`` less position in ``d``. A shingle that
    repeats in ``a`` is matched to its occurrence nearest to that. ``parts`` are the chains (first, last, other first,
    other last) that were merged into the stretch: where it falls short, each is aligned alone, on its own diagonal.
    """
    if min(len(d), len(a)) < K:
        return []
    both = shingles(np.concatenate([d, a]))
    hd, ha = both[: len(d) - K + 1], both[len(d) :]
    order = np.argsort(ha, kind="stable")
    low, high = np.searchsorted(ha[order], hd, "left"), np.searchsorted(ha[order], hd, "right")
    at = np.flatnonzero(high > low)
    if len(at) < similarity * (least - K + 1):  # too few for any passage
        return []
    near = order[low[at]]
    for x in np.flatnonzero(high[at] - low[at] > 1).tolist():
        i = int(at[x])
        places = order[low[i] : high[i]]
        near[x] = places[np.abs(places - (i + diagonal)).argmin()]
    lines = chains(at, near)
    mate = np.full(len(hd), -1, np.int64)
    for c in lines:
        fresh = c[mate[at[c]] < 0]
        mate[at[fresh]] = near[fresh]
    out, short = _scored(mate, least, similarity)
    for d0, d1, a0, a1 in parts:
        if any(d0 < e + K and d1 >= s for s, e in short):
            x, y = max(0, d0 - CONTEXT), max(0, a0 - CONTEXT)
            own = align(d[x : d1 + 1 + CONTEXT], a[y : a1 + 1 + CONTEXT], (a0 - y) - (d0 - x), least, similarity)
            out += [(x + s, x + e, y + t, y + u, v) for s, e, t, u, v in own]
    for s, e in short:  # the whole falls short; one of its chains or an exact run may not
        for c in lines:
            c = c[(at[c] >= s) & (at[c] < e)]
            if len(c) >= similarity * (least - K + 1):
                own = np.full(len(hd), -1, np.int64)
                own[at[c]] = near[c]
                out += _scored(own, least, similarity)[0]
        hit = mate[s:e] >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (hit & np.concatenate([[True], np.diff(mate[s:e]) == 1])).astype(int), [0]])))
        for x, y in zip(edge[::2], edge[1::2], strict=True):
            x = max(0, x - 1) if x > 0 and hit[x - 1] else x
            if y - x + K - 1 >= least:
                out.append((s + x, s + y + K - 2, int(mate[s + x]), int(mate[s + y - 1]) + K - 1, 1.0))
    return out


def _scored(mate: np.ndarray, least: int, similarity: float) -> tuple[list[tuple[int, int, int, int, float]], list[tuple[int, int]]]:
    """The passages among the maximal-scoring segments of shingles with a mate, and the (start, end) of long segments that fall short."""
    hit = mate >= 0
    out, short = [], []
    for s, e, _ in segments(np.where(hit, 1.0, -similarity / (1 - similarity) - 1e-9)):
        n, m = e - s, int(hit[s:e].sum())
        if n + K - 1 < least:
            continue
        mates = mate[s:e][hit[s:e]]
        other = int(mates.max() - mates.min()) + 1
        share = m / max(1, n + max(other, m) - m)
        if share >= similarity:
            out.append((s, e + K - 2, int(mates.min()), int(mates.max()) + K - 1, share))
        else:
            short.append((s, e))
    return out, short


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__doc``, the key of a document: its id, or a hash below zero where that is none (see above)."""
    own = F.xxhash64(F.col("doc_id").cast("string"), "text").bitwiseOR(F.lit(-(1 << 63)))
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return docs.withColumn("__doc", own)
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    odd = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__odd")).agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a != b").select("__odd")
    odd = stage(odd, "odd")
    key = F.col("doc_id").cast("long")
    if not odd.limit(1).count():
        return docs.withColumn("__doc", F.coalesce(key, own))
    return lookup(docs, odd, docs["doc_id"] == odd["__odd"]).withColumn("__doc", F.when(F.col("__odd").isNull(), F.coalesce(key, own)).otherwise(own)).drop("__odd")


def seeds(docs: DataFrame, least: int) -> DataFrame:
    """(doc, pos, seed) of every document with at least ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, got = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = word_hashes(text or "")
                if len(w) >= least:
                    h = shingles(w)
                    at = minimisers(h)
                    ids.append(np.full(len(at), i, np.int64))
                    pos.append(at.astype(np.int32))
                    got.append(h[at].view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, pos, got)], ["doc", "pos", "seed"])

    return docs.select(F.col("__doc").alias("doc"), "text").mapInArrow(frugal(run), "doc long, pos int, seed long")


def find(docs: DataFrame, least: int = 50, similarity: float = 0.8) -> DataFrame:
    """(doc_id, other_id, first_word, last_word, other_first, other_last, similarity, doc, other): passages of ``least`` or
    more words that a document shares with an earlier one, as word positions from 0, ends inclusive; ``doc`` and
    ``other`` are the keys that ``remove`` goes by."""
    keyed = _keyed(docs.select("doc_id", "text"))
    s = stage(seeds(keyed, least), "seeds")
    # Repeated rows of one document give the same seeds, which count once below: all joins are by (doc, pos).
    first = s.groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("a"), F.max("doc").alias("m"), F.count("*").alias("n")).where(F.col("a.doc") < F.col("m"))
    first = stage(first.select("seed", F.col("a.doc").alias("other"), F.col("a.pos").alias("at"), "n"), "first")
    # A seed may hold a third of all rows: rows of frequent seeds are dealt over as many salts as they fill shares.
    share = max(LEAST_SHARE, s.count() // SHARES)
    hot = first.where(F.col("n") > share).select("seed", F.ceil(F.col("n") / share).cast("int").alias("salts"))
    salted = lookup(s, hot, "seed").select("seed", "doc", "pos", F.coalesce(F.pmod(F.xxhash64("doc", "pos"), "salts"), F.lit(0)).cast("int").alias("salt"))
    salts = F.when(F.col("n") > share, F.ceil(F.col("n") / share)).otherwise(1).cast("int")
    dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("seed", "salt", "other", "at")
    matches = salted.join(dealt, ["seed", "salt"]).where(F.col("doc") > F.col("other")).select("doc", "other", "pos", "at", "seed")
    matches = stage(matches, "matches")
    found = stage(_passages(keyed, matches.select("doc", "other", "pos", "at"), least, similarity, ["pos", "at"]), "passages")
    exact, fuzzy = _open_matches(keyed, first, matches, found, least)
    more = _passages(keyed, fuzzy, least, similarity, ["d0", "d1", "a0", "a1"])
    all_found = found.union(exact).union(more).dropDuplicates(["doc", "other", "first_word", "last_word"])
    ids = stage(keyed.where("__doc < 0").select(F.col("__doc").alias("key"), F.col("doc_id").alias("id")).dropDuplicates(["key"]), "ids")
    for name in ("doc", "other"):
        of = ids.select(F.col("key").alias(name), F.col("id").alias(f"{name}_own"))
        all_found = lookup(all_found, of, name)
    kind = docs.schema["doc_id"].dataType

    def named(name: str) -> Column:
        return F.when(F.col(name) < 0, F.col(f"{name}_own")).otherwise(F.col(name).cast(kind)).alias(f"{name}_id")

    return all_found.select(named("doc"), named("other"), "first_word", "last_word", "other_first", "other_last", "similarity", "doc", "other")


def _open_matches(keyed: DataFrame, first: DataFrame, matches: DataFrame, found: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Verbatim passages, and (doc, other, d0, d1, a0, a1), stretches to align, around seeds that an earlier document holds and no
    passage of ``found`` covers."""
    reach = least - K
    # Seeds that several documents hold: the later holders, which ask, and the first, which only offer.
    held = matches.select("doc", F.col("pos").alias("at"), "seed", F.lit(True).alias("asks"))
    held = held.union(first.select(F.col("other").alias("doc"), "at", "seed", F.lit(False))).distinct()
    spans = found.select("doc", F.col("first_word").cast("int").alias("at"), F.col("last_word").cast("int").alias("end")).distinct()
    ends = spans.select("doc", F.explode(F.array(F.col("at"), F.col("end") + 1)).alias("at")).distinct()
    none = [F.lit(None).cast("long").alias("seed"), F.lit(None).cast("boolean").alias("asks")]
    rows = held.select("doc", "at", "seed", "asks", F.lit(None).cast("int").alias("end"), F.lit(False).alias("edge"))
    rows = rows.union(spans.select("doc", "at", *none, "end", F.lit(False))).union(ends.select("doc", "at", *none, F.lit(None).cast("int"), F.lit(True)))
    by_pos = Window.partitionBy("doc").orderBy("at")
    covered = F.coalesce(F.max("end").over(by_pos.rangeBetween(Window.unboundedPreceding, 0)), F.lit(-1)) >= F.col("at") + K - 1
    around = by_pos.rangeBetween(-reach, reach)
    rows = rows.withColumn("bare", F.col("seed").isNotNull() & ~covered)
    rows = rows.withColumn("near", F.max("bare").over(around)).withColumn("loose", F.col("near") | F.max("edge").over(around)).where("seed is not null and loose")
    # A passage that is covered in its earliest holder lies in one found passage, or an edge of one lies in it.
    loose = stage(rows.groupBy("doc", F.col("at").alias("pos"), "seed").agg(F.max(F.col("asks") & F.col("near")).alias("wanted"), F.max("bare").alias("bare")), "loose")
    wanted = loose.where("wanted").select("doc", "pos", "seed", "bare")

    def pairs(rows: DataFrame) -> DataFrame:
        """Seeds with each seed of the same document that starts ``reach - 30`` to ``reach`` words on."""
        on = F.collect_list(F.struct("pos", "seed", "bare")).over(Window.partitionBy("doc").orderBy("pos").rangeBetween(reach - 30, reach))
        return rows.withColumn("on", on).select("doc", F.col("pos").alias("p"), "seed", "bare", F.explode("on").alias("x")).select("doc", "p", F.col("x.pos").alias("q"), F.xxhash64("seed", "x.seed").alias("key"), (F.col("bare") | F.col("x.bare")).alias("bare"))

    asked = stage(pairs(wanted).where("bare").drop("bare"), "asked")
    keys = asked.groupBy("key").agg(F.max("doc").alias("last"))
    offered = stage(lookup(pairs(loose.drop("wanted")), keys, "key", "inner").where(F.col("doc") <= F.col("last")).select("doc", "p", "q", "key"), "offered")
    first = offered.groupBy("key").agg(F.min(F.struct("doc", "p", "q")).alias("a"), F.max("doc").alias("m")).where(F.col("a.doc") < F.col("m"))
    first = stage(first.select("key", F.col("a.doc").alias("other"), F.col("a.p").alias("a0"), F.col("a.q").alias("a1")), "firsts")
    joined = stage(lookup(asked, first, "key", "inner").where(F.col("doc") > F.col("other")), "joined")
    # Windows of ``least`` words that hold both seeds of a pair.
    live = joined.select("key").distinct()
    places = lookup(offered, live, "key", "left_semi").select("doc", "p", "q", F.lit(False).alias("open"))
    places = places.union(joined.select("doc", "p", "q", F.lit(True)))
    places = places.select("doc", F.greatest(F.lit(0), F.col("q") + K - least).cast("int").alias("lo"), F.col("p").alias("hi"), "open")
    places = stage(places.groupBy(F.col("doc").alias("_id")).agg(F.collect_set(F.struct("lo", "hi", "open")).alias("places")), "places")
    texts = lookup(keyed.select(F.col("__doc").alias("doc"), "text"), places, F.col("doc") == F.col("_id"), "inner").select("doc", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, (i, text) in enumerate(zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True)):
                h, at = window_hashes(word_hashes(text), least), b.column("places")[r].values
                lo, hi, asks = (at.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "open"))
                inside = np.zeros((2, len(h) + 1), np.int64)
                for row, x in ((0, np.ones(len(lo), bool)), (1, asks)):
                    np.add.at(inside[row], np.minimum(lo[x], len(h)), 1)
                    np.add.at(inside[row], np.minimum(hi[x] + 1, len(h)), -1)
                inside = inside.cumsum(axis=1)[:, :-1] > 0
                p = np.flatnonzero(inside[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i, np.int64)), pa.array(p.astype(np.int32)), pa.array(h[p].view(np.int64)), pa.array(inside[1][p])], ["doc", "p", "key", "open"])

    windows = stage(texts.mapInArrow(frugal(run), "doc long, p int, key long, open boolean"), "windows")
    first = windows.groupBy("key").agg(F.min(F.struct("doc", "p")).alias("a"), F.max(F.when(F.col("open"), F.col("doc"))).alias("m")).where(F.col("a.doc") < F.col("m"))
    first = first.select("key", F.col("a.doc").alias("other"), F.col("a.p").alias("a0"))
    exact = windows.where("open").join(first, "key").where(F.col("doc") > F.col("other"))
    # Windows that follow each other in both documents are one passage.
    line = Window.partitionBy("doc", "other", "shift").orderBy("p")
    exact = exact.withColumn("shift", F.col("a0") - F.col("p")).withColumn("new", (F.col("p") - F.lag("p", 1, -2).over(line) > 1).cast("int"))
    exact = exact.withColumn("run", F.sum("new").over(line)).groupBy("doc", "other", "shift", "run").agg(F.min("p").cast("long").alias("first_word"), (F.max("p") + least - 1).cast("long").alias("last_word"))
    exact = exact.select("doc", "other", "first_word", "last_word", (F.col("first_word") + F.col("shift")).alias("other_first"), (F.col("last_word") + F.col("shift")).alias("other_last"), F.lit(1.0).alias("similarity"))
    exact = stage(exact, "exact")
    # Pairs inside those need no look; what else they hold may be fuzzy.
    ends = exact.select("doc", F.col("first_word").cast("int").alias("d0"), F.col("last_word").alias("end"))
    rows = joined.select("doc", "other", F.col("p").alias("d0"), F.col("q").alias("d1"), "a0", "a1", F.lit(None).cast("long").alias("end"))
    rows = rows.union(ends.select("doc", F.lit(None).cast("long"), "d0", *[F.lit(None).cast("int") for _ in range(3)], "end"))
    upto = F.max("end").over(Window.partitionBy("doc").orderBy("d0").rangeBetween(Window.unboundedPreceding, 0))
    fuzzy = rows.withColumn("upto", upto).where("other is not null and coalesce(upto, -1) < d1 + " + str(K - 1)).select("doc", "other", "d0", "d1", "a0", "a1")
    # Verbatim passages may go on with edits, so their ends are aligned as well.
    whole = exact.select("doc", "other", F.col("first_word").cast("int").alias("d0"), (F.col("last_word") + 1 - K).cast("int").alias("d1"), F.col("other_first").cast("int").alias("a0"), (F.col("other_last") + 1 - K).cast("int").alias("a1"))
    return exact, fuzzy.union(whole)


def _passages(keyed: DataFrame, matches: DataFrame, least: int, similarity: float, ends_of: list[str]) -> DataFrame:
    """The passages around ``matches`` (doc, other, ``ends_of``) of seeds: positions to chain (pos, at), or stretches as they are (d0, d1, a0, a1)."""
    matches = matches.repartition("doc", "other").sortWithinPartitions("doc", "other", *ends_of)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def finish(rows: np.ndarray, out: list) -> None:
            if len(ends_of) == 4:
                ends = sorted(set(map(tuple, rows[:, 2:].tolist())))
            elif len(rows) < 2:  # looked at again by pairs of seeds
                return
            else:
                ends = sorted((int(rows[c[0], 2]), int(rows[c[-1], 2]), int(rows[c[0], 3]), int(rows[c[-1], 3])) for c in chains(rows[:, 2], rows[:, 3]))
            merged: list[list] = []
            for d0, d1, a0, a1 in ends:  # chains that context would join, on nearly one diagonal or over the same words of the other, are one stretch
                near = bool(merged) and d0 - merged[-1][1] <= 2 * CONTEXT
                if near and (abs((a0 - d0) - (merged[-1][3] - merged[-1][1])) <= CONTEXT // 2 and a0 > merged[-1][2] or merged[-1][2] - CONTEXT // 2 <= a0 and a1 <= merged[-1][3] + CONTEXT // 2):
                    merged[-1] = [merged[-1][0], max(d1, merged[-1][1]), min(a0, merged[-1][2]), max(a1, merged[-1][3]), merged[-1][4]]
                else:
                    merged.append([d0, d1, a0, a1, []])
                parts = merged[-1][4]
                for part in parts[-16:] if len(ends_of) == 4 else ():  # pairs on one diagonal that overlap are one chain
                    if a0 - d0 == part[2] - part[0] and d0 <= part[1] + 1:
                        part[1], part[3] = max(part[1], d1 + K - 1), max(part[3], a1 + K - 1)
                        break
                else:
                    parts.append([d0, d1 + K - 1, a0, a1 + K - 1])
            out += [(rows[0, 0], rows[0, 1], d0, d1 + K - 1, a0, a1 + K - 1, [x for part in parts for x in part] if len(parts) > 1 else []) for d0, d1, a0, a1, parts in merged]

        def frame(out: list) -> pa.RecordBatch:
            ends = np.array([x[:6] for x in out], np.int64).reshape(-1, 6)
            cols = [*(pa.array(np.ascontiguousarray(c)) for c in ends.T), pa.array([x[6] for x in out], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["doc", "other", "d0", "d1", "a0", "a1", "parts"])

        for b in batches:
            rows = np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in ("doc", "other", *ends_of)])
            if not len(rows):
                continue
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            edges = [0, *cut.tolist(), len(rows)]
            out: list = []
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                finish(np.concatenate(held), out)
                held = []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if y == len(rows):
                    held.append(rows[x:y])
                elif x == 0 and held:
                    finish(np.concatenate([*held, rows[x:y]]), out)
                    held = []
                else:
                    finish(rows[x:y], out)
            yield frame(out)
        if held:
            out = []
            finish(np.concatenate(held), out)
            yield frame(out)

    spans = matches.mapInArrow(frugal(chain), "doc long, other long, d0 long, d1 long, a0 long, a1 long, parts array<long>")
    spans = stage(spans.withColumn("chain", F.xxhash64("doc", "other", "d0", "a0")), "chains")
    own = _slices(keyed, spans.select("chain", F.col("doc").alias("of"), "d0", "d1"))
    other = _slices(keyed, spans.select("chain", F.col("other").alias("of"), F.col("a0").alias("d0"), F.col("a1").alias("d1")))
    sides = own.select("chain", F.col("of").alias("doc"), F.col("lo").alias("d_lo"), F.col("w").alias("d"), F.col("first").alias("d_first")).join(other.select("chain", F.col("of").alias("other"), F.col("lo").alias("a_lo"), F.col("w").alias("a"), F.col("first").alias("a_first")), "chain")
    sides = lookup(sides, spans.where(F.size("parts") > 0).select("chain", "parts"), "chain")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "other", "first_word", "last_word", "other_first", "other_last"]
        for b in batches:
            out = []
            words, ends = zip(*((b.column(c).values.to_numpy(), b.column(c).offsets.to_numpy()) for c in ("d", "a")), strict=True)
            rows = zip(*(b.column(c).to_pylist() for c in ("doc", "other", "d_lo", "a_lo", "d_first", "a_first", "parts")), strict=True)
            for r, (i, j, x, y, p, q, at) in enumerate(rows):
                d, a = (w[e[r] : e[r + 1]].astype(np.uint64) for w, e in zip(words, ends, strict=True))
                at = at or []
                parts = tuple((at[c] - x, at[c + 1] - x, at[c + 2] - y, at[c + 3] - y) for c in range(0, len(at), 4))
                out += [(i, j, x + s, x + e, y + t, y + u, v) for s, e, t, u, v in align(d, a, (q - y) - (p - x), least, similarity, parts)]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.float64())], [*names, "similarity"])

    found = sides.mapInArrow(frugal(compare), "doc long, other long, first_word long, last_word long, other_first long, other_last long, similarity double")
    return found.dropDuplicates(["doc", "other", "first_word", "last_word"])


def _slices(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chain, of, first, lo, w): 31-bit word hashes of the wanted stretches with context. ``wanted``: chain, of, d0, d1.

    The stretches of a document are gathered by the hundred, so that its text is sent once for each
    hundred, not once a stretch; the first holder of a common passage may have one for every copy.
    """
    many = wanted.groupBy("of").agg(F.count("*").alias("n")).where(F.col("n") > SLICES).select("of", F.ceil(F.col("n") / SLICES).alias("parts_of"))
    dealt = lookup(wanted, many, "of").withColumn("part", F.coalesce(F.pmod(F.xxhash64("chain"), F.col("parts_of")), F.lit(0)))
    gathered = stage(dealt.groupBy("of", "part").agg(F.collect_list(F.struct("chain", "d0", "d1")).alias("at")), "gathered")
    texts = keyed.select(F.col("__doc").alias("_d"), "text")
    rows = lookup(texts, gathered, F.col("_d") == F.col("of"), "inner").select("of", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                w = (word_hashes(b.column("text")[r].as_py()) >> np.uint64(33)).astype(np.int32)
                of, at = b.column("of")[r].as_py(), b.column("at")[r].values
                chain, d0, d1 = (at.field(c).to_numpy(zero_copy_only=False) for c in ("chain", "d0", "d1"))
                lo = np.maximum(0, d0 - CONTEXT)
                got = [w[x : e + 1 + CONTEXT] for x, e in zip(lo.tolist(), d1.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(chain), pa.array(np.full(len(lo), of, np.int64)), pa.array(d0), pa.array(lo), pa.array(got, pa.list_(pa.int32()))], ["chain", "of", "first", "lo", "w"])

    # Repeated rows of a document give the same slices.
    return rows.mapInArrow(frugal(run), "chain long, of long, first long, lo long, w array<int>").dropDuplicates(["chain"])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (inclusive) and the white space after each span."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    _, start, end = hashed(data)
    gone = np.zeros(len(start) + 1, bool)
    for s, e in spans:
        gone[s : e + 1] = True
    gone = gone[: len(start)]
    keep, at = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        keep.append(data[at : start[s]].tobytes())
        at = int(start[e]) if e < len(start) else int(end[-1])
    keep.append(data[at:].tobytes())
    return b"".join(keep).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the passages of ``found`` cut from the later documents; documents left without words go.
    ``n_chars``, where there is one, follows the text."""
    names = docs.columns
    spans = stage(found.groupBy(F.col("doc").alias("__id")).agg(F.collect_set(F.struct(F.col("first_word").cast("int").alias("s"), F.col("last_word").cast("int").alias("e"))).alias("__spans")), "spans")
    rows = _keyed(docs.select(F.struct(*names).alias("__row"), "doc_id", "text"))
    joined = lookup(rows, spans, F.col("__doc") == F.col("__id"), "left").select("__row.*", "__spans")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.column("__spans").to_pylist()
            text = b.column("text").to_pylist()
            keep = []
            for i, x in enumerate(got):
                if x is not None:
                    text[i] = cut(text[i], [(v["s"], v["e"]) for v in x])
                if x is None or text[i].strip():
                    keep.append(i)
            cols = [pa.array(text, b.column("text").type) if c == "text" else b.column(c) for c in names]
            if "n_chars" in names:
                at = names.index("n_chars")
                old = cols[at].to_pylist()
                cols[at] = pa.array([o if x is None else len(t) for o, x, t in zip(old, got, text, strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(frugal(run), StructType([StructField(f.name, f.dataType, True) for f in schema]))
