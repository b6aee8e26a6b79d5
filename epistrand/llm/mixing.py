"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Among all rates ``r`` in [0, most] that give every source its token target, the operator takes the
one nearest to 1 copy a document in relative entropy, sum r*log(r) - r + 1. Its convex dual has one
multiplier a source, and the optimal rates are exponentially tilted: ``r = min(most, exp(l * size /
scale))``. The dual is solved by Newton steps, kept inside a bracket; each step is one aggregation.
The rates depend on (source, size) only, so the steps run over the pre-aggregated table of distinct
(source, size) pairs, never over the documents. Rates are then rounded into whole copies.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; null ids are
allowed. Repeated rows are separate documents. Documents of size 0 take no part in the constraint
and are kept once. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import lookup, stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Rows with equal (source, size) are ranked in so many cells, so that no group of copies meets in one task.
SALTS = 512
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sources fill in the order of capacity per weight: a source is full if its share of what the
    fuller ones leave exceeds its capacity, ``most`` times its size. One window over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = per_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", share * F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("full", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    # The order makes "full" a prefix, so what the open sources share is the least that any of them sees left.
    open_left = F.min(F.when(~F.col("full"), F.col("left_weight"))).over(everything)
    first_open = F.max(F.when(~F.col("full"), F.struct("left_weight", "left"))).over(everything)
    t = t.withColumn("open", first_open).withColumn("_o", open_left)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("open.left") * F.col("weight") / F.col("open.left_weight"))
    return t.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def tilt(hist: DataFrame, targets: DataFrame, most: float = MOST, steps: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """(source, scale, lam, full): the dual optimum. ``hist``: (source, size, n), staged, sizes above 0."""
    moments = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).cast("double").alias("scale"))
    state = targets.join(moments, targets.source.eqNullSafe(moments.source), "inner").select(
        targets.source, "target", "scale", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(60.0).alias("hi"),
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-9)).alias("full"), F.lit(False).alias("done"))
    state = stage(state, "tilt")
    for _ in range(steps):
        at = lookup(hist.withColumnRenamed("source", "_s"), state, F.col("_s").eqNullSafe(F.col("source")), "inner")
        raw = F.exp(F.col("lam") * F.col("size") / F.col("scale"))
        rate, tokens = F.least(raw, F.lit(most)), F.col("n") * F.col("size")
        at = at.groupBy("source", "target", "scale", "lam", "lo", "hi", "full", "done").agg(
            F.sum(tokens * rate).alias("got"), F.sum(F.when(raw < most, tokens * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.col("slope")
        # Below the optimum the plain step overshoots, since got grows like exp(lam); a step on log(got) does not.
        damped = F.when((off < 0) & (F.col("slope") > 0), F.col("lam") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")).otherwise(F.when(F.col("slope") > 0, newton))
        step = F.when((damped > lo) & (damped < hi), damped).otherwise((lo + hi) / 2)
        done = F.col("full") | (F.abs(off) <= tolerance * F.col("target")) | (hi - lo < 1e-12)
        state = stage(at.select("source", "target", "scale", F.when(done, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), "full", done.alias("done")), "tilt")
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select("source", "scale", "lam", "full")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, keep: list[str] | None = None) -> DataFrame:
    """One row a document: the columns ``keep`` (doc_id), size, source_size, target, rate, copies, taken.

    Within a source, (source, size) classes are visited from the longest documents down, and the
    running sum of wanted copies is rounded, so that a source misses its target by at most half its
    longest document; what is then missing is filled greedily from the classes that fit. Inside a
    class, documents are ranked by a hash of their id, and the first ones get the extra copy.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    sized = stage(docs.select(*[F.col(c) for c in keep], F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64(*[F.col(c) for c in keep]).alias("_h")), "sized")
    hist = stage(sized.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.count("*").alias("n")), "hist")
    per_source = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = stage(source_targets(per_source, weights, share, most), "targets")
    lam = tilt(hist.where("size > 0"), targets, most)

    h = lookup(hist, targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    h = lookup(h, lam.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), most).otherwise(F.least(F.lit(most), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    h = h.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("want", F.col("n") * F.col("rate"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.sum("want").over(down.rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("copies", (F.round(upto) - F.round(upto - F.col("want"))).cast("long"))
    h = h.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), (most * F.col("n")).cast("long"))))
    h = stage(h.select("source", "size", "n", "source_size", "target", "rate", "copies"), "classes")
    for _ in range(4):
        h = stage(_fill(h, most), "classes")

    ranked = _ranked(sized, h, spark)
    each, extra = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    copies = (each + F.when(F.col("_rank") < extra, 1).otherwise(0)).cast("long")
    out = ranked.select(*keep, F.col("size"), F.col("source_size"), F.col("target"), F.col("rate"), copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _fill(h: DataFrame, most: float) -> DataFrame:
    """One greedy correction: each source adds or drops copies of the one class that closes most of its gap."""
    gaps = h.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    j = lookup(h, gaps.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    room = F.when(F.col("gap") > 0, (most * F.col("n")).cast("long") - F.col("copies")).otherwise(F.col("copies"))
    fits = F.when(F.col("size") > 0, F.least(room, F.floor((F.abs("gap") + F.col("size") / 2) / F.col("size")))).otherwise(0)
    j = j.withColumn("move", fits.cast("long")).withColumn("closed", F.when(F.col("move") > 0, F.abs("gap") - F.abs(F.abs("gap") - F.col("move") * F.col("size"))).otherwise(0.0))
    best = j.groupBy("source").agg(F.max(F.struct("closed", "size")).alias("best"))
    j = lookup(j, best.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "inner")
    hit = (F.col("best.closed") > 0) & (F.col("best.size") == F.col("size"))
    copies = F.when(hit, F.col("copies") + F.signum("gap").cast("long") * F.col("move")).otherwise(F.col("copies"))
    return j.select("source", "size", "n", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def _ranked(sized: DataFrame, classes: DataFrame, spark) -> DataFrame:
    """Documents with their class's columns and ``_rank``, their place in the class.

    Cells of (source, size, salt) are ranked apart and start where the cells before them end, so a
    class that holds a third of all rows spreads over ``SALTS`` tasks.
    """
    cells = sized.withColumn("_salt", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int"))
    cell = ["_source", "_size", "_salt"]
    starts = cells.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.join(classes, starts._source.eqNullSafe(classes.source) & (starts._size == classes.size), "inner").drop("_source", "_size")
    inside = Window.partitionBy(*cell).orderBy("_h")
    ranked = cells.withColumn("_in", F.row_number().over(inside) - 1)
    on = ranked._source.eqNullSafe(starts.source) & (ranked._size == starts["size"]) & (ranked._salt == starts._salt)
    return ranked.join(starts, on, "inner").withColumn("_rank", F.col("_start") + F.col("_in"))
