"""What several operators of this subpackage share: staged tables, size-checked
lookups, connected components and dense ranks without a hot task."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: About the bytes of texts and vectors that a Python worker is sent at once; a batch of ten thousand texts may fill hundreds of MB.
BATCH_BYTES = 4 << 20
#: Most bytes that a lookup table may fill to be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Most edges of which one task finds the components (16 MB); more are settled by rounds of joins.
LOCAL_EDGES = 1 << 20

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, in local mode only (as in
    tests), a temporary folder of the machine serves, since driver and executors are one process there."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="epistrand-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES``, where the session has Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


#: Called in a worker before it serves another operator: each gives back what its module keeps between tasks.
kept_by_worker: list[Callable[[], None]] = []


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the memory that it leaves given back at the end of the task, since workers are used again."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forget in kept_by_worker:
            forget()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # there is none but in glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return released


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage, fixes non-deterministic plans, survives lost executors, and lets later
    readers prune columns. The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = staged_path(spark, name)
    df.write.parquet(path)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path)


def _collect(spark: SparkSession) -> None:
    """Have the driver collect its garbage once its heap is half full.

    Staged tables need no plans, shuffles or broadcast tables of before, but driver and executors
    hold those until the driver collects, which by itself it does late.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        gc.collect()  # handles of Python's DataFrames
        jvm.java.lang.System.gc()


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended, or the cluster cleans the folder itself
            continue


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row fills in memory."""
    total = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith(("array", "map")):
            each = 16 * max(1, kind.count(":"))
            total = total + 24 + F.coalesce(F.size(f.name), F.lit(0)).cast("long") * each
        elif kind in ("string", "binary"):
            total = total + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        else:
            total = total + 8 * max(1, kind.count(":"))
    return total


def lookup(df: DataFrame, small: DataFrame, on: list[str] | str | Column, how: str = "left", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``small`` (a staged or otherwise cheap table) to ``df``; broadcast it only if it fills at most ``most`` bytes."""
    held = small.agg(F.coalesce(F.sum(_row_bytes(small)), F.lit(0))).first()[0]
    return df.join(F.broadcast(small) if held <= most else small, on, how)


def held_out_remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def dense_rank_within(df: DataFrame, keys: list[str], salt: Column, order: list[Column], out: str, salts: int) -> DataFrame:
    """Add ``out``: 0-based rank of each row among those with equal ``keys``, with no gaps.

    A key may hold a third of all rows, so rows are ranked inside (key, salt) cells, and each cell
    starts where the cells of smaller salt end. ``df`` must be deterministic (staged), and ``keys``
    must take few values (a bounded set), since the cell table is keys x salts rows.
    """
    cells = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = cells.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = cells.withColumn("_in", F.row_number().over(inside) - 1)
    on = [ranked[k].eqNullSafe(starts[k]) for k in [*keys, "_salt"]]
    joined = ranked.join(starts, on, "inner")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_start") + F.col("_in")).cast("long").alias(out))


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the smallest node reachable from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        x, y = parent[x], parent[y]
        open_ = x != y
        x, y = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        np.minimum.at(parent, y, x)  # a root hooks to a smaller one, so the last root is the smallest
        while (parent != (up := parent[parent])).any():
            parent = up
    return nodes, nodes[parent]


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges``; root is the smallest node reachable.

    Up to ``LOCAL_EDGES`` edges are settled in one task. For more, large-star and small-star steps
    alternate (Kiveris et al. 2014) until the edges form stars. Each round is two aggregations with
    map-side combine and two joins on the edge table, staged in the shared folder; only a count and
    a checksum reach the driver.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, last = stage(e, "edges"), None
    if e.dtypes == [("u", "bigint"), ("v", "bigint")] and e.count() <= LOCAL_EDGES:

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*map(np.concatenate, zip(*got, strict=True)))], ["node", "root"])

        return stage(e.coalesce(1).mapInArrow(frugal(settle), "node long, root long"), "roots")
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == last or now[0] == 0:
            break
        last = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        e = stage(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
