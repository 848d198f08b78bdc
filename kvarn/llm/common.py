"""Helpers shared by the training-data operators: the shared folder, global ranks, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvarn.session import scratch

#: White space between words: the ASCII space and TAB to CR. ``bytes.split()`` cuts at the same characters.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; see ``kvarn.session.scratch``."""
    return scratch(spark)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs within are deleted at its end; later steps read the table that was written, not these."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts the lineage, and a lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean, df.sparkSession)
    _written.add(path)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.discard(name)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing that is still to be computed reads it."""
    _delete(df.sparkSession, df.written_to)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this process has written to the shared folder: after results are stored, and at its end."""
    for name in sorted(_written):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, name)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are written and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that a Python worker has freed back to the system, so that workers kept for later tasks stay small."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of 0 and more in variable-length bytes: seven bits each, the last with its high bit set."""
    x = x.astype(np.uint64)
    size, k = np.ones(len(x), dtype=np.int64), 1
    while (more := x >> np.uint64(7 * k)).any():
        size += more > 0
        k += 1
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, dtype=np.uint8)
    for j in range(k):
        some = size > j
        out[ends[some] - 1 - j] = (x[some] >> np.uint64(7 * j)) & np.uint64(127)
    out[ends - 1] |= 128
    return out.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw >= 128)
    size = np.diff(np.concatenate([[-1], ends]))
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        out[some] |= (raw[ends[some] - k] & 127).astype(np.int64) << (7 * k)
    return out


def six_bytes(x: np.ndarray) -> bytes:
    """The low six bytes of 64-bit hashes: enough to tell apart what meets in one of many buckets."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that further columns with any names don't matter."""
    return df.select(*[df[n] for n in names])


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def ranked(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Adds the global 0-based rank by ``keys``, without a single-task window.

    Rows are range-partitioned and sorted by the keys and, for ties, by their place in the input, so equal
    keys spread over partitions. The driver sees one count for each partition.
    """
    spark = df.sparkSession
    placed = (
        materialise(df.withColumn("_tie", F.monotonically_increasing_id()), "unranked")  # range partitioning reads its input twice
        .repartitionByRange(*keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_tie")
    )
    placed = materialise(placed, "ranked")
    part = F.shiftright(F.col("_at"), 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_p", part.cast("long"))
        .join(F.broadcast(offsets), "_p")  # one row a partition
        .withColumn(name, F.col("_start") + within)
        .drop("_p", "_start", "_at")
    )


def components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Connected components of ``edges`` (a, b: long or string): rows (node, root), root the least node of each.

    Large and small stars take turns (Kiveris et al. 2014): a node's greater neighbours, then its lesser ones, are linked
    to the least node it knows, until nothing changes and every component is one star. Roots are linked as well as
    nodes, so rounds grow with the logarithm of the nodes. Every step is written to the shared folder and the step before
    deleted. Nothing is collected but whether a round has changed anything; more than ``max_rounds`` is an error.
    """
    edges = materialise(edges.select("a", "b"), "edges")  # else both directions would be computed apart
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(False).alias("changed"))
    for turn in range(max_rounds):
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("u")).alias("changed"))
        large = materialise(large.groupBy("a", "b").agg(F.max("changed").alias("changed")), "large")
        if turn:
            discard(stars)
        own = large.groupBy("a").agg(F.min("b").alias("m"), F.max("changed").alias("changed"))
        moved = large.select("a", "b").join(own.select("a", "m"), "a").filter("b <> m").select("b", "m", F.lit(True))
        small = own.select("a", F.col("m").alias("b"), "changed").union(moved)
        stars = materialise(small.groupBy("a", "b").agg(F.max("changed").alias("changed")), "stars")
        discard(large)
        if not stars.filter("changed").limit(1).count():
            break
    else:
        raise RuntimeError(f"components: labels still change after {max_rounds} rounds")
    found = nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return found.select("node", F.coalesce("root", "node").alias("root"))
