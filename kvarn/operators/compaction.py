"""Level merges with a gate for tombstones, their plan, and log retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvarn.schema import DELETE

from .state import newest


def drops_tombstones(last_level: Column, safe_lsn: Column, max_lsn: Column) -> Column:
    """Only on the last level, and only if no gate is set or the whole merge lies at or below it."""
    return last_level & ((safe_lsn == 0) | ((max_lsn > 0) & (max_lsn <= safe_lsn)))


def merge(tables: list[DataFrame], last_level: bool = False, safe_lsn: int = 0) -> DataFrame:
    """key, op, value, lsn: the newest row of each key over all tables; tombstones go where the gate allows."""
    rows = reduce(DataFrame.unionByName, [t.select("lsn", "key", "op", "value") for t in tables])
    merged = newest(rows)
    if not last_level:
        return merged
    if safe_lsn:
        top = rows.agg(F.max("lsn").alias("_top"))  # one row
        gated = merged.join(F.broadcast(top), how="cross").withColumn("_drop", drops_tombstones(F.lit(True), F.lit(safe_lsn), F.col("_top")))
        return gated.filter(~((F.col("op") == DELETE) & F.col("_drop"))).drop("_top", "_drop")
    return merged.filter(F.col("op") != DELETE)


def plan(manifest: DataFrame, threshold: int = 4, levels: int = 4) -> DataFrame:
    """Tables (level, path, seq) that merge now: for each level but the last, the oldest in batches of ``threshold``: level, batch, path."""
    rank = F.row_number().over(Window.partitionBy("level").orderBy("seq")) - 1
    n = F.count("*").over(Window.partitionBy("level"))
    ranked = manifest.filter(F.col("level") < levels - 1).withColumn("_r", rank).withColumn("_n", n)
    return ranked.filter(F.col("_r") < F.floor(F.col("_n") / threshold) * threshold).select("level", F.floor(F.col("_r") / threshold).alias("batch"), "path", "seq")


def retention(log: DataFrame, checkpoint: int, segment: int = 1000) -> DataFrame:
    """segment, min_lsn, max_lsn, n, purged: segments wholly at or below the checkpoint go, never the newest one. LSNs rise with segments, so no newer one stands before a purged one."""
    parts = log.groupBy(F.floor((F.col("lsn") - 1) / segment).alias("segment")).agg(F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.count("*").alias("n"))
    top = parts.agg(F.max("segment").alias("_top"))  # one row
    return parts.join(F.broadcast(top), how="cross").select("segment", "min_lsn", "max_lsn", "n", ((F.col("max_lsn") <= checkpoint) & (F.col("segment") < F.col("_top"))).alias("purged"))
