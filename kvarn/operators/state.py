"""Last-writer-wins state of a change log (lsn, key, op, value) and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvarn.schema import DELETE, PUT


def newest(log: DataFrame) -> DataFrame:
    """The newest row of each key, deletes included: one scan, combined before the shuffle. Filters on key pass below it; filters on value or op must not."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "lsn"), "lsn").alias("last"))
    return last.select("key", "last.op", "last.value", "last.lsn")


def live(log: DataFrame, at_lsn: int | None = None) -> DataFrame:
    """key, value, lsn as of an LSN; a delete masks every older value."""
    return newest(log if at_lsn is None else log.filter(F.col("lsn") <= at_lsn)).filter(F.col("op") == PUT).select("key", "value", "lsn")


def deleted(log: DataFrame) -> DataFrame:
    return newest(log).filter(F.col("op") == DELETE).select("key", "lsn")


def get(log: DataFrame, key: str) -> DataFrame:
    """At most one row; the key's filter reaches the scan."""
    return live(log.filter(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found, value for each distinct key asked for. Log rows of other keys are dropped before they are aggregated."""
    asked = keys.select("key").distinct()
    found = live(log.join(asked, "key", "left_semi"))
    return asked.join(found, "key", "left").select("key", F.col("lsn").isNotNull().alias("found"), "value")


def assign_lsn(mutations: DataFrame, order: str, base_lsn: int, chunk: int = 65536) -> DataFrame:
    """``lsn`` = base + 1, 2, ... in the order of an integer column: ranks within chunks of it, and a running count of chunks."""
    part = F.floor(F.col(order) / chunk)
    cut = mutations.withColumn("_chunk", part)
    sizes = cut.groupBy("_chunk").count()
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    starts = sizes.select("_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_chunk").orderBy(order))
    return cut.withColumn("_own", own).join(starts, "_chunk").withColumn("lsn", (F.lit(base_lsn) + F.col("_before") + F.col("_own")).cast("long")).drop("_chunk", "_own", "_before")


def running_sum(rows: DataFrame, order: str, value: str, out: str, chunk: int = 4096) -> DataFrame:
    """Sum of ``value`` up to and including each row in the order of an integer column, without one task for all rows."""
    cut = rows.withColumn("_chunk", F.floor(F.col(order) / chunk))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    starts = cut.groupBy("_chunk").agg(F.sum(value).alias("_s")).select("_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(starts, "_chunk").withColumn(out, F.col("_before") + F.col("_own")).drop("_chunk", "_own", "_before")


def memtable_batches(log: DataFrame, limit_bytes: int = 1000) -> DataFrame:
    """batch, n, bytes, max_lsn: the log cut where the bytes of keys and values before a row pass a multiple of the limit."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    summed = running_sum(log.withColumn("_b", size.cast("long")), "lsn", "_b", "_upto")
    batch = F.floor((F.col("_upto") - F.col("_b")) / limit_bytes)
    return summed.groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), F.sum("_b").alias("bytes"), F.max("lsn").alias("max_lsn"))


def group_commits(log: DataFrame, requests: int = 256) -> DataFrame:
    """batch, n, first_lsn, durable_lsn: every request of a batch is durable once its highest LSN is."""
    return log.groupBy(F.floor((F.col("lsn") - 1) / requests).alias("batch")).agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("durable_lsn"))
