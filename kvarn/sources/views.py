"""The driver's tables as a change log, its states, writers' clocks and replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvarn.schema import DELETE, PUT
from kvarn.session import ship

NODES = ("n0", "n1", "n2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn, key, op, value, event_id, event_type of ``events``: an error deletes its key."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(
        (F.col("event_id") + 1).alias("lsn"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("/"), F.lpad((F.col("event_id") % 16).cast("string"), 2, "0")).alias("key"),
        F.when(gone, DELETE).otherwise(PUT).alias("op"),
        F.when(~gone, F.concat("event_type", F.lit(":"), "props")).alias("value"),
        "event_id",
        "event_type",
    )


def kv_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the counters of three writers as ``vector_clock``; a signup is a blind write."""
    log = kv_log(spark, sf_dir)
    w = Window.partitionBy("key").orderBy("lsn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blind = F.col("event_type") == "signup"
    count = lambda i: F.sum(F.when(F.col("event_id") % 3 == i, 1).otherwise(0)).over(w)
    each = [F.when(blind & (F.col("event_id") % 3 != i), 0).otherwise(count(i)).cast("long") for i in range(3)]
    return log.withColumns({f"c{i}": c for i, c in enumerate(each)})


def as_clock(*counters: str):
    return F.map_from_arrays(F.array(*[F.lit(n) for n in NODES]), F.array(*[F.col(c).cast("decimal(20,0)") for c in counters]))


def kv_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, key, op, value, lsn, c0, c1, c2, vector_clock: three replicas that each missed about a tenth of the log."""
    clock = kv_clock(spark, sf_dir)
    held = clock.withColumn("r", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda r: (F.col("event_id") * 7 + r * 3) % 10 != 0)))
    last = held.groupBy("r", "key").agg(F.max_by(F.struct("op", "value", "lsn", "c0", "c1", "c2"), "lsn").alias("m"))
    return last.select("r", "key", "m.*").withColumn("vector_clock", as_clock("c0", "c1", "c2"))


def ranges(spark: SparkSession) -> DataFrame:
    """A map of four ranges over the keys."""
    rows = [("", "u000040/00", ["n1", "n2", "n3"]), ("u000040/00", "u000080/00", ["n2", "n3", "n4"]), ("u000080/00", "u000120/00", ["n3", "n4", "n5"]), ("u000120/00", "", ["n1", "n4", "n5"])]
    return spark.createDataFrame([(a, b, r, 1, "p") for a, b, r in rows], "start string, end string, replicas array<string>, generation long, proposal_id string")
