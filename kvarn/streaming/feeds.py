"""Streams over the log: a tail of committed batches, last-writer-wins state kept by micro-batches, and a rate limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvarn.operators.limits import take
from kvarn.operators.state import newest
from kvarn.schema import LOG
from kvarn.sources.store import KVStore


_ENTRIES = "version long, log array<struct<path:string,min_lsn:long,max_lsn:long,version:long>>"


def commits(spark: SparkSession, root: str, after_lsn: int = 0, files_per_batch: int | None = None) -> DataFrame:
    """path, min_lsn, max_lsn, version of each batch that a store at ``root`` commits, once, as its manifests appear. Files of failed
    commits are in no manifest. ``files_per_batch`` manifests at a time hold the flow back."""
    reader = spark.readStream.schema(_ENTRIES).option("pathGlobFilter", "*.json")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    entries = reader.json(f"{root}/manifest").select("version", F.explode("log").alias("e"))
    return entries.filter((F.col("e.version") == F.col("version")) & (F.col("e.max_lsn") > after_lsn)).select("e.*")


def follow(log: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, after_lsn: int = 0, **trigger) -> StreamingQuery:
    """Call ``handle(rows, number)`` with the log rows of each micro-batch of ``commits``."""

    def run(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.orderBy("version").collect()]  # a row for each commit of the micro-batch
        if paths:
            handle(batch.sparkSession.read.schema(LOG).parquet(*paths).filter(F.col("lsn") > after_lsn), number)

    return log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_changes(log: DataFrame) -> DataFrame:
    """For each key the newest row so far, for update mode: late and repeated files change nothing, as the LSN decides."""
    return log.groupBy("key").agg(F.max_by(F.struct("op", "value", "lsn"), "lsn").alias("m")).select("key", "m.op", "m.value", "m.lsn")


def materialise(log: DataFrame, store: KVStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch of ``commits``, reduced to its newest row a key, to a store under the source's LSNs, so that a change that comes
    late loses to a newer one. A batch that is run again after a failure is skipped: its number is kept with the commit."""

    def write(rows: DataFrame, number: int) -> None:
        if number > store.manifest().get("stream_batch", -1):
            store.append(newest(rows), stream_batch=number)

    return follow(log, write, checkpoint, **trigger)


def limited(requests: DataFrame, rate: float = 100.0, most: int = 10000) -> DataFrame:
    """user, seq, ts_seconds, allowed for a stream of requests (user long, seq long, ts_seconds long); each user's bucket is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = held.get if held.exists else (most, None)
        rows = pd.concat(list(frames)).sort_values(["ts_seconds", "seq"])
        out = []
        for now in rows["ts_seconds"]:
            ok, tokens, last = take(tokens, now if last is None or last < 0 else last, int(now), rate, most)
            out.append(ok)
        held.update((int(tokens), int(last)))
        yield rows.assign(allowed=out)[["user", "seq", "ts_seconds", "allowed"]]

    return requests.groupBy("user").applyInPandasWithState(step, "user long, seq long, ts_seconds long, allowed boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)
