"""Membership records: precedence, merges, and the failure detector as a fold over probe results."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold

RANK = {"unknown": 0, "alive": 1, "suspect": 2, "dead": 3}


def rank(status: Column) -> Column:
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(status == name, r).otherwise(out)
    return out


def merge(records: DataFrame, cluster_id: str, local_id: str, local_incarnation: int) -> DataFrame:
    """node_id, status, incarnation, range_map_epoch after all records: the higher incarnation wins, then dead over suspect over alive; the highest epoch is kept apart. Other clusters' records are ignored. Accusations of the local node are refuted with a higher incarnation; other records of it don't count."""
    own = records.filter((F.col("cluster_id") == cluster_id) | (F.col("cluster_id") == ""))
    others = own.filter(F.col("node_id") != local_id).groupBy("node_id").agg(
        F.max_by(F.struct("status", "incarnation"), F.struct("incarnation", rank(F.col("status")))).alias("m"), F.max("range_map_epoch").alias("range_map_epoch")
    )
    accused = own.filter((F.col("node_id") == local_id) & F.col("status").isin("suspect", "dead") & (F.col("incarnation") >= local_incarnation))
    me = accused.agg(F.max("incarnation").alias("_i")).select(F.lit(local_id).alias("node_id"), F.lit("alive").alias("status"), F.coalesce(F.col("_i") + 1, F.lit(local_incarnation)).cast("long").alias("incarnation"), F.lit(0).cast("long").alias("range_map_epoch"))
    return others.select("node_id", "m.status", "m.incarnation", "range_map_epoch").unionByName(me)


def detect(probes: DataFrame, suspect_after: int) -> DataFrame:
    """target, tick, status after each probe (target, tick, direct_ok, indirect_ok): a failed probe makes an alive node suspect, suspicion that lasts ``suspect_after`` ticks makes it dead, an answer clears it; the dead stay dead.

    A fold for each target, in bounded memory.
    """

    def step(state, target, tick, direct, indirect):
        status, since = state
        if status != "dead":
            if direct or indirect:
                status, since = "alive", None
            elif status == "alive":
                status, since = "suspect", tick
            elif tick - since >= suspect_after:
                status = "dead"
        return (status, since), status

    rows = probes.select("target", "tick", "direct_ok", "indirect_ok")
    return ordered_fold(rows, "target", ["tick"], lambda: ("alive", None), step, "status string").select("target", "tick", "status")


def upsert(members: DataFrame, records: DataFrame) -> DataFrame:
    """``members`` with the rows of ``records`` put in place of theirs, whatever precedence says."""
    return members.join(records.select("node_id"), "node_id", "left_anti").select(*members.columns).unionByName(records.select(*members.columns))


def stamped(members: DataFrame, epoch: int, changed: DataFrame) -> DataFrame:
    """``members`` with ``epoch`` as the membership_epoch of the ``changed`` nodes; an epoch never goes back."""
    mark = changed.select("node_id", F.lit(True).alias("_changed")).distinct()
    now = F.when(F.col("_changed"), F.greatest(F.col("membership_epoch"), F.lit(epoch).cast("long"))).otherwise(F.col("membership_epoch"))
    return members.join(mark, "node_id", "left").withColumn("membership_epoch", now).select(*members.columns)


def probe_plan(members: list[str], local_id: str, seed: int, helpers: int = 3, seeds: list[str] | None = None) -> dict[str, list[str]]:
    """Whom a node probes in a round, drawn by the seed: seeds that are not members yet, one other member, and who is asked to probe it as well."""
    rng = random.Random(seed)
    others = sorted(set(members) - {local_id})
    target = rng.choice(others) if others else None
    rest = [n for n in others if n != target]
    return {"seeds": sorted(set(seeds or []) - set(members) - {local_id}), "direct": [target] if target else [], "indirect": sorted(rng.sample(rest, min(helpers, len(rest))))}


def snapshot(members: DataFrame) -> DataFrame:
    return members.orderBy("node_id")


def alive(members: DataFrame) -> DataFrame:
    return members.filter(F.col("status") == "alive").select("node_id")


class Detector:
    """The same transitions, guarded by incarnation, for one table held in memory."""

    def __init__(self, local_id: str):
        self.local_id = local_id
        self.members: dict[str, tuple[str, int]] = {local_id: ("alive", 0)}

    def mark(self, node: str, incarnation: int, new: str) -> bool:
        """alive to suspect, or suspect to dead, if the incarnation is the one held."""
        status, held = self.members.get(node, ("unknown", -1))
        if node == self.local_id or held != incarnation or RANK[new] != RANK[status] + 1 or new not in ("suspect", "dead"):
            return False
        self.members[node] = (new, held)
        return True

    def __iter__(self) -> Iterator[tuple[str, tuple[str, int]]]:
        return iter(sorted(self.members.items()))
