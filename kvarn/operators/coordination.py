"""Quorum reads and writes over replicas, as joins and one aggregation for all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvarn.schema import DELETE, PUT

from .ring import owners
from .versioning import decode, encode, envelope, in_order, increment, merge_all, reconcile


class InvalidRequest(ValueError):
    """A request that no retry can mend: an empty key, or a quorum above the number of owners."""


class Unavailable(RuntimeError):
    """Fewer replicas than needed have answered; what they stored stays."""


class NotFound(KeyError):
    """No replica that answered has the key."""


ERRORS = {"invalid": InvalidRequest, "unavailable": Unavailable, "not_found": NotFound}


def checked(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (key, status), or the error of the first key in order whose status is not ok."""
    bad = outcomes.filter("status <> 'ok'").orderBy("key").first()
    if bad is not None:
        raise ERRORS[bad["status"]](bad["key"])
    return outcomes


def required(asked: Column, default: int, n_owners: Column, key: Column) -> tuple[Column, Column]:
    """(needed acknowledgements, status): 0 or less asks for the default; more than there are owners, or an empty key, is invalid; no owners are unavailable."""
    need = F.when(asked <= 0, default).otherwise(asked)
    status = F.when((key == "") | key.isNull(), "invalid").when(n_owners == 0, "unavailable").when(need > n_owners, "invalid")
    return need, status


def fan_out(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """A row for each key and owner: key, node_id."""
    return owners(keys, ranges).select(*keys.columns, F.explode("replicas").alias("node_id"))


def write_outcome(acks: DataFrame, default: int) -> DataFrame:
    """key, acks, required, status of writes; acks (key, node_id, ok, quorum). Nothing is rolled back."""
    got = acks.groupBy("key", "quorum").agg(F.count("*").alias("_owners"), F.count_if("ok").alias("acks"))
    need, bad = required(F.col("quorum"), default, F.col("_owners"), F.col("key"))
    return got.select("key", "acks", need.alias("required"), F.coalesce(bad, F.when(F.col("acks") >= need, "ok").otherwise("unavailable")).alias("status"))


def read_outcome(answers: DataFrame, quorum: int) -> DataFrame:
    """key, acks, status, versions, context; answers (key, node_id, ok, envelope or null). A replica without the key acknowledges too. Replicas are taken in the order of their ids."""
    got = answers.groupBy("key").agg(
        F.count("*").alias("_owners"),
        F.count_if("ok").alias("acks"),
        in_order(F.collect_list(F.when(F.col("ok") & F.col("envelope").isNotNull(), F.struct("node_id", "envelope"))), "node_id").alias("_found"),
    )
    need, bad = required(F.lit(quorum), quorum, F.col("_owners"), F.col("key"))
    kept = reconcile(F.transform("_found", lambda x: x["envelope"]))
    status = F.coalesce(bad, F.when(F.col("acks") < need, "unavailable").when(F.size(kept) == 0, "not_found").otherwise("ok"))
    return got.select("key", "acks", status.alias("status"), kept.alias("versions"), merge_all(F.transform(kept, lambda v: v["vector_clock"])).alias("context"))


def next_clock(context: Column, node: str) -> Column:
    """The clock of a write: its context, with the coordinator's counter one higher."""
    return increment(F.coalesce(context, F.create_map().cast("map<string,decimal(20,0)>")), node)


def coordinate_writes(writes: DataFrame, ranges: DataFrame, up: DataFrame, node_id: str, default: int, nanos: int) -> tuple[DataFrame, DataFrame]:
    """Puts and deletes (key, value, deleted, context, quorum) sent to all owners of their keys.

    Returns the rows that replicas store (node_id, key, envelope) and the outcomes (key, acks, required, status). A
    replica that is up stores and acknowledges; what is stored stays, whether the quorum was met or not. A delete is stored as an envelope too.
    """
    clock = next_clock(F.col("context").cast("map<string,decimal(20,0)>"), node_id)
    stamped = writes.withColumn("envelope", envelope(clock, F.lit(nanos), F.col("deleted"), F.col("value")))
    valid = stamped.filter(F.col("key") != "")
    sent = fan_out(valid, ranges).join(F.broadcast(up.select("node_id", F.lit(True).alias("_up"))), "node_id", "left")  # nodes of a cluster
    sent = sent.withColumn("ok", F.coalesce("_up", F.lit(False)))
    outcomes = write_outcome(sent.select("key", "node_id", "ok", "quorum"), default)
    refused = stamped.filter((F.col("key") == "") | F.col("key").isNull()).select("key", F.lit(0).cast("long").alias("acks"), F.lit(default).alias("required"), F.lit("invalid").alias("status"))
    return sent.filter("ok").select("node_id", "key", "envelope"), outcomes.unionByName(refused)


def coordinate_reads(keys: DataFrame, ranges: DataFrame, stored: DataFrame, up: DataFrame, quorum: int) -> DataFrame:
    """Reads of ``keys`` from all owners that are up; stored (node_id, key, envelope) holds a row for each replica and key."""
    asked = fan_out(keys.select("key").distinct(), ranges).join(F.broadcast(up.select("node_id", F.lit(True).alias("_up"))), "node_id", "left")
    return read_outcome(asked.withColumn("ok", F.coalesce("_up", F.lit(False))).join(stored, ["node_id", "key"], "left").select("key", "node_id", "ok", "envelope"), quorum)


def with_addresses(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` (node_id) with each node's address; null where it is not known."""
    return rows.join(F.broadcast(members.select("node_id", "advertise_addr")), "node_id", "left")  # nodes of a cluster


def stored(rows: DataFrame) -> DataFrame:
    """op, key, value as a replica logs envelopes (op, key, envelope): a delete is a put of an envelope that says so. A row whose op and envelope disagree, or without an envelope, fails."""
    agree = (F.col("op") == DELETE) == F.col("envelope.deleted")
    value = F.when(F.coalesce(agree, F.lit(False)), encode(F.col("envelope"))).otherwise(F.raise_error(F.concat(F.lit("operation and envelope disagree: "), F.coalesce("key", F.lit("")))))
    return rows.select(F.lit(PUT).alias("op"), "key", value.alias("value"))


def decoded(state: DataFrame) -> DataFrame:
    """key, envelope of a state whose values are encoded envelopes; others are null."""
    return state.select("key", decode(F.col("value")).alias("envelope"))


def owned(rows: DataFrame, ranges: DataFrame, node_id: str, strict: bool = True) -> DataFrame:
    """``rows`` (key) of ranges that a node owns; ``strict`` refuses if there are others."""
    held = owners(rows, ranges).withColumn("_mine", F.array_contains("replicas", node_id)).drop("range_start", "range_end", "replicas")
    if strict and held.filter(~F.col("_mine")).limit(1).count():
        raise PermissionError(f"{node_id} does not own all keys")
    return held.filter("_mine").drop("_mine")
