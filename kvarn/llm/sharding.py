"""Consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on the ring; its home is the next virtual node clockwise. A shard first takes the keys at home in
its own arcs, up to its capacity; what overflows continues clockwise to the next virtual node whose shard has room.
Capacities are ``rows // shards`` or one more, so counts differ by at most one (law ``rows``). Keys of an arc are told
apart only by their rank on the ring, so the plan is made from one count for each arc: a table of ``shards * vnodes``
rows. Documents themselves are only range-sorted by place.

Null texts have no bytes; null doc_ids share one place and overflow from it like any other keys; repeated rows are
placed one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialise, ranked

SHARDS, VNODES = 24, 64


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Places (sorted signed 64-bit) and owners of the virtual nodes."""
    at = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(vnodes))
    return np.array([a for a, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int64)


def bounded_loads(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Intervals (first rank, rows, shard) that place every key, for the number of keys in each arc."""
    total = int(counts.sum())
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else counts
    placed: list[tuple[int, int, int]] = []
    over: list[tuple[int, int, int]] = []  # arc, first rank, rows
    for arc, (start, n, s) in enumerate(zip(starts.tolist(), counts.tolist(), owners.tolist(), strict=True)):
        stay = min(n, int(room[s]))
        if stay:
            placed.append((start, stay, s))
            room[s] -= stay
        if n > stay:
            over.append((arc, start + stay, n - stay))
    arcs, carried, due = len(counts), [], {a: (r, n) for a, r, n in over}
    for step in range(2 * arcs):  # once round to pick all up, once more to put the last down
        arc = step % arcs
        if step < arcs and arc in due:
            carried.append(due[arc])
        s, kept = int(owners[arc]), []
        for first, n in carried:
            take = min(n, int(room[s]))
            if take:
                placed.append((first, take, s))
                room[s] -= take
            if n > take:
                kept.append((first + take, n - take))
        carried = kept
        if not carried and step >= arcs:
            break
    return sorted(placed)


def place(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: under this law one more shard moves few rows, but not only into itself)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.xxhash64(F.lit("ring"), F.col("doc_id").cast("string")).alias("_place"),
    )
    spots, owners = ring(shards, vnodes)

    def arc_of(batches):
        for batch in batches:
            place_ = batch.column(batch.schema.get_field_index("_place")).to_numpy(zero_copy_only=False)
            arc = np.searchsorted(spots, place_, side="left") % len(spots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc, pa.int32())], names=[*batch.schema.names, "_arc"])

    schema = "doc_id long, size long, text_crc32 long, _place long, _arc int"
    placed = materialise(ranked(rows.mapInArrow(arc_of, schema), ["_arc", "_place", "doc_id"], "_rank"), "ring")
    counts = np.zeros(len(spots), dtype=np.int64)
    for arc, n in placed.groupBy("_arc").count().collect():  # a row for each virtual node at most
        counts[arc] = n
    plan = bounded_loads(counts, owners, shards)
    used, lows, to, slots = np.zeros(shards, dtype=np.int64), [], [], []
    for first, n, s in plan:
        lows.append(first)
        to.append(s)
        slots.append(int(used[s]))
        used[s] += n
    low, shard, slot = (np.array(x, dtype=np.int64) for x in (lows, to, slots))

    def deal(batches):
        for batch in batches:
            rank = batch.column(3).to_numpy(zero_copy_only=False)
            e = np.searchsorted(low, rank, side="right") - 1
            own = shard[e] if len(rank) else rank
            at = slot[e] + rank - low[e] if len(rank) else rank
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int32()), pa.array(at, pa.int64())], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    dealt = placed.select("doc_id", "size", "text_crc32", "_rank").mapInArrow(deal, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def moved_share(counts: np.ndarray, shards: int, vnodes: int = VNODES) -> float:
    """The share of keys that change shard when one is added, from the number of keys at each place of a fine even grid over the ring."""
    edges = np.linspace(-(2**63), 2**63 - 1, len(counts) + 1)[1:]
    where = []
    for n in (shards, shards + 1):
        spots, owners = ring(n, vnodes)
        arc = np.searchsorted(spots, edges, side="left") % len(spots)
        order = np.argsort(arc, kind="stable")
        per_arc = np.bincount(arc, weights=counts, minlength=len(spots)).astype(np.int64)
        to = np.empty(int(counts.sum()), dtype=np.int64)
        for first, k, s in bounded_loads(per_arc, owners, n):
            to[first : first + k] = s
        by_key, start = {}, 0
        for cell in order.tolist():
            by_key[cell] = to[start : start + int(counts[cell])]
            start += int(counts[cell])
        where.append(np.concatenate([by_key[c] for c in range(len(counts))]) if len(counts) else np.array([]))
    return float((where[0] != where[1]).mean()) if len(where[0]) else 0.0
