"""Finding and repairing differences of replicas: bucketed digests first, rows of differing buckets only."""

from __future__ import annotations

import random
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvarn.functions.bytes_and_hashes import prefixed

from .versioning import compare

_WIDTH, MAX_LEAVES = 8, 65_536


def split_range(start: bytes, end: bytes, n: int) -> list[tuple[bytes, bytes]]:
    """[start, end) in up to ``n`` half-open buckets, evenly by the first 8 bytes; one if both ends share them. An empty end is unbounded."""
    if n <= 0:
        raise ValueError("the number of buckets must be positive")
    low = int.from_bytes(start[:_WIDTH].ljust(_WIDTH, b"\0"), "big")
    high = int.from_bytes(end[:_WIDTH].ljust(_WIDTH, b"\xff"), "big") if end else (1 << 64) - 1
    step = max(1, (high - low) // n)
    cuts = [c.to_bytes(_WIDTH, "big") for c in (low + step * i for i in range(1, n)) if c < high] if high > low else []
    edges = [start, *cuts, end]
    return list(zip(edges, edges[1:], strict=False))


def bucketed(rows: DataFrame, buckets: list[tuple[bytes, bytes]]) -> DataFrame:
    """``rows`` with the number of the bucket of each key; keys outside are dropped. Buckets are few (a tree level)."""
    spark = rows.sparkSession
    edges = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(buckets)], "bucket int, _from binary, _to binary")
    key = F.encode("key", "UTF-8")
    inside = (key >= F.col("_from")) & ((F.octet_length("_to") == 0) | (key < F.col("_to")))
    return rows.join(F.broadcast(edges), inside).drop("_from", "_to")


def digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n, digest: the digest of the bucket's sorted row digests. 32 bytes a row are gathered for each bucket, so buckets must be fine; ``sums`` has no such limit."""
    own = F.sha2(F.concat(prefixed(F.col("key")), prefixed(F.col("value"))), 256)
    return rows.select(*by, "key", own.alias("_d")).groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "_d"))), lambda x: x["_d"]), ""), 256).alias("digest"))


def mismatched(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Buckets that differ in count or digest, or that one side lacks."""
    a = digests(left, by)
    b = digests(right, by).withColumnsRenamed({"n": "_n", "digest": "_digest"})
    return a.join(b, by, "full_outer").filter(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest")))).select(*by, F.coalesce("n", F.lit(0)).alias("n_left"), F.coalesce("_n", F.lit(0)).alias("n_right"))


def sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n, s0, s1: the count and two sums of 60 bits of the row digests. Sums are combined before the shuffle and add up over buckets, and no rows are gathered."""
    own = F.sha2(F.concat(prefixed(F.col("key")), prefixed(F.col("value"))), 256)
    part = lambda at: F.conv(F.substring("_d", at, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(*by, own.alias("_d")).groupBy(*by).agg(F.count("*").alias("n"), F.sum(part(1)).alias("s0"), F.sum(part(16)).alias("s1"))


def _tree(start: bytes, end: bytes, fanout: int, depth: int):
    """A range and, below it, its parts: (start, end, parts)."""
    parts = split_range(start, end, fanout) if depth else []
    return start, end, [_tree(a, b, fanout, depth - 1) for a, b in parts] if len(parts) > 1 else []


def _finest(tree) -> list[tuple[bytes, bytes]]:
    return [x for t in tree[2] for x in _finest(t)] if tree[2] else [tree[:2]]


def in_sorted_buckets(rows: DataFrame, buckets: list[tuple[bytes, bytes]]) -> DataFrame:
    """``rows`` (key, value) with the number of the bucket of each key, by binary search over adjoining buckets; keys outside are dropped."""
    starts, end = [a for a, _ in buckets], buckets[-1][1]

    def search(batches):
        for batch in batches:
            keys = [k.encode() for k in batch.column(0).to_pylist()]
            at = np.array([bisect_right(starts, k) - 1 if not end or k < end else -1 for k in keys], dtype=np.int64)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["key", "value", "bucket"])
            yield out.filter(pa.array(at >= 0))

    return rows.select("key", "value").mapInArrow(search, "key string, value string, bucket int")


def differing_leaves(left: DataFrame, right: DataFrame, start: bytes = b"", end: bytes = b"", fanout: int = 4, leaf_rows: int = 32, max_depth: int = 6) -> list[tuple[bytes, bytes]]:
    """Ranges whose rows must be compared: equal ranges are left, small or deep ones are leaves, the others split. Both replicas are
    summed once, by the finest ranges (at most MAX_LEAVES); the sums of wider ones are added up from these."""
    tree = _tree(start, end, fanout, max_depth)
    finest = _finest(tree)
    if len(finest) > MAX_LEAVES:
        raise ValueError(f"{len(finest)} finest ranges; at most {MAX_LEAVES}")
    side = lambda df: {r["bucket"]: (r["n"], int(r["s0"]), int(r["s1"])) for r in sums(in_sorted_buckets(df, finest), ["bucket"]).collect()}
    a, b = side(left), side(right)
    place, leaves = {x: i for i, x in enumerate(finest)}, []

    def add(xs):
        return tuple(map(sum, zip((0, 0, 0), *xs, strict=True)))

    def descend(node):
        """The sums of both sides below a range; notes the leaves that differ."""
        if not node[2]:
            own = [a.get(place[node[:2]], (0, 0, 0)), b.get(place[node[:2]], (0, 0, 0))]
            return own, [node[:2]] if own[0] != own[1] else []
        below = [descend(x) for x in node[2]]
        own = [add([x[0][k] for x in below]) for k in (0, 1)]
        found = [y for x in below for y in x[1]]
        return own, [node[:2]] if found and max(own[0][0], own[1][0]) <= leaf_rows else found

    leaves = descend(tree)[1]
    return sorted(leaves)


def diff(local: DataFrame, peer: DataFrame, clock: str = "vector_clock") -> DataFrame:
    """key, relation, action: both sides' clocks compared; pull what is older or lacking here, push what is older or lacking there. Equal and concurrent versions stay."""
    a = local.select("key", F.col(clock).alias("_a"))
    b = peer.select(F.col("key").alias("_key"), F.col(clock).alias("_b"))
    both = a.join(b, a["key"] == b["_key"], "full_outer")
    relation = F.when(F.col("_a").isNull(), "missing_here").when(F.col("_b").isNull(), "missing_there").otherwise(compare(F.col("_a"), F.col("_b")))
    action = F.when(relation.isin("missing_here", "before"), "pull").when(relation.isin("missing_there", "after"), "push").otherwise("none")
    return both.select(F.coalesce("key", "_key").alias("key"), relation.alias("relation"), action.alias("action"))


class NotOwner(ValueError):
    """A repair held keys outside the range; nothing was applied."""


def check_ownership(rows: DataFrame, ranges: DataFrame, node: str) -> DataFrame:
    """``rows``, if ``node`` owns the range of every key."""
    from .ring import owners

    if owners(rows, ranges).filter(~F.array_contains("replicas", node)).limit(1).count():
        raise NotOwner(node)
    return rows


def repair(local: DataFrame, peer: DataFrame, clock: str = "vector_clock", ranges: DataFrame | None = None, local_id: str = "", peer_id: str = "") -> tuple[DataFrame, DataFrame]:
    """Both replicas after one exchange. With ``ranges``, ownership is looked up again: of what would be pulled, only keys that the
    local node owns are; and if the peer does not own every key that would be pushed, NotOwner is raised and nothing is applied."""
    from .ring import owners

    plan = diff(local, peer, clock)
    pull, push = (plan.filter(F.col("action") == a).select("key") for a in ("pull", "push"))
    if ranges is not None:
        pull = owners(pull, ranges).filter(F.array_contains("replicas", local_id)).select("key")
        push = check_ownership(push, ranges, peer_id)
    here = local.join(pull, "key", "left_anti").unionByName(peer.join(pull, "key", "left_semi").select(*local.columns))
    there = peer.join(push, "key", "left_anti").unionByName(local.join(push, "key", "left_semi").select(*peer.columns))
    return here, there


def pick_peer(replicas: list[str], local_id: str, seed: int) -> str | None:
    """Another replica of a range, drawn by the seed; None if there is none."""
    others = sorted(set(replicas) - {local_id})
    return random.Random(seed).choice(others) if others else None


def repair_round(nodes: dict[str, DataFrame], ranges: DataFrame, local_id: str, seed: int, clock: str = "vector_clock") -> dict[str, DataFrame]:
    """One round of a node: for each range that it owns, its rows are exchanged with those of one other replica, drawn by the seed. All replicas afterwards."""
    from .ring import few
    from .scan import within

    nodes = dict(nodes)
    for i, r in enumerate(few(ranges).orderBy("start").collect()):  # the map
        peer = pick_peer(r["replicas"], local_id, seed + i) if local_id in r["replicas"] else None
        if peer is None:
            continue
        inside = within(F.col("key"), F.lit(r["start"]), F.lit(r["end"]))
        here, there = repair(nodes[local_id].filter(inside), nodes[peer].filter(inside), clock, ranges, local_id, peer)
        nodes[local_id] = nodes[local_id].filter(~inside).unionByName(here)
        nodes[peer] = nodes[peer].filter(~inside).unionByName(there)
    return nodes
