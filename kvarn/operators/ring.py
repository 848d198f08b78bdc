"""Range maps: half-open key ranges that cover all keys, with replicas, a generation and a proposal id.

Whole maps are small (a row for each tablet) and are handled as Python values; lookups of many keys are joins.
"""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_right
from dataclasses import dataclass, replace
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvarn.functions.bytes_and_hashes import length_prefixed, u64
from kvarn.schema import RANGE

from .scan import within

MAX_GENERATION = (1 << 64) - 1
MAX_RANGES = 1_000_000


@dataclass(frozen=True)
class Range:
    start: str
    end: str
    replicas: tuple[str, ...]
    generation: int = 1
    proposal_id: str = ""

    def contains(self, key: str) -> bool:
        k = key.encode()
        return (not self.start or k >= self.start.encode()) and (not self.end or k < self.end.encode())


def problems(ranges: list[Range]) -> list[str]:
    """Codes of the rules a map breaks."""
    if not ranges:
        return ["empty"]
    found = []
    if ranges[0].start:
        found.append("bounded_start")
    if ranges[-1].end:
        found.append("bounded_end")
    for a, b in zip(ranges, ranges[1:], strict=False):
        if not a.end or a.end != b.start:
            found.append("not_contiguous")
    for r in ranges:
        if r.start and r.end and r.start.encode() >= r.end.encode():
            found.append("degenerate")
        if not 0 < r.generation <= MAX_GENERATION:
            found.append("generation")
        if not r.proposal_id:
            found.append("proposal_id")
        if not r.replicas or len(set(r.replicas)) < len(r.replicas) or "" in r.replicas:
            found.append("replicas")
    return sorted(set(found))


def violations(ranges: DataFrame) -> DataFrame:
    """start, code of the broken rules of a map held as rows (start, end, replicas, generation, proposal_id)."""
    w = Window.orderBy("start")  # a row for each tablet
    row = (
        ranges.withColumn("_next", F.lead("start").over(w))
        .withColumn("_n", F.row_number().over(w))
        .withColumn("_bad", F.array_compact(F.array(
            F.when((F.col("_n") == 1) & (F.col("start") != ""), "bounded_start"),
            F.when(F.col("_next").isNull() & (F.col("end") != ""), "bounded_end"),
            F.when(F.col("_next").isNotNull() & ((F.col("end") == "") | (F.col("end") != F.col("_next"))), "not_contiguous"),
            F.when((F.col("start") != "") & (F.col("end") != "") & (F.col("start") >= F.col("end")), "degenerate"),
            F.when(F.col("generation") <= 0, "generation"),
            F.when(F.col("proposal_id") == "", "proposal_id"),
            F.when(F.size("replicas") == 0, "replicas"),
        )))
    )
    return row.select("start", F.explode("_bad").alias("code"))


def to_rows(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    """A map as rows."""
    return spark.createDataFrame([(r.start, r.end, list(r.replicas), Decimal(r.generation), r.proposal_id) for r in ranges], RANGE)


def from_rows(rows: DataFrame) -> list[Range]:
    """A map held as rows, checked."""
    found = sorted((Range(r["start"], r["end"], tuple(r["replicas"] or ()), int(r["generation"]), r["proposal_id"]) for r in few(rows).collect()), key=lambda r: r.start.encode())
    if bad := problems(found):
        raise ValueError(f"invalid range map: {', '.join(bad)}")
    return found


def few(ranges: DataFrame) -> DataFrame:
    """A map that may be broadcast: its number of ranges has been checked."""
    if (n := ranges.count()) > MAX_RANGES:
        raise ValueError(f"{n} ranges; at most {MAX_RANGES} can be searched")
    return ranges


def owners(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """``keys`` (with ``key``) and the start, end and replicas of the range that holds each.

    By binary search over the sorted starts, which are sent to the executors after a check of their number. Keys that no
    range holds (before the first, in a gap, after the last) have no row, nor have null keys.
    """
    rows = sorted(((r[0].encode(), r[1], r[2]) for r in few(ranges).select("start", "end", "replicas").collect()), key=lambda r: r[0])
    starts, ends, replicas = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
    bytes_ends = [e.encode() for e in ends]
    at, schema = keys.columns.index("key"), keys.schema

    def search(batches):
        for batch in batches:
            took, where = [], []
            for i, k in enumerate(batch.column(at).to_pylist()):
                r = bisect_right(starts, k := k.encode()) - 1
                if r >= 0 and (not bytes_ends[r] or k < bytes_ends[r]):
                    took.append(i)
                    where.append(r)
            held = batch.take(pa.array(took, pa.int64()))
            more = [pa.array([starts[r].decode() for r in where], pa.string()), pa.array([ends[r] for r in where], pa.string()), pa.array([replicas[r] for r in where], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*held.columns, *more], names=[*batch.schema.names, "range_start", "range_end", "replicas"])

    more_fields = [T.StructField("range_start", T.StringType()), T.StructField("range_end", T.StringType()), T.StructField("replicas", T.ArrayType(T.StringType()))]
    out = T.StructType([*schema.fields, *more_fields])
    return keys.filter("key is not null").mapInArrow(search, out)


def holders(scans: DataFrame, ranges: DataFrame, closed: bool) -> DataFrame:
    """For scans (id, start, end): the one range that holds all of each; scans across ranges have none.

    ``closed``: the end belongs to the scan. Otherwise an empty end is unbounded.
    """
    r = few(ranges).select(F.col("start").alias("range_start"), F.col("end").alias("range_end"), "replicas")
    inside = (F.col("range_start") == "") | (F.col("start") >= F.col("range_start"))
    if closed:
        ends = (F.col("range_end") == "") | (F.col("end") < F.col("range_end"))
    else:
        ends = (F.col("range_end") == "") | ((F.col("end") != "") & (F.col("end") <= F.col("range_end")))
    return scans.join(F.broadcast(r), inside & ends, "left")


def proposal_id(ranges: list[Range]) -> str:
    """The same for any order of ranges and replicas; generations don't count."""
    parts = [u64(len(ranges))]
    for r in sorted(ranges, key=lambda r: (r.start.encode(), r.end.encode())):
        parts += [length_prefixed(r.start, r.end), u64(len(r.replicas)), length_prefixed(*sorted(r.replicas))]
    return hashlib.sha256(b"".join(parts)).hexdigest()


def merge_maps(local: list[Range], incoming: list[Range]) -> tuple[list[Range], bool]:
    """The merged map and whether it differs from ``local``. Commutative and idempotent.

    On each piece of the key space the higher generation wins. Ranges of equal generation that differ are a tie: the
    lesser by (proposal, start, end, replicas) wins, and every piece of the winning proposal gets one generation more.
    """
    for side in (local, incoming):
        if bad := problems(side):
            raise ValueError(f"invalid range map: {', '.join(bad)}")
    cuts = sorted({r.end for r in [*local, *incoming] if r.end}, key=str.encode)
    order = lambda r: (r.proposal_id.encode(), r.start.encode(), r.end.encode(), [x.encode() for x in r.replicas])
    pieces, tied = [], set()
    for start, end in zip(["", *cuts], [*cuts, ""], strict=True):
        sides = [next((s, k, r) for k, r in enumerate(ranges) if r.contains(start)) for s, ranges in enumerate((local, incoming))]
        best = max(x[2].generation for x in sides)
        rivals = [x for x in sides if x[2].generation == best]
        side, place, won = min(rivals, key=lambda x: (order(x[2]), x[0]))
        if len(rivals) == 2 and rivals[0][2] != rivals[1][2]:
            if best == MAX_GENERATION:
                raise ValueError("a tie at the highest generation cannot be resolved")
            tied.add((side, won.proposal_id, best))
        pieces.append((side, place, replace(won, start=start, end=end)))
    merged: list[tuple[int, int, Range]] = []
    for side, place, r in pieces:
        if (side, r.proposal_id, r.generation) in tied:
            r = replace(r, generation=r.generation + 1)
        if merged and merged[-1][:2] == (side, place) and replace(merged[-1][2], start=r.start, end=r.end) == r:
            merged[-1] = (side, place, replace(merged[-1][2], end=r.end))
        else:
            merged.append((side, place, r))
    result = [r for _, _, r in merged]
    return result, result != list(local)


def overlay(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """start, end, generation, proposal_id, tied of every piece of two maps held as rows: boundaries of both, the range of each map there, and the winner."""
    cuts = local.select("end").union(incoming.select("end")).filter("end <> ''").distinct().select(F.col("end").alias("start")).union(local.sparkSession.createDataFrame([("",)], "start string"))
    pieces = cuts.withColumn("end", F.coalesce(F.lead("start").over(Window.orderBy("start")), F.lit("")))  # a row for each tablet

    def side(ranges: DataFrame, name: str) -> DataFrame:
        return F.broadcast(few(ranges).select(*[F.col(c).alias(f"{name}_{c}") for c in ("start", "end", "generation", "proposal_id")]))

    at = lambda name: within(F.col("start"), F.col(f"{name}_start"), F.col(f"{name}_end"))
    both = pieces.join(side(local, "l"), at("l")).join(side(incoming, "r"), at("r"))
    level = F.col("l_generation") == F.col("r_generation")
    differ = ~((F.col("l_proposal_id") == F.col("r_proposal_id")) & (F.col("l_start") == F.col("r_start")) & (F.col("l_end") == F.col("r_end")))
    key = lambda n: F.struct(f"{n}_proposal_id", f"{n}_start", f"{n}_end")
    won_left = (F.col("l_generation") > F.col("r_generation")) | (level & (key("l") <= key("r")))
    picked = both.select("start", "end", F.when(won_left, F.col("l_generation")).otherwise(F.col("r_generation")).alias("generation"), F.when(won_left, F.col("l_proposal_id")).otherwise(F.col("r_proposal_id")).alias("proposal_id"), (level & differ).alias("tied"))
    bumped = picked.filter("tied").select(F.col("proposal_id").alias("_p"), F.col("generation").alias("_g")).distinct()
    match = (F.col("proposal_id") == F.col("_p")) & (F.col("generation") == F.col("_g"))
    return picked.join(F.broadcast(bumped), match, "left").select("start", "end", (F.col("generation") + F.col("_p").isNotNull().cast("int")).alias("generation"), "proposal_id", "tied")


class RangeTable:
    """A held map: lookups, and merges with the maps of peers."""

    def __init__(self, ranges: list[Range]):
        if bad := problems(ranges):
            raise ValueError(f"invalid range map: {', '.join(bad)}")
        self.ranges = list(ranges)

    def epoch(self) -> int:
        return max(r.generation for r in self.ranges)

    def owners(self, key: str) -> tuple[str, ...]:
        starts = [r.start.encode() for r in self.ranges]
        return self.ranges[bisect_right(starts, key.encode()) - 1].replicas

    def is_owner(self, node: str, key: str) -> bool:
        return node in self.owners(key)

    def merge(self, incoming: list[Range]) -> bool:
        self.ranges, changed = merge_maps(self.ranges, incoming)
        return changed

    def sync(self, peers: dict[str, tuple[int, list[Range]]], seed: int = 0) -> bool:
        """Merge maps (epoch, ranges) of peers ahead of this one until one changes it, from the highest epoch on; if none does, that of one other peer, drawn by the seed."""
        ahead = sorted((p for p in peers.items() if p[1][0] > self.epoch()), key=lambda p: (-p[1][0], p[0]))
        if any(self.merge(ranges) for _, (_, ranges) in ahead):
            return True
        others = sorted(name for name, (_, ranges) in peers.items() if ranges and name not in dict(ahead))
        return bool(others) and self.merge(peers[random.Random(seed).choice(others)][1])
