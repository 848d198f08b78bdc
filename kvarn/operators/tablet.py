"""Sizes, byte-balanced splits, merges and placement of tablets (key ranges)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvarn.functions.bytes_and_hashes import xxh64

from .ring import Range, proposal_id


def entry_bytes():
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def sizes(entries: DataFrame, tablet: str = "tablet") -> DataFrame:
    """tablet, n, bytes."""
    return entries.groupBy(tablet).agg(F.count("*").alias("n"), F.sum(entry_bytes()).alias("bytes"))


def split_boundaries(entries: DataFrame, tablet: str = "tablet", chunk_chars: int = 6) -> DataFrame:
    """tablet, boundary: the key before which the bytes are nearest to half, the first of equally near ones. Tablets with fewer than two keys have none.

    Keys are summed first, then in chunks by their leading characters; only chunk totals are summed across a tablet, so
    no task sorts a whole tablet.
    """
    keys = entries.groupBy(tablet, "key").agg(F.sum(entry_bytes()).alias("b")).withColumn("_c", F.substring("key", 1, chunk_chars))
    chunks = keys.groupBy(tablet, "_c").agg(F.sum("b").alias("_cb"))
    over = Window.partitionBy(tablet).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(tablet, "_c", F.coalesce(F.sum("_cb").over(over), F.lit(0)).alias("_start"), F.sum("_cb").over(Window.partitionBy(tablet)).alias("_all"))
    own = F.sum("b").over(Window.partitionBy(tablet, "_c").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    at = keys.withColumn("_own", F.coalesce(own, F.lit(0))).join(chunks, [tablet, "_c"])
    passed = F.col("_start") + F.col("_own")
    far = at.filter(passed > 0).withColumn("_far", F.abs(F.col("_all") - 2 * passed))
    return far.groupBy(tablet).agg(F.min_by("key", F.struct("_far", "key")).alias("boundary"))


def merge_candidates(tablets: DataFrame, merge_bytes: int) -> DataFrame:
    """left_start, right_start, bytes of neighbours that are both small enough; tablets (start, bytes)."""
    w = Window.orderBy("start")  # a row for each tablet
    pairs = tablets.select("start", "bytes", F.lead("start").over(w).alias("right_start"), F.lead("bytes").over(w).alias("_rb"))
    return pairs.filter(F.col("right_start").isNotNull() & (F.col("bytes") <= merge_bytes) & (F.col("_rb") <= merge_bytes)).select(F.col("start").alias("left_start"), "right_start", (F.col("bytes") + F.col("_rb")).alias("bytes"))


def settled(observations: DataFrame, ticks: int) -> DataFrame:
    """range, tick, run, settled: consecutive ticks at which a range had the same generation; observations (range, tick, generation)."""
    w = Window.partitionBy("range").orderBy("tick")
    new = (F.lag("generation").over(w).isNull() | (F.lag("generation").over(w) != F.col("generation")) | (F.col("tick") != F.lag("tick").over(w) + 1)).cast("int")
    islands = observations.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    run = F.row_number().over(Window.partitionBy("range", "_island").orderBy("tick"))
    return islands.select("range", "tick", run.alias("run"), (run >= ticks).alias("settled"))


class UnsafePlacement(ValueError):
    """Too few of the previous replicas are among the candidates."""


def assign_replicas(start: str, end: str, candidates: list[str], previous: list[str], count: int, score=xxh64) -> list[str]:
    """Rendezvous placement by score; all but one of the previous replicas stay (the one, if there is only one)."""
    ranked = sorted({c for c in candidates if c}, key=lambda n: (-score(start, end, n), n.encode()))
    if not 1 <= count <= len(ranked):
        raise ValueError("replica count must be between 1 and the number of candidates")
    must = max(1, count - 1)
    stay = [n for n in ranked if n in set(previous)][:must]
    if len(stay) < must:
        raise UnsafePlacement(f"{must} previous replicas must stay, {len(stay)} can")
    chosen = {*stay, *[n for n in ranked if n not in stay][: count - len(stay)]}
    return [n for n in ranked if n in chosen]


def placements(ranges: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """start, end, node_id, position: the ``count`` best nodes of each range by a JVM-side hash score; for many ranges at once."""
    pairs = ranges.select("start", "end").join(F.broadcast(nodes.select("node_id").distinct()), how="cross")  # nodes of a cluster
    ranked = F.row_number().over(Window.partitionBy("start", "end").orderBy(F.desc(F.md5(F.concat_ws("\x1f", "start", "end", "node_id"))), "node_id"))
    return pairs.withColumn("position", ranked).filter(F.col("position") <= count)


def plan_tick(ranges: list[Range], sizes_by_start: dict[str, int], settled_starts: set[str], node: str, alive: list[str], boundaries: dict[str, str], split_bytes: int, merge_bytes: int, count: int) -> list[Range] | None:
    """The map after one tick, or None: the first owned settled range that is too large splits, else the first small neighbours with common replicas merge."""
    def proposed(new: list[Range], keep: list[Range]) -> list[Range]:
        pid = proposal_id(new)
        return sorted([*keep, *[replace(r, proposal_id=pid) for r in new]], key=lambda r: r.start.encode())

    mine = [r for r in ranges if node in r.replicas and r.start in settled_starts]
    for r in mine:
        cut = boundaries.get(r.start)
        if sizes_by_start.get(r.start, 0) >= split_bytes and cut:
            halves = []
            for a, b in ((r.start, cut), (cut, r.end)):
                try:
                    halves.append(Range(a, b, tuple(assign_replicas(a, b, alive, list(r.replicas), count)), r.generation + 1))
                except ValueError:
                    break
            if len(halves) == 2:
                return proposed(halves, [x for x in ranges if x != r])
    for a, b in zip(ranges, ranges[1:], strict=False):
        small = all(sizes_by_start.get(x.start, split_bytes) <= merge_bytes for x in (a, b))
        common = [n for n in a.replicas if n in b.replicas]
        if a in mine and b in mine and small and common:
            try:
                to = assign_replicas(a.start, b.end, alive, common, count)
            except ValueError:
                continue
            return proposed([Range(a.start, b.end, tuple(to), max(a.generation, b.generation) + 1)], [x for x in ranges if x not in (a, b)])
    return None
