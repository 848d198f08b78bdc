"""Bloom and prefix Bloom filters, count-min, HyperLogLog, SimHash and Merkle trees as tables and aggregations."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvarn.functions.bytes_and_hashes import md5_bits, md5_high, prefixed, utf8

MAX_PREFIX, MAX_KNOWN = 128, 100_000


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for ``n`` entries and a false-positive rate."""
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def _seeded(data: Column, seed: Column) -> Column:
    """md5(data, big-endian 4-byte seed), its upper half."""
    return md5_high(F.concat(utf8(data), F.unhex(F.lpad(F.hex(seed), 8, "0"))))


def bloom_positions(entries: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """Each entry with its ``k`` bit numbers (``bit``)."""
    seeds = entries.withColumn("_seed", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return seeds.withColumn("bit", (_seeded(F.col(column), F.col("_seed").cast("long")) % m).cast("long")).drop("_seed")


def bloom(entries: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The set bits."""
    return bloom_positions(entries.select(column).distinct(), column, m, k).select("bit").distinct()


def bloom_contains(filter_bits: DataFrame, probes: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """column, maybe: whether all bits of a probe are set."""
    asked = bloom_positions(probes.select(column).distinct(), column, m, k)
    hit = asked.join(filter_bits.withColumn("_set", F.lit(1)), "bit", "left")
    return hit.groupBy(column).agg((F.count("*") == F.count("_set")).alias("maybe"))


def prefixes(entries: DataFrame, column: str, out: str = "prefix", longest: int = MAX_PREFIX) -> DataFrame:
    """All distinct prefixes of 1 to ``longest`` characters."""
    own = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(column))), lambda n: F.substring(F.col(column), F.lit(1), n))
    return entries.filter(F.length(column) > 0).select(F.explode(own).alias(out)).distinct()


def prefix_probe(prefix: Column, longest: int = MAX_PREFIX) -> Column:
    """What is asked for a prefix: longer ones are cut. An empty one may always be there."""
    return F.substring(prefix, F.lit(1), F.lit(longest))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def cms_cells(entries: DataFrame, column: str, w: int, d: int) -> DataFrame:
    """Each entry with its cell in each row: ``row``, ``cell``."""
    rows = entries.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    seed = (F.col("row") + 1).cast("long") * F.lit(0x9E3779B9) % F.lit(1 << 32)
    return rows.withColumn("cell", (_seeded(F.col(column), seed) % w).cast("long"))


def cms(entries: DataFrame, column: str, w: int, d: int) -> DataFrame:
    """row, cell, n. Equal entries are counted before they are hashed."""
    counted = entries.groupBy(column).agg(F.count("*").alias("_n"))
    return cms_cells(counted, column, w, d).groupBy("row", "cell").agg(F.sum("_n").alias("n"))


def cms_estimate(sketch: DataFrame, probes: DataFrame, column: str, w: int, d: int) -> DataFrame:
    """column, estimate: the least of an entry's cells."""
    asked = cms_cells(probes.select(column).distinct(), column, w, d)
    return asked.join(sketch, ["row", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hll_precision(error: float) -> int:
    p = math.ceil(math.log2((1.04 / error) ** 2))
    if not 4 <= p <= 16:
        raise ValueError("precision must be between 4 and 16")
    return p


def hll(entries: DataFrame, column: str, p: int, by: list[str] | None = None) -> DataFrame:
    """by, idx, register: the highest rank of each index; mergeable by maximum."""
    bits = md5_bits(utf8(F.col(column)))
    hashed = entries.select(*(by or []), bits.alias("_b")).distinct()
    rest = F.concat(F.substring("_b", p + 1, 64), F.lit("1"))
    return hashed.select(*(by or []), F.conv(F.substring("_b", 1, p), 2, 10).cast("int").alias("idx"), F.instr(rest, "1").alias("rank")).groupBy(*(by or []), "idx").agg(F.max("rank").alias("register"))


def hll_estimate(registers: DataFrame, p: int, by: list[str] | None = None) -> DataFrame:
    """by, estimate: linear counting while small, the large-range correction above 2^32 / 30."""
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.groupBy(*(by or [])).agg(F.count("*").alias("_set"), F.sum(F.pow(F.lit(2.0), -F.col("register"))).alias("_s"))
    zeros = F.lit(m) - F.col("_set")
    raw = F.lit(alpha * m * m) / (F.col("_s") + zeros)
    small = (raw <= 2.5 * m) & (zeros > 0)
    large = F.lit(-(2.0**32)) * F.ln(F.greatest(F.lit(1e-300), 1 - raw / 2.0**32))
    value = F.when(small, F.lit(float(m)) * F.ln(F.lit(float(m)) / F.when(zeros > 0, zeros).otherwise(1))).when(raw > 2.0**32 / 30, large).otherwise(raw)
    return sums.select(*(by or []), F.floor(value).cast("long").alias("estimate"))


def simhash(texts: DataFrame, key: str, text: str, separator: str = " ") -> DataFrame:
    """key, fingerprint of each row's tokens (the parts of ``text`` between separators): 64 bits as text, 1 where more token hashes have 1 than 0. Every token counts
    as often as it stands; rows without tokens have none. Made where the row is read: nothing is shuffled."""

    def run(batches):
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            ids, prints = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                count = Counter(x for x in (t or "").split(separator) if x)
                if not count:
                    continue
                if len(known) > MAX_KNOWN:
                    known.clear()
                for x in count:
                    if x not in known:
                        known[x] = np.unpackbits(np.frombuffer(hashlib.md5(x.encode()).digest()[:8], dtype=np.uint8))
                ones = np.array(list(count.values())) @ np.array([known[x] for x in count], dtype=np.int64)
                ids.append(i)
                prints.append("".join("1" if v else "0" for v in 2 * ones > sum(count.values())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(prints, pa.string())], names=[key, "fingerprint"])

    rows = texts.select(key, text)
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("fingerprint", T.StringType())]))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    halves = [F.bit_count(F.conv(F.substring(a, s, 32), 2, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, s, 32), 2, 10).cast("long"))) for s in (1, 33)]
    return halves[0] + halves[1]


def similar(a: Column, b: Column, threshold: int) -> Column:
    if not 0 <= threshold <= 64:
        raise ValueError("threshold must be between 0 and 64")
    return hamming(a, b) <= threshold


def fingerprint_groups(prints: DataFrame, key: str) -> DataFrame:
    """key, representative: the least key of those with an equal fingerprint."""
    least = prints.groupBy("fingerprint").agg(F.min(key).alias("representative"))
    return prints.join(least, "fingerprint").select(key, "representative")


def near_fingerprints(prints: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """a, b, distance of representatives (see ``fingerprint_groups``) whose fingerprints differ in at most ``threshold`` bits.

    Prints are cut into ``threshold + 3`` blocks. Differing bits are in at most ``threshold`` of these, so two near prints agree in three
    blocks at least; each print is indexed under every three blocks, keys of 32 bits and more for a threshold of 3, so that few prints meet by chance.
    """
    reps = prints.groupBy("fingerprint").agg(F.min(key).alias("id"))
    blocks = threshold + 3
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.substring("fingerprint", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = F.array(*[F.struct(F.lit(i).alias("chosen"), F.concat(*[part[k] for k in some]).alias("part")) for i, some in enumerate(combinations(range(blocks), 3))])
    rows = reps.select("id", "fingerprint", F.explode(keys).alias("_x")).select("id", "fingerprint", "_x.chosen", "_x.part")
    other = rows.select(F.col("id").alias("b"), F.col("fingerprint").alias("_f"), "chosen", "part")
    met = rows.join(other, ["chosen", "part"]).filter("id < b").withColumn("distance", hamming(F.col("fingerprint"), F.col("_f")).cast("int"))
    return met.filter(F.col("distance") <= threshold).select(F.col("id").alias("a"), "b", "distance").distinct()


def merkle_leaves(rows: DataFrame, by: str, chunk_chars: int = 12) -> DataFrame:
    """by, idx, hash: leaves of length-prefixed key and value, numbered in key order: by ranks within chunks of keys that share their first characters, and a running count of chunks."""
    own = F.sha2(F.concat(prefixed(F.col("key")), prefixed(F.col("value"))), 256)
    cut = rows.select(by, "key", own.alias("hash"), F.substring("key", 1, chunk_chars).alias("_chunk"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    starts = cut.groupBy(by, "_chunk").count().select(by, "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_own", F.row_number().over(Window.partitionBy(by, "_chunk").orderBy("key")) - 1)
    return ranked.join(starts, [by, "_chunk"]).select(by, (F.col("_before") + F.col("_own")).alias("idx"), "hash")


def merkle_root(leaves: DataFrame, by: str, most: int = 2) -> DataFrame:
    """by, root of trees for ``most`` leaves, or more if any tree has more: pairs are hashed level by level; a missing right child is empty text."""
    level, most = leaves, max(2, most, 1 + (leaves.agg(F.max("idx")).first()[0] or 0))
    for _ in range(math.ceil(math.log2(most))):
        pair = F.concat_ws("", F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))))
        level = level.groupBy(by, F.floor(F.col("idx") / 2).alias("_i")).agg(F.sha2(pair, 256).alias("hash")).select(by, F.col("_i").alias("idx"), "hash")
    return level.select(by, F.col("hash").alias("root"))


def save(sketch: DataFrame, path: str, **about: int | float | str) -> None:
    """Write a sketch (a filter's bits, a sketch's cells or registers, fingerprints, tree levels) with its kind and sizes."""
    sketch.write.parquet(f"{path}/rows")
    sketch.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in about.items()], "name string, value string").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str, **about: int | float | str) -> tuple[DataFrame, dict]:
    """A saved sketch and its sizes; sizes given must be those saved, as sketches of other sizes cannot be asked or merged."""
    saved = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/about").collect()}
    if other := {k: saved.get(k) for k, v in about.items() if saved.get(k) != v}:
        raise ValueError(f"saved with {other}")
    return spark.read.parquet(f"{path}/rows"), saved
