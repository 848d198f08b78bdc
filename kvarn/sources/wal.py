"""Write-ahead log segments: little-endian records with a CRC, in numbered files.

Record: crc32 of all after it (4 bytes), length of what follows the first 8 bytes (4), lsn (8), op (1), key length (4),
value length (4), key, value. A torn or corrupt record ends its segment; later segments are still read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvarn.schema import DELETE, PUT

_HEAD = struct.Struct("<IIQBII")
SEGMENT_GLOB = "?????????.log"


def encode_record(lsn: int, op: int, key: bytes, value: bytes = b"") -> bytes:
    if op not in (PUT, DELETE) or (op == DELETE and value):
        raise ValueError("a record is a put, or a delete without a value")
    body = struct.pack("<QBII", lsn, op, len(key), len(value)) + key + value
    body = struct.pack("<I", len(body)) + body
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_records(data: bytes) -> Iterator[tuple[int, int, bytes, bytes] | None]:
    """Records in order; None at the end if what follows is torn or corrupt."""
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            yield None
            return
        crc, size, lsn, op, nk, nv = _HEAD.unpack_from(data, at)
        end = at + 8 + size
        if end > len(data) or size != _HEAD.size - 8 + nk + nv or zlib.crc32(data[at + 4 : end]) != crc or op not in (PUT, DELETE):
            yield None
            return
        key = data[at + _HEAD.size : at + _HEAD.size + nk]
        yield lsn, op, key, data[at + _HEAD.size + nk : end]
        at = end


def encode(rows: DataFrame, per_segment: int) -> DataFrame:
    """segment, content from (lsn, op, key, value): ``per_segment`` LSNs a segment."""

    def write(table: pa.Table) -> pa.Table:
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("lsn", "op", "key", "value", "segment")), strict=True))
        data = b"".join(encode_record(lsn, op, k.encode(), (v or "").encode()) for lsn, op, k, v, _ in got)
        return pa.table({"segment": pa.array([got[0][4]], pa.int64()), "content": pa.array([data], pa.binary())})

    cut = rows.withColumn("segment", F.floor((F.col("lsn") - 1) / per_segment).cast("long"))
    return cut.groupBy("segment").applyInArrow(write, "segment long, content binary")


def decode(segments: DataFrame) -> DataFrame:
    """segment, lsn, op, key, value, corrupt: a row for each record, and a row with ``corrupt`` where a segment ends early."""

    def read(batches):
        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = [(segment, *r, False) if r else (segment, None, None, None, None, True) for r in decode_records(data)]
                cols = list(zip(*got, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["segment", "lsn", "op", "key", "value", "corrupt"])

    raw = segments.select("segment", "content").mapInArrow(read, "segment long, lsn long, op int, key binary, value binary, corrupt boolean")
    return raw.select("segment", "lsn", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "corrupt")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the segment files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", SEGMENT_GLOB).load(folder)
    number = F.regexp_extract("path", r"([0-9]{9})\.log$", 1)
    return decode(files.filter(number != "").select(number.cast("long").alias("segment"), "content"))


def purgeable(segments: DataFrame, checkpoint: int) -> DataFrame:
    """segment numbers wholly at or below the checkpoint, but the newest."""
    top = segments.agg(F.max("segment").alias("_top"))
    ends = segments.filter("lsn is not null").groupBy("segment").agg(F.max("lsn").alias("max_lsn"))
    return ends.join(F.broadcast(top), how="cross").filter((F.col("max_lsn") <= checkpoint) & (F.col("segment") < F.col("_top"))).select("segment")
