"""Hash and byte expressions with the bit patterns of the sketches and digests; all JVM-side but xxhash64 with seed 0."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def md5_high(data: Column) -> Column:
    """The first 8 bytes of the MD5 digest as an unsigned big-endian number, decimal(20,0)."""
    return F.conv(F.substring(F.md5(data), 1, 16), 16, 10).cast("decimal(20,0)")


def md5_bits(data: Column) -> Column:
    """The same 64 bits as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(data), 1, 16), 16, 2), 64, "0")


def byte_length(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0))


def prefixed(c: Column) -> Column:
    """Length (20 digits) and text, so that joined fields cannot be mistaken for others."""
    return F.concat(F.lpad(byte_length(c).cast("string"), 20, "0"), F.coalesce(c, F.lit("")))


def u64(value: int) -> bytes:
    return struct.pack(">Q", value)


def length_prefixed(*fields: str | bytes) -> bytes:
    """Big-endian 8-byte length before each field."""
    raw = [f.encode() if isinstance(f, str) else f for f in fields]
    return b"".join(u64(len(r)) + r for r in raw)


def xxh64(*fields: str | bytes) -> int:
    """XXH64 with seed 0 over length-prefixed fields."""
    import xxhash

    return xxhash.xxh64_intdigest(length_prefixed(*fields))
