"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DELETE = 1, 2
KV = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
LOG = T.StructType([T.StructField("lsn", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
CLOCK = T.MapType(T.StringType(), T.DecimalType(20, 0))
ENVELOPE = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("vector_clock", CLOCK),
        T.StructField("updated_at_unix_nano", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("value", T.StringType()),
    ]
)
RANGE = T.StructType(
    [
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("replicas", T.ArrayType(T.StringType())),
        T.StructField("generation", T.DecimalType(20, 0)),
        T.StructField("proposal_id", T.StringType()),
    ]
)
MEMBER = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("advertise_addr", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("incarnation", T.LongType()),
        T.StructField("last_seen", T.LongType()),
        T.StructField("membership_epoch", T.LongType()),
        T.StructField("range_map_epoch", T.LongType()),
    ]
)
