"""Schemas and settings that the rest of the package shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

OPS = ("insert", "update", "delete")

#: A row change. An absent key of values means "not transmitted"; a present key with a null value means NULL.
CHANGE = T.StructType(
    [
        T.StructField("pos", T.DecimalType(20, 0)),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("tbl", T.StringType()),
        T.StructField("key", T.MapType(T.StringType(), T.StringType())),
        T.StructField("values", T.MapType(T.StringType(), T.StringType())),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("driver", T.StringType()),
        T.StructField("dump_format", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("base_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("size_bytes", T.LongType())]))),
        T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: One row per operation in the operation log.
OPERATION = T.StructType(
    [
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("op", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)


@dataclass(frozen=True)
class RetentionPolicy:
    """Rules of which each that is set keeps chains; all unset keeps everything."""

    keep_last: int = 0
    max_age_seconds: int = 0
    gfs_daily: int = 0
    gfs_weekly: int = 0
    gfs_monthly: int = 0

    def __post_init__(self):
        if any(v < 0 for v in vars(self).values()):
            raise ValueError("retention values can't be negative")

    @property
    def keeps_all(self) -> bool:
        return not any(vars(self).values())
