"""Sortable log positions and job ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsn_number(lsn: Column) -> Column:
    """HI/LO hexadecimal text as decimal(20,0); text order would be wrong. Null for malformed text."""
    good = F.rlike(lsn, F.lit(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"))
    half = lambda i: F.conv(F.split(lsn, "/")[i], 16, 10).cast("decimal(20,0)")
    return F.when(good, (half(0) * F.lit(4294967296).cast("decimal(20,0)") + half(1)).cast("decimal(20,0)"))


def lsn_text(number: Column) -> Column:
    """The HI/LO text of a position."""
    n, unit = number.cast("decimal(20,0)"), F.lit(4294967296).cast("decimal(10,0)")
    high = F.floor(n / unit).cast("decimal(20,0)")
    return F.concat_ws("/", F.hex(high.cast("long")), F.hex((n - high * unit).cast("long")))


def binlog_order(file: Column, offset: Column) -> Column:
    """struct(file number, offset): the number is the digits at the end of the file's name."""
    return F.struct(F.regexp_extract(file, r"(\d+)$", 1).cast("long").alias("file_no"), offset.cast("long").alias("offset"))


def stream_job_id(source: Column, target: Column) -> Column:
    """cdc- and the first 16 hex digits of SHA-256 over source, a zero byte and target."""
    joined = F.concat(source.cast("binary"), F.lit(bytearray(1)), target.cast("binary"))
    return F.concat(F.lit("cdc-"), F.substring(F.sha2(joined, 256), 1, 16))
