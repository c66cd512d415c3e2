"""Row changes: filters, validation, key and set columns, typing, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.positions import binlog_order, lsn_number
from ..model import OPS


def only_tables(changes: DataFrame, tables: list[str], column: str = "tbl") -> DataFrame:
    """Changes of the named tables, matched exactly; no names: all."""
    return changes.where(F.col(column).isin(*tables)) if tables else changes


def key_columns(key: str = "key") -> Column:
    return F.array_sort(F.map_keys(key))


def set_columns(key: str = "key", values: str = "values") -> Column:
    """Columns that an update sets: those of the post-image that are no key columns, sorted."""
    return F.array_sort(F.array_except(F.map_keys(values), F.map_keys(key)))


def reject_reason() -> Column:
    """Why a change can't be applied, null if it can."""
    no_key = F.coalesce(F.size("key"), F.lit(0)) < 1
    return (
        F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown operation")
        .when(F.col("op").isin("update", "delete") & no_key, "missing primary key")
        .when((F.col("op") == "update") & (F.size(F.coalesce(set_columns(), F.array().cast("array<string>"))) < 1), "nothing to set")
        .when((F.col("op") == "insert") & (F.coalesce(F.size("values"), F.lit(0)) < 1), "insert without columns")
    )


def rejects(changes: DataFrame) -> DataFrame:
    return changes.withColumn("reason", reject_reason()).where("reason is not null")


def valid(changes: DataFrame, mode: str = "fail") -> DataFrame:
    """Changes that can be applied. mode 'fail': reading a bad one raises an error; 'quarantine': bad ones are left out (see rejects)."""
    if mode == "quarantine":
        return changes.where(reject_reason().isNull())
    if mode != "fail":
        raise ValueError(f"unknown mode {mode}")
    told = F.concat(F.lit("bad change at seq "), F.col("seq").cast("string"), F.lit(": "), reject_reason())
    return changes.where(F.when(reject_reason().isNull(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))


def key_change_count(changes: DataFrame) -> DataFrame:
    """Updates whose post-image has another key; the key is not written, so these deserve a look."""
    moved = F.exists(F.map_entries("key"), lambda e: F.map_contains_key("values", e["key"]) & ~F.element_at("values", e["key"]).eqNullSafe(e["value"]))
    return changes.where((F.col("op") == "update") & moved).groupBy("tbl").agg(F.count("*").alias("key_changes"))


def typed(value: Column, schema: StructType, name: str) -> Column:
    """Text of a change as the column's type; null if it can't be cast."""
    return value.try_cast(schema[name].dataType)


def bounded(changes: DataFrame, since, stop) -> DataFrame:
    """Changes behind since, up to and with stop, on the numeric column pos. A missing since is an error."""
    if since is None:
        raise ValueError("a bounded capture needs the position to start behind")
    return changes.where((F.col("pos") > since) & (F.col("pos") <= stop))


def bounded_lsn(changes: DataFrame, since: str, stop: str, column: str = "lsn") -> DataFrame:
    """The same on HI/LO text positions."""
    if not since:
        raise ValueError("a bounded capture needs the position to start behind")
    at = lsn_number(F.col(column))
    return changes.where((at > lsn_number(F.lit(since))) & (at <= lsn_number(F.lit(stop))))


def bounded_binlog(changes: DataFrame, since: tuple[int, int], stop: tuple[int, int], file: str = "file", offset: str = "offset") -> DataFrame:
    """The same on (file number, offset)."""
    if since is None:
        raise ValueError("a bounded capture needs the position to start behind")
    at = binlog_order(F.col(file), F.col(offset))
    place = lambda p: F.struct(F.lit(p[0]).cast("long").alias("file_no"), F.lit(p[1]).cast("long").alias("offset"))
    return changes.where((at > place(since)) & (at <= place(stop)))


def applied_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("tbl", "op").agg(F.count("*").alias("applied"))


def running_applied(changes: DataFrame, stream: str = "tbl", block: int = 10_000) -> DataFrame:
    """changes with running, the number of changes of the same stream up to each, in order of seq.

    Two steps keep a hot stream spread: rows are numbered within blocks of seq, and the blocks' counts are summed up before.
    """
    blocked = changes.withColumn("_block", F.floor(F.col("seq") / block))
    ahead = Window.partitionBy(stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(stream, "_block").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = Window.partitionBy(stream, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumn("_in", F.sum(F.lit(1)).over(inside)).join(sums, [stream, "_block"])
    return out.withColumn("running", F.col("_ahead") + F.col("_in")).drop("_block", "_ahead", "_in")
