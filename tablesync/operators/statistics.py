"""Table statistics and operation counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows), exact; a count reads no column."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_files(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, size_bytes) from the metadata of the files that hold each table."""
    parts = [df.select(F.lit(name).alias("name"), "_metadata.file_path", "_metadata.file_size").groupBy("name", "file_path").agg(F.max("file_size").alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.sum("n").alias("size_bytes"))


def inspect(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(name, rows, size_bytes), largest first; unknown or negative numbers are 0."""
    s = sizes.select(F.col("name").alias("s_name"), "size_bytes")
    met = rows.join(s, F.col("name") == F.col("s_name"), "left")
    return met.select("name", clamp(F.col("rows")).alias("rows"), clamp(F.col("size_bytes")).alias("size_bytes")).orderBy(F.desc("size_bytes"), "name")


def operation_counters(operations: DataFrame) -> DataFrame:
    """(op, operations, errors, duration_ms): nothing that identifies anyone is kept."""
    return operations.groupBy("op").agg(F.count("*").alias("operations"), F.count_if(F.col("outcome") == "error").alias("errors"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
