"""Tables stored by buckets of their key, so that a join on the key meets them where they lie."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def default_buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions: with fewer, Spark would rather shuffle a bucketed table than join it as it lies."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """df as Parquet below path, one sorted file for each bucket."""
    name = f"written_{uuid.uuid4().hex}"
    by = [f"`{k}`" for k in keys]
    df.repartition(buckets, *by).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # its files stay: the table was external


def read_bucketed(spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int) -> DataFrame:
    """What write_bucketed left below path; the session knows it by a name that follows from the path."""
    name = f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}' CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS")
    return spark.table(name)
