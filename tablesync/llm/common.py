"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_Batches = Iterator[pa.Array]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local sessions and tests) a new temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A class counts as heavy if it holds more than one in so many rows; so there are fewer heavy classes than this.
HEAVY = 10_000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, weight: str, total: int, how: str = "inner", merge: bool = False) -> DataFrame:
    """rows joined with classes, one for each value of rows' column key: columns of_<key>, weight (its number of rows) and others.

    The heavy classes, fewer than HEAVY, are broadcast, so that rows of one class stay spread; the others meet by a shuffle, which
    brings at most one in HEAVY of the total rows together for a class. how: inner or left. merge: the others are never broadcast,
    however small Spark takes them to be; for classes that may be as many as the rows.
    """
    on = F.col(key) == F.col(f"of_{key}")
    heavy, light = classes.where(F.col(weight) * HEAVY > total), classes.where(F.col(weight) * HEAVY <= total)
    light = light.hint("merge") if merge else light
    keys = F.broadcast(heavy.select(F.col(f"of_{key}").alias("heavy_key")))
    in_heavy = F.col(key) == F.col("heavy_key")
    return rows.join(keys, in_heavy, "left_semi").join(F.broadcast(heavy), on, how).unionByName(rows.join(keys, in_heavy, "left_anti").join(light, on, how))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, without Python."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows of df, in an order fixed by a hash of key: rows beyond a hash threshold go before anything is sorted, so about
    1.5 n rows meet in the last task, however many rows and partitions df has."""
    total = df.count()
    share = min(1.0, 1.5 * n / max(1, total))
    below = F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 40)) < int(share * (1 << 40))
    return df.where(below).orderBy(F.xxhash64(key), key).limit(n)


def text_udf(kind: DataType, start: Callable[[], Callable]) -> Callable[[Column], Column]:
    """A function of one text column, computed in Arrow batches; only the texts travel to Python.

    start() is called once a task and gives a function from a list of texts to an Arrow array; it sees 512 texts at a time, so a worker's
    memory doesn't hang on the size of Spark's batches.
    """
    def run(parts):
        step = start()
        for part in parts:
            done = [step(part.slice(at, 512).to_pylist()) for at in range(0, len(part), 512)] or [step([])]
            yield pa.concat_arrays(done)

    run.__annotations__ = {"parts": _Batches, "return": _Batches}
    return F.arrow_udf(run, kind).asNondeterministic()  # else a filter on the result would run it a second time
