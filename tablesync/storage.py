"""Where jobs keep what must outlive an executor, and how they publish it."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published the version first."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session without one, a new temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False if there is none."""
    fs, where = _fs(spark, path)
    return fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it does not exist."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, found by one listing."""
    fs, where = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with its whole content, or return False and leave the one that is there: of writers at the same time one wins.

    The content is written beside its place. A local file then appears there by a hard link, which the system refuses where a file exists;
    elsewhere by renaming a file, which HDFS refuses in the same step as it looks. On a store without atomic renames one writer at a time
    is needed.
    """
    fs, place = _fs(spark, path)
    fs.mkdirs(place.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() != "file":
            return fs.rename(draft, place)
        nio = spark._jvm.java.nio.file.Files
        local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            nio.createLink(local(place), local(draft))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the files v0, v1 ... below a folder, oldest first."""
    return sorted(int(n[1:]) for n in names(spark, folder) if n[:1] == "v" and n[1:].isdigit())


def latest_version(spark: SparkSession, root: str) -> int:
    """The number of the newest version below root, -1 if there is none."""
    return max(versions(spark, f"{root}/versions"), default=-1)


def version_state(spark: SparkSession, root: str, version: int) -> dict:
    """What a version below root consists of."""
    return json.loads(read_text(spark, f"{root}/versions/v{version}"))


def publish_version(spark: SparkSession, root: str, version: int, state: dict) -> None:
    """Make a version below root with what it consists of; of writers at the same time one wins and the others get a Conflict."""
    if not publish(spark, f"{root}/versions/v{version}", json.dumps(state)):
        raise Conflict(f"version {version} of {root} was published by another writer")


def published_tables(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The newest version below root (-1: none yet) and the path of each of its tables."""
    version = latest_version(spark, root)
    return version, version_state(spark, root, version) if version >= 0 else {}


def publish_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write tables below root and publish a version that names them beside the ones it had: readers see all of them or none."""
    version, paths = published_tables(spark, root)
    data = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{data}/{name}")
    publish_version(spark, root, version + 1, paths | {n: f"{data}/{n}" for n in tables})
    return version + 1


def published_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(published_tables(spark, root)[1][name])
