"""Manifests, dump envelopes and operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..model import MANIFEST, OPERATION

# Fixed values of the envelope format.
HEADER_BYTES = 4096
MAGIC = "SIPH"

_ENVELOPE = "type string, driver string, base_id string, parent_id string, wal_start string, wal_end string, binlog_file string, binlog_start long, binlog_end long, checksum string, created string"


def good_id():
    """Ids that can't leave their folder."""
    return F.col("id").isNotNull() & (F.col("id") != "") & ~F.rlike("id", F.lit(r"[/\\]|\.\."))


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.where("_corrupt is null").drop("_corrupt").where(good_id())


def scan_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of every *.meta.json below path. Corrupt sidecars and bad ids are left out; read errors fail the job."""
    schema = StructType([*MANIFEST, StructField("_corrupt", StringType())])
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").option("columnNameOfCorruptRecord", "_corrupt")
    return _parsed(read.json(path))


def scan_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for a manifest kept as JSON lines, which suits many dumps."""
    schema = StructType([*MANIFEST, StructField("_corrupt", StringType())])
    return _parsed(spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path).select("*"))


def newest_first(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.desc("created"), "id")


def read_bodies(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(id, content) of files below path; the id is the file's name without its last ending. A file is one row, so below 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("id"), "content")


def audit_envelopes(bodies: DataFrame, magic: str = MAGIC) -> DataFrame:
    """(id, status, type, driver, base_id, parent_id, wal_end, binlog_file, binlog_end) of bodies (id, content).

    status: ok, short read, missing magic or bad json. Only the header's bytes of each body are looked at.
    """
    head = F.substring("content", 1, HEADER_BYTES)
    start = F.decode(F.substring("content", 1, len(magic)), "UTF-8")
    json = F.trim(F.decode(F.expr(f"substring(content, {len(magic) + 1}, {HEADER_BYTES - len(magic)})"), "UTF-8"))
    read = bodies.select("id", F.octet_length(head).alias("n"), (start == magic).alias("magic"), F.from_json(F.trim(F.regexp_replace(json, r"\s+$", "")), _ENVELOPE).alias("e"), json.alias("json"))
    good = F.rlike("json", F.lit(r"^\{")) & (F.coalesce("e.type", F.lit("")) != "")
    status = F.when(F.coalesce("n", F.lit(0)) < HEADER_BYTES, "short read").when(~F.coalesce("magic", F.lit(False)), "missing magic").when(~F.coalesce(good, F.lit(False)), "bad json").otherwise("ok")
    fields = ["type", "driver", "base_id", "parent_id", "wal_end", "binlog_file", "binlog_end"]
    return read.select("id", status.alias("status"), *[F.when(status == "ok", F.col(f"e.{f}")).alias(f) for f in fields])


def envelope(header_json, body, magic: str = MAGIC):
    """Content of a dump with its header: magic, JSON padded with blanks to 4,096 bytes in all, the last one a line end, then the body."""
    room = HEADER_BYTES - len(magic) - 1
    return F.concat(F.lit(magic).cast("binary"), F.rpad(header_json, room, " ").cast("binary"), F.lit("\n").cast("binary"), F.coalesce(body.cast("binary"), F.lit(b"")))


def scan_operations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPERATION).json(path)
