"""Op 10: a sharded table with size-tiered compaction and a versioned manifest, with DataFrame functions only.

Layout below a root: data/<job>/... holds immutable Parquet shards; lists/<name> holds, as Parquet, one row for each live shard of a version
(file, bytes, rows), and manifest/v<number> is one small file that names the version's list. It comes into being whole or not at all, and
never over another one, so of any number of writers at the same time one wins; the others must start from the new version. Readers take the
newest version, or any older one. Shards that no version names are invisible: a job that died leaves nothing but garbage for vacuum().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Conflict, publish, read_text, remove
from ..storage import versions as numbers
from .common import scratch, table

ENTRY = "file string, bytes long, rows long"
#: A plan of at most this many shards (some 20 MB) is broadcast; a larger one is joined by shuffling.
MAX_BROADCAST_SHARDS = 100_000


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed version numbers, oldest first."""
    return numbers(spark, f"{root}/manifest")


def entries(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The live shards of a version, by default the newest; none before the first commit."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(_list_of(spark, root, known[-1] if version is None else version))


def _list_of(spark: SparkSession, root: str, version: int) -> str:
    return f"{root}/lists/{read_text(spark, f'{root}/manifest/v{version}')}"


def commit(spark: SparkSession, root: str, live: DataFrame, base: int) -> int:
    """Make live the version after base, atomically; a Conflict if another writer was first."""
    name = uuid.uuid4().hex
    live.select("file", "bytes", "rows").coalesce(8).write.parquet(f"{root}/lists/{name}")
    if not publish(spark, f"{root}/manifest/v{base + 1}", name):
        remove(spark, f"{root}/lists/{name}")
        raise Conflict(f"version {base + 1} exists")
    return base + 1


def _written_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """Entries of the shards just written below path, from the files themselves."""
    files = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return files.select("_metadata.file_path", "_metadata.file_size").groupBy(F.col("file_path").alias("file")).agg(F.max("file_size").alias("bytes"), F.count("*").alias("rows"))


def append(df: DataFrame, root: str, *, shard_rows: int = 4000, codec: str = "zstd") -> int:
    """Write an arrival as shards of at most shard_rows rows, as its partitions lie (no shuffle), and commit them; the version's number.

    Rows are kept as they are: nulls in any column, empty and long texts, repeats, and columns of any name. An arrival without rows
    commits a version without a new shard.
    """
    spark = df.sparkSession
    base = max(versions(spark, root), default=0)
    path = f"{root}/data/append-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", shard_rows).option("compression", codec).parquet(path)
    return commit(spark, root, entries(spark, root).unionByName(_written_shards(spark, path, df.schema)), base)


def plan_merges(live: DataFrame, target_bytes: int, fan_in: int) -> DataFrame:
    """(file, bytes, rows, tier, merge): shards of one merge become one file; merge is null for shards that stay.

    Shards below the target fall into tiers by size, each fan_in times as large as the one before. Within a tier they queue by size and
    name and every target_bytes of them are a merge; what is left over is one if it has fan_in shards or more. A tier's window holds the
    names of its shards, not their rows.
    """
    tier = F.floor(F.log(float(fan_in), F.greatest("bytes", F.lit(1)) / F.lit(4096.0))).cast("int")
    small = live.where(F.col("bytes") < target_bytes).withColumn("tier", F.greatest(tier, F.lit(0)))
    queue = Window.partitionBy("tier").orderBy("bytes", "file").rowsBetween(Window.unboundedPreceding, -1)
    dealt = small.withColumn("turn", F.floor(F.coalesce(F.sum("bytes").over(queue), F.lit(0)) / target_bytes))
    peers = Window.partitionBy("tier", "turn")
    full = (F.count("*").over(peers) >= fan_in) | ((F.sum("bytes").over(peers) >= 0.75 * target_bytes) & (F.count("*").over(peers) > 1))
    planned = dealt.withColumn("merge", F.when(full, F.concat_ws("-", "tier", "turn"))).select("file", "bytes", "rows", "tier", "merge")
    return planned.unionByName(live.where(F.col("bytes") >= target_bytes).select("file", "bytes", "rows", F.lit(None).cast("int").alias("tier"), F.lit(None).cast("string").alias("merge")))


def compact(spark: SparkSession, root: str, schema, *, target_bytes: int = 128 << 20, fan_in: int = 4, codec: str = "zstd") -> int:
    """Merge once what plan_merges names and commit; the newest version if there is nothing to merge.

    Each row is moved once, to the task of its merge, which writes one file. Old shards stay for readers of older versions, until vacuum().
    Rows are kept as they are (see append); no shards, or none to merge: no new version. If another writer commits meanwhile: a Conflict.
    """
    base = max(versions(spark, root), default=0)
    plan = plan_merges(entries(spark, root), target_bytes, fan_in).persist()
    try:
        todo = plan.where("merge is not null")
        counts = todo.agg(F.count("*").alias("shards"), F.count_distinct("merge").alias("merges"), F.max("bytes").alias("largest")).first()
        if not counts["merges"]:
            return base
        path = f"{root}/data/merge-{uuid.uuid4().hex}"
        numbers = todo.select(F.col("merge").alias("n_merge")).distinct().withColumn("no", F.row_number().over(Window.orderBy("n_merge")) - 1)
        lookup = todo.join(numbers, F.col("merge") == F.col("n_merge")).select(F.col("file").alias("of_file"), "no")
        lookup = F.broadcast(lookup) if counts["shards"] <= MAX_BROADCAST_SHARDS else lookup
        # the driver holds the names of live shards, as Spark's own file listing does
        rows = spark.read.schema(schema).parquet(*[r.file for r in todo.select("file").toLocalIterator()])
        names = rows.columns
        rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("_metadata.file_path").alias("file")).join(lookup, F.col("file") == F.col("of_file"))
        dealt = rows.select("row", "no").repartitionById(counts["merges"], "no")  # a hash would send several merges to one task
        key = f"merge_{uuid.uuid4().hex[:8]}"  # clashes with no column
        dealt.select(*[F.col(f"row.`{c}`") for c in names], F.col("no").alias(key)).write.partitionBy(key).option("compression", codec).parquet(path)
        live = plan.where("merge is null").select("file", "bytes", "rows").unionByName(_written_shards(spark, path, schema))
        return commit(spark, root, live, base)
    finally:
        plan.unpersist()


def read(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version."""
    files = [r.file for r in entries(spark, root, version).select("file").toLocalIterator()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str, keep_versions: int = 2) -> int:
    """Forget all but the newest versions and delete shards that none of those names. Returns how many shards went."""
    known = versions(spark, root)
    kept, old = known[-keep_versions:], known[:-keep_versions]
    if not old:
        return 0
    live = {r.file for v in kept for r in entries(spark, root, v).select("file").toLocalIterator()}
    gone = {r.file for v in old for r in entries(spark, root, v).select("file").toLocalIterator()} - live
    for v in old:
        entries_of = _list_of(spark, root, v)
        remove(spark, f"{root}/manifest/v{v}")
        remove(spark, entries_of)
    for file in gone:
        remove(spark, file)
    return len(gone)


def op10_compaction(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """All documents, appended in arrivals dealt by a hash, compacted, and read from the last version."""
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "shards")
    for i in range(arrivals):
        append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i), root)
    compact(spark, root, docs.schema)
    return read(spark, root, docs.schema).select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


ORACLE = "SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents"
