"""Continuous apply of a change log to a set of tables, each with a schema and a key of its own.

A version of the target is one small file. It names, for each table, the bucketed files of its base, and the batches that lie on top of the
bases. A batch is written once, for all tables, beside its rejects and is then published with the next version; readers merge a table's
changes into its base. So a batch costs what it holds, whatever the size of the tables; after merge_every batches the tables that these
touched are merged and rewritten, in one version again. A failed batch leaves nothing that readers see.

A version also records what it holds: the batch, the stream that the batch belongs to, and the last position. A batch that is delivered
again finds itself applied; another stream (a new checkpoint) replays from that position on, which changes nothing that was applied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.positions import stream_job_id
from ..model import CHANGE
from ..operators.apply import merge
from ..operators.changes import only_tables, reject_reason
from ..sources.bucketed import default_buckets, read_bucketed, write_bucketed
from ..sources.rows import read_log
from ..storage import latest_version, names, publish_version, read_text, version_state

#: A batch below its folder: kind is applied or rejected.
_BATCH = StructType([f for f in CHANGE if f.name != "tbl"]).add("reason", "string").add("kind", "string").add("tbl", "string")


@dataclass(frozen=True)
class Table:
    """How the target keeps a table."""

    schema: StructType
    keys: list[str]


class Target:
    """Keyed tables below root whose versions are published together."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], *, buckets: int | None = None, merge_every: int = 8):
        """buckets holds for bases that are written from now on; bases that exist keep their number."""
        self.spark, self.root, self.tables, self.merge_every = spark, root.rstrip("/"), tables, merge_every
        self.buckets = buckets or default_buckets(spark)

    def version(self) -> int:
        return latest_version(self.spark, self.root)

    def _state(self, version: int | None = None) -> dict:
        """bases (path and buckets by table), pending and rejects (paths of batches), stream, batch_id, start (the position captured before
        the snapshots), pos (the last one applied), applied and rejected (numbers of changes so far)."""
        state = version_state(self.spark, self.root, self.version() if version is None else version)
        return state | {k: None if state[k] is None else Decimal(state[k]) for k in ("start", "pos")}

    def _publish(self, version: int, state: dict) -> None:
        publish_version(self.spark, self.root, version, state | {k: None if state[k] is None else str(int(state[k])) for k in ("start", "pos")})

    def _base(self, name: str, rows: DataFrame) -> dict:
        table, path = self.tables[name], f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        write_bucketed(rows.select(*table.schema.names), path, table.keys, self.buckets)
        return {"path": path, "buckets": self.buckets}

    def create(self, snapshots: dict[str, DataFrame], pos) -> None:
        """Version 0 from a snapshot of each table. pos was captured before they were taken: changes behind pos are replayed on top."""
        if set(snapshots) != set(self.tables):
            raise ValueError("there must be a snapshot of each table")
        bases = {name: self._base(name, rows) for name, rows in snapshots.items()}
        self._publish(0, {"bases": bases, "pending": [], "rejects": [], "stream": "", "batch_id": -1, "start": pos, "pos": pos, "applied": 0, "rejected": 0})

    def _changes(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _BATCH)
        parts = [self.spark.read.schema(_BATCH).parquet(p) for p in paths]  # fewer than merge_every, or batches with rejects
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _read(self, name: str, state: dict) -> DataFrame:
        table, base = self.tables[name], state["bases"][name]
        rows = read_bucketed(self.spark, base["path"], table.schema, table.keys, base["buckets"])
        if not state["pending"]:
            return rows
        mine = self._changes(state["pending"]).where((F.col("kind") == "applied") & (F.col("tbl") == name))
        return merge(rows, mine.select(*CHANGE.names), table.keys)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, by default the newest."""
        return self._read(name, self._state(version))

    def rejected(self, version: int | None = None) -> DataFrame:
        """The changes that were set aside, with the reason of each."""
        return self._changes(self._state(version)["rejects"]).where("kind = 'rejected'").select(*CHANGE.names, "reason")

    def counts(self, version: int | None = None) -> tuple[int, int]:
        """How many changes were applied and rejected."""
        state = self._state(version)
        return state["applied"], state["rejected"]

    def position(self) -> tuple:
        """The last position applied, and the batch and stream that brought it."""
        state = self._state()
        return state["pos"], state["batch_id"], state["stream"]

    def apply(self, changes: DataFrame, batch_id: int, stream: str = "", mode: str = "fail") -> None:
        """Add a batch of a stream and publish the next version; a batch of the same stream that is already in it is left alone.

        A change of a table that the target doesn't keep, or that can't be applied, is an error; in mode 'quarantine' it is set aside,
        in the same version. Batch numbers count within a stream. The first batches of another one are replayed from the last position
        applied, that position included, for it may have been applied in part; replaying what was applied gives the same rows.
        """
        if mode not in ("fail", "quarantine"):
            raise ValueError(f"unknown mode {mode}")
        version = self.version()
        state = self._state(version)
        start, pos, other = state["start"], state["pos"], stream != state["stream"] and state["stream"] != ""
        if stream == state["stream"] and batch_id <= state["batch_id"]:
            return
        if start is not None:  # what the snapshots hold may be spread over any number of batches
            changes = changes.where(F.col("pos") > F.lit(start))
        if other and pos is not None:
            changes = changes.where(F.col("pos") >= F.lit(pos))
        reason = F.when(F.col("tbl").isin(*self.tables), reject_reason()).otherwise(F.lit("unknown table"))
        if mode == "fail":
            told = F.concat(F.lit("bad change at seq "), F.col("seq").cast("string"), F.lit(": "), reason)
            reason = F.when(reason.isNotNull(), F.raise_error(told).cast("string"))
        seen, path = Observation(f"batch-{uuid.uuid4().hex}"), f"{self.root}/data/batch-{batch_id}-{uuid.uuid4().hex}"
        marked = changes.select(*CHANGE.names, reason.alias("reason")).withColumn("kind", F.when(F.col("reason").isNull(), "applied").otherwise("rejected"))
        counted = marked.observe(seen, F.count_if(F.col("kind") == "applied").alias("applied"), F.count_if(F.col("kind") == "rejected").alias("rejected"), F.max("pos").alias("last"))
        counted.write.partitionBy("kind", "tbl").parquet(path)
        got = seen.get
        # a replay that has not yet come behind what the last stream applied: this stream's next batch is to be cut in the same way
        replayed = other and (got["last"] is None or got["last"] <= pos)
        if replayed and not got["applied"] + got["rejected"]:
            return
        after = state | {"pos": max((p for p in (pos, got["last"]) if p is not None), default=None)}
        if not replayed:
            after |= {"stream": stream, "batch_id": batch_id}
        after |= {"applied": state["applied"] + got["applied"], "rejected": state["rejected"] + got["rejected"]}
        after["pending"] = state["pending"] + [path] * bool(got["applied"])
        after["rejects"] = state["rejects"] + [path] * bool(got["rejected"])
        self._publish(version + 1, after)
        if len(after["pending"]) >= self.merge_every:
            self.compact()

    def compact(self) -> None:
        """Merge what lies on top of the bases into those that it touches, as the next version."""
        version = self.version()
        state = self._state(version)
        touched = {r.tbl for r in self._changes(state["pending"]).where("kind = 'applied'").select("tbl").distinct().collect()}  # table names
        bases = {name: self._base(name, self._read(name, state)) for name in self.tables if name in touched}
        self._publish(version + 1, state | {"bases": state["bases"] | bases, "pending": []})


def change_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A change log's files as a stream, oldest first; max_files_per_trigger limits what a batch reads.

    Files are to be written in the order of the positions they hold, for a batch holds the files of a time.
    """
    reader = spark.readStream.schema(CHANGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def apply_stream(stream: DataFrame, target: Target, checkpoint: str, *, tables: list[str] = (), mode: str = "fail", stop=None, available_now: bool = True, trigger: str | None = None):
    """Start the query that applies a stream. tables: those to follow, changes of any others are left out; by default all that the log holds,
    and then a table that the target doesn't keep is an error. Restarted with the same checkpoint the query goes on where it stopped, with
    another one behind what the target holds.

    stop: the last position to apply. It may lie within a file, of which a later run then needs the rest; so a bounded run has a checkpoint
    of its own below the given one, and the next run, with another stop or none, goes on behind the position that the target records.
    """
    spark, checkpoint = target.spark, checkpoint if stop is None else f"{checkpoint.rstrip('/')}-to-{stop}"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        own = json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]  # Spark writes it before the first batch
        bounded = batch if stop is None else batch.where(F.col("pos") <= stop)
        target.apply(only_tables(bounded, list(tables)), batch_id, own, mode)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger or "10 seconds")
    return writer.start()


def catch_up(target: Target, path: str, span: int, *, stop: int | None = None, positions: int | None = None, tables: list[str] = (), mode: str = "fail") -> None:
    """Apply a log that write_log laid out, from behind the position that the target records up to stop, by default to its end.

    There is no checkpoint: what the target records is all that a run needs to go on. A batch holds the changes of so many positions and opens the
    files of these alone. Runs by position and streams may take turns on one target.
    """
    spark, since = target.spark, int(target.position()[0] or 0)
    if stop is None:
        newest = max((int(n.removeprefix("span=")) for n in names(spark, path) if n.startswith("span=")), default=0)
        stop = int(read_log(spark, path, span, since=newest * span - 1).agg(F.max("pos")).first()[0] or since)
    while since < stop:
        end = min(stop, since + positions) if positions else stop
        target.apply(only_tables(read_log(spark, path, span, since, end), list(tables)), end, "by position", mode)
        since = end


def job_id(spark: SparkSession, source: str, target: str) -> str:
    return spark.range(1).select(stream_job_id(F.lit(source), F.lit(target))).first()[0]


def cdc(spark: SparkSession, source: str, target: str, *, log: str, root: str, tables: dict[str, Table], position: Callable, snapshots: Callable[[], dict[str, DataFrame]], max_files_per_trigger: int | None = None, merge_every: int = 8, follow: list[str] | None = None, **options) -> tuple:
    """The whole job from source to target: (target, running query). Its state lies below root/<job id>, one for each (source, target).

    On the first run position() is asked before snapshots() are taken, so what happens meanwhile is replayed, not lost. Later runs find the
    target and go on from its checkpoint; where that was lost, from the position that the target records. follow: tables to follow, by
    default those of the target. options are those of apply_stream.
    """
    home = f"{root.rstrip('/')}/{job_id(spark, source, target)}"
    kept = Target(spark, f"{home}/tables", tables, merge_every=merge_every)
    if kept.version() < 0:
        at = position()
        kept.create(snapshots(), at)
    return kept, apply_stream(change_stream(spark, log, max_files_per_trigger), kept, f"{home}/checkpoint", tables=list(tables) if follow is None else follow, **options)
