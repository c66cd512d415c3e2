"""Counters of applied changes as streams: per table and operation, and the running number of each change within its table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import applied_counts, running_applied
from ..storage import latest_version, publish_version, read_text, version_state


def applied_stream(changes: DataFrame) -> DataFrame:
    """Streaming (tbl, op, applied), for outputs in update mode: a batch sends the counts that it changed, which Spark keeps as state."""
    return applied_counts(changes)


class RunningCounts:
    """Numbers the changes of each table over all batches of a stream; what it has written lies below root.

    A batch is numbered by operators.changes.running_applied, which keeps a hot table spread, behind the totals of the batches before. Its rows
    and the new totals become visible with one version, so a batch that is delivered again adds nothing. The totals are one number for each table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _state(self) -> tuple[int, dict]:
        version = latest_version(self.spark, self.root)
        return version, version_state(self.spark, self.root, version) if version >= 0 else {"totals": {}, "paths": [], "batch_id": -1, "stream": ""}

    def add(self, changes: DataFrame, batch_id: int, stream: str = "") -> None:
        """Number a batch (tbl, seq). Batches follow each other in seq."""
        version, state = self._state()
        if stream == state["stream"] and batch_id <= state["batch_id"]:
            return
        path = f"{self.root}/data/batch-{version + 1}"
        totals = self.spark.createDataFrame(list(state["totals"].items()), "t_tbl string, t_total long")
        numbered = running_applied(changes.select("tbl", "seq")).join(totals, F.col("tbl") == F.col("t_tbl"), "left")
        numbered.select("tbl", "seq", (F.col("running") + F.coalesce("t_total", F.lit(0))).alias("running")).write.mode("overwrite").parquet(path)
        new = {r.tbl: r.n for r in self.spark.read.parquet(path).groupBy("tbl").agg(F.max("running").alias("n")).collect()}
        publish_version(self.spark, self.root, version + 1, {"totals": state["totals"] | new, "paths": [*state["paths"], path], "batch_id": batch_id, "stream": stream})

    def read(self) -> DataFrame:
        """(tbl, seq, running) of all batches."""
        paths = self._state()[1]["paths"]
        return self.spark.read.schema("tbl string, seq long, running long").parquet(*paths) if paths else self.spark.createDataFrame([], "tbl string, seq long, running long")

    def totals(self) -> dict[str, int]:
        return self._state()[1]["totals"]

    def follow(self, changes: DataFrame, checkpoint: str):
        """Start the query that numbers a stream of changes, until what is there now has been read."""

        def on_batch(batch: DataFrame, batch_id: int) -> None:
            self.add(batch, batch_id, json.loads(read_text(self.spark, f"{checkpoint}/metadata"))["id"])

        return changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
