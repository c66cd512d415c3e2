"""The current state of each key as a stream of its own, for consumers that are streams themselves."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, seq long, alive boolean, vals string"


class CurrentRows(StatefulProcessor):
    """Keeps the rows of a bucket of keys column by column and folds their changes into them.

    Input: (bucket, k, seq, op, name, value), a row for each column of a change, or one without a name. A batch's changes come in any order, as
    pandas pieces, and are folded as they come, by the rule of apply.fold: of updates only the latest of each column is held, of deletes the
    last one. Which insert counts is known at the end of the batch only, so inserts wait, beyond max_waiting cells in the state store. Memory is needed
    for a piece and for the rows of a bucket, whatever the number of changes. The rows of a bucket are one value of the state, as a call
    of the state store for each key and column takes far longer than to read and write them all.
    """

    def __init__(self, max_waiting: int = 50_000):
        self.max_waiting = max_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "rows string")
        self.inserts = handle.getMapState("inserts", "k string, seq long, name string", "value string")

    def _rows(self) -> dict[str, dict[str, str | None]]:
        return json.loads(self.rows.get()[0]) if self.rows.exists() else {}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = self._rows()
        for k, vals in zip(initialState["k"], initialState["vals"]):
            rows.setdefault(k, {}).update(json.loads(vals))
        self.rows.update((json.dumps(rows),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[str, int] = {}
        gone: dict[str, int] = {}
        latest: dict[str, dict[str, tuple[int, str | None]]] = {}
        waiting: dict[tuple[str, int], dict[str, str | None]] = {}
        held = 0
        for piece in rows:
            nulls, nameless = piece["value"].isna(), piece["name"].isna()
            for k, seq, op, name, value, null, none in zip(piece["k"], piece["seq"].tolist(), piece["op"], piece["name"], piece["value"], nulls, nameless):
                if seq > last.get(k, -1):
                    last[k] = seq
                if op == "delete":
                    if seq > gone.get(k, -1):
                        gone[k] = seq
                elif op == "update":
                    if not none:
                        cells = latest.setdefault(k, {})
                        if name not in cells or cells[name][0] < seq:
                            cells[name] = (seq, None if null else value)
                elif op == "insert" and seq > gone.get(k, -1):
                    cells = waiting.setdefault((k, seq), {})
                    if not none:
                        cells[name] = None if null else value
                    held += 1
                    if held >= self.max_waiting:
                        self._put_off(waiting)
                        held = 0
        kept = self._rows()
        for k in gone:
            kept.pop(k, None)
        since = self._births(waiting, kept, gone)
        for k, cells in latest.items():
            if k in kept:
                kept[k].update({name: value for name, (seq, value) in cells.items() if seq > since.get(k, -1)})
        self.rows.update((json.dumps(kept),))
        keys = list(last)
        yield pd.DataFrame({"key": keys, "seq": [last[k] for k in keys], "alive": [k in kept for k in keys], "vals": [json.dumps(kept.get(k, {})) for k in keys]})

    def _put_off(self, waiting: dict) -> None:
        for (k, seq), cells in waiting.items():
            for name, value in cells.items() or [("", None)]:
                self.inserts.updateValue((k, seq, name), (value,))
        waiting.clear()

    def _births(self, waiting: dict, kept: dict, gone: dict[str, int]) -> dict[str, int]:
        """Of the keys that have no row: the first insert behind the last delete, whose values become the row. Returns when that was."""
        many = self.inserts.exists()
        since: dict[str, int] = {}
        for k, seq in itertools.chain(waiting, ((k, seq) for k, seq, _ in self.inserts.keys()) if many else ()):
            if k not in kept and seq > gone.get(k, -1) and seq < since.get(k, seq + 1):
                since[k] = seq
        for k, seq in since.items():
            kept[k] = dict(waiting.get((k, seq), {}))
        if many:
            for (k, seq, name), (value,) in self.inserts.iterator():
                if name and since.get(k) == seq:
                    kept[k][name] = value
            self.inserts.clear()
        return since

    def close(self) -> None:
        pass


def current_rows(changes: DataFrame, key: str, base: DataFrame | None = None, buckets: int = 1024) -> DataFrame:
    """Streaming (key, seq, alive, row): the state of a key after each batch that changes it. Needs the RocksDB state store.

    changes is a stream of change rows. base is the table that they follow on; the state starts from its rows, which are sent only once they
    change. row holds the columns but the key's, as text; no update writes the key's. Changes without a key are left out. The keys fall into
    so many buckets by a hash, each of which is read and written whole by a batch that changes it; about a thousand keys in each are a
    good number. It is a part of the state: every run on a checkpoint must name the same.
    """
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("bucket")
    cells = F.explode_outer(F.map_entries(F.map_filter("values", lambda c, _: c != F.lit(key))))
    rows = changes.select(F.element_at("key", key).alias("k"), "seq", "op", cells.alias("c")).where("k is not null").select(bucket, "k", "seq", "op", F.col("c.key").alias("name"), F.col("c.value").alias("value"))
    start = None
    if base is not None:
        others = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in base.columns if c != key])
        start = base.select(F.col(f"`{key}`").cast("string").alias("k"), F.to_json(others, {"ignoreNullFields": "false"}).alias("vals")).select(bucket, "k", "vals").groupBy("bucket")
    states = rows.groupBy("bucket").transformWithStateInPandas(CurrentRows(), OUT, "Update", "None", start)
    return states.select("key", "seq", "alive", F.from_json("vals", "map<string,string>").alias("row"))
