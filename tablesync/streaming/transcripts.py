"""Transcripts as streams: the lines of growing files, decoded to changes as soon as these are complete."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from ..functions.text import ASSIGNMENT, assigned, marker_offset, rotate_target, table_name
from ..operators.decode import OPERATION, named_changes

#: What a line says, and what a block is; many of either travel as one Arrow batch in a binary column.
LINES = pa.schema([("line_no", pa.int64()), ("op", pa.string()), ("tbl", pa.string()), ("marker", pa.int64()), ("rotate", pa.string()), ("section", pa.string()), ("n", pa.int32()), ("text", pa.string()), ("ended", pa.bool_())])
BLOCKS = pa.schema([("pos", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("op", pa.string()), ("tbl", pa.string()), ("cells", pa.list_(pa.struct([("old", pa.bool_()), ("n", pa.int32()), ("text", pa.string())])))])
PACKED = "path string, pack binary"
BLOCK_ROWS = "path string, pos long, seq long, file string, op string, tbl string, cells array<struct<old: boolean, n: int, text: string>>"
HEAD = "last_line long, file string, start long, blocks long"
#: Blocks of one pack at most.
MAX_BLOCKS = 10_000


def _pack(batch: pa.RecordBatch) -> bytes:
    return batch.serialize().to_pybytes()


def _unpack(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(data), schema)


def _packed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (path, *LINES) as a row for each path of an Arrow batch; lines that say nothing are left out."""
    for batch in batches:
        said = reduce(pc.or_, [batch.column(c).is_valid() for c in ("op", "marker", "rotate", "section", "n")], batch.column("ended").fill_null(False))
        batch = batch.filter(said)
        paths = batch.column("path").dictionary_encode()
        codes = paths.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        lines = pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type).take(pa.array(order)) for f in LINES], schema=LINES)
        ends = np.flatnonzero(np.diff(codes[order], append=-2)) + 1
        names, starts = paths.dictionary.to_pylist() + [None], np.concatenate([[0], ends[:-1]])
        packs = [_pack(lines.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in codes[order][ends - 1].tolist()], pa.string()), pa.array(packs, pa.binary())], names=["path", "pack"])


def _unpacked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("pack").to_pylist()):
            blocks = _unpack(data, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(blocks), pa.string()), *blocks.columns], names=["path", *BLOCKS.names])


class OpenBlocks(StatefulProcessor):
    """Of each file: what it carries on behind its last closed event (HEAD), and the lines since, whose blocks' position isn't known yet.

    Input: (path, pack), packs of LINES of one file in any order. A marker ends the blocks before it and is their position; the end of a log is
    the last marker plus one. Lines that were seen already, for they are delivered again, are passed over. A batch's lines of one file are
    sorted in memory, so what a batch reads is to be bounded. Output: packs of BLOCKS.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.waiting = handle.getValueState("waiting", "lines binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, file, start, n = self.head.get() if self.head.exists() else (-1, None, None, 0)
        came = pa.Table.from_batches([_unpack(r.pack, LINES) for r in rows], LINES).combine_chunks()
        if came["line_no"].null_count:
            raise ValueError(f"a line of {key[0]} has no number")
        line_no = came["line_no"].to_numpy()
        order = np.argsort(line_no, kind="stable")
        line_no = line_no[order]
        new = (line_no > last) & (np.diff(line_no, prepend=-1) != 0)
        if not new.any():
            return
        lines = came.take(pa.array(order[new]))
        if self.waiting.exists():
            lines = pa.concat_tables([pa.Table.from_batches([_unpack(self.waiting.get()[0], LINES)], LINES), lines])
        column = {c: lines[c].combine_chunks() for c in LINES.names}
        there = {c: column[c].is_valid().to_numpy(zero_copy_only=False) for c in ("op", "marker", "rotate", "section", "n")}
        at = np.arange(lines.num_rows)
        latest = lambda mask: np.maximum.accumulate(np.where(mask, at, -1))
        close = there["marker"] | column["ended"].fill_null(False).to_numpy(zero_copy_only=False)
        op = ~close & there["op"]
        section = ~close & ~op & there["section"]
        where = section & np.array([x == "WHERE" for x in column["section"].to_pylist()], dtype=bool)
        closes, ops = np.flatnonzero(close), np.flatnonzero(op)
        closer = np.searchsorted(closes, ops)
        done = int((closer < len(closes)).sum())
        file_at, marker_at, section_at = latest(there["rotate"]), latest(there["marker"]), latest(op | section)
        marker = column["marker"].fill_null(0).to_numpy(zero_copy_only=False)
        before = np.where(marker_at >= 0, marker[marker_at], start or 0)  # the last marker so far

        if done:
            op_at, block = latest(op), np.cumsum(op) - 1
            cells = np.flatnonzero(~close & ~op & ~section & there["n"] & (op_at > latest(close)) & (block < done))
            stops = np.concatenate([[0], np.cumsum(np.bincount(block[cells], minlength=done))])
            values = pa.StructArray.from_arrays([pa.array(where[section_at[cells]]), *[column[c].take(pa.array(cells)) for c in ("n", "text")]], names=["old", "n", "text"])
            mine = ops[:done]
            end = closes[closer[:done]]
            named = column["rotate"].take(pa.array(file_at[mine], mask=file_at[mine] < 0))
            blocks = pa.RecordBatch.from_arrays([
                pa.array(np.where(there["marker"][end], before[end], before[end] + 1)), pa.array(n + 1 + np.arange(done)), named if file is None else named.fill_null(file),
                *[column[c].take(pa.array(mine)) for c in ("op", "tbl")], pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values).cast(BLOCKS.field("cells").type),
            ], schema=BLOCKS)
            for a in range(0, done, MAX_BLOCKS):
                yield Row(path=key[0], pack=_pack(blocks.slice(a, MAX_BLOCKS)))

        if len(closes):
            c = int(closes[-1])
            file = column["rotate"][int(file_at[c])].as_py() if file_at[c] >= 0 else file
            start = int(before[c]) if marker_at[c] >= 0 else start
            lines = lines.slice(c + 1)
        self.head.update((int(line_no[-1]), file, start, n + done))
        if lines.num_rows:
            self.waiting.update((_pack(lines.combine_chunks().to_batches()[0]),))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _parsed(lines: DataFrame) -> DataFrame:
    """path and LINES: what each line says. An expression is tried only on lines that begin or read as it needs, and each once: what
    several columns are made of is a column of the step before."""
    starts = lambda *texts: reduce(or_, [F.startswith("line", F.lit(x)) for x in texts])
    told = lines.select("path", "line_no", "line", F.when(starts("### "), F.nullif(F.regexp_extract("line", OPERATION, 1), F.lit(""))).alias("op_text"))
    is_op = F.col("op_text").isNotNull()
    told = told.withColumn("body", F.when(starts("###") & ~is_op, F.regexp_replace("line", r"^###\s*", "")))
    cell = F.startswith("body", F.lit("@"))
    told = told.withColumn("ordinal", F.when(cell, F.nullif(F.regexp_extract("body", ASSIGNMENT, 1), F.lit("")))).withColumn("raw", F.when(cell, F.regexp_extract("body", ASSIGNMENT, 2)))
    return told.select(
        "path", "line_no",
        F.when(F.col("op_text") == "INSERT INTO", "insert").when(F.col("op_text") == "UPDATE", "update").when(is_op, "delete").alias("op"),
        F.when(is_op, table_name(F.regexp_extract("line", OPERATION, 2))).alias("tbl"),
        F.when(starts("# at "), marker_offset(F.col("line"))).alias("marker"), F.when(F.contains("line", F.lit("Rotate to ")), rotate_target(F.col("line"))).alias("rotate"),
        F.when(starts("### SET", "### WHERE") & F.rlike("line", F.lit(r"^### (SET|WHERE)\s*$")), F.regexp_extract("line", r"^### (SET|WHERE)", 1)).alias("section"),
        F.col("ordinal").cast("int").alias("n"), F.when(F.col("ordinal").isNotNull(), assigned(F.col("raw"))["text"]).alias("text"),
        starts("# End of log file").alias("ended"),
    )


def transcript_stream(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Streaming changes (path, file, pos, seq, op, tbl, key, values), those that operators.decode.transcript_changes gives for whole files.

    lines: a stream of (path, line_no, line), where line_no rises along a file; a file may come in any number of pieces, and one that ends
    inside a block or an event leaves this in the state until more of the file comes. A block is sent with the batch that brings the marker behind it.
    catalog: (tbl, ordinal, col, pk), static, broadcast-sized configuration. Needs the RocksDB state store.
    """
    packs = _parsed(lines).mapInArrow(_packed_lines, PACKED)
    blocks = packs.groupBy("path").transformWithState(OpenBlocks(), PACKED, "Append", "None").mapInArrow(_unpacked_blocks, BLOCK_ROWS)
    return named_changes(blocks, catalog)
