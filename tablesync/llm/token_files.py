"""Op 4: token ids of documents in Simple-8b segments, written in ascending document order and read back.

A shard is what one task writes: a run of consecutive documents. Its rows are segments, each a self-contained binary record:

    magic "S8B1", block size (uint32), documents, ids, words, start of the segment in its shard (4 x int64),
    doc_id present (uint8 each), doc_id (int64 each), start in the segment (int64 each, total at the end),
    first word of each block (int64 each, total at the end), words (uint64 each); all little-endian.

The records lie in Parquet files, so any store that Spark writes holds them and a task that is run again replaces its own output.
A document never crosses a segment; a segment ends with the document that fills it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import scratch, table
from .tokens import ChunkEncoder, batches, vocabulary_path

MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sI4q")
SEGMENTS = "shard int, segment int, n_docs long, n_ids long, payload binary"
IDS = "shard int, shard_start long, n_tokens long, doc_id long, ids binary"


def pack_segment(doc_ids: list[int | None], docs: list[np.ndarray], shard_start: int, block: int) -> bytes:
    starts = np.zeros(len(docs) + 1, dtype="<i8")
    starts[1:] = np.cumsum([len(d) for d in docs])
    words, offsets = simple8b.encode(np.concatenate(docs), block)
    head = _HEAD.pack(MAGIC, block, len(docs), int(starts[-1]), len(words), shard_start)
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    known = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([head, present.tobytes(), known.tobytes(), starts.tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, starts (with the total), ids and the segment's start in its shard."""
    magic, block, n_docs, n_ids, n_words, shard_start = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    present, known, starts = part("u1", n_docs), part("<i8", n_docs), part("<i8", n_docs + 1)
    offsets, words = part("<i8", -(-n_ids // block) + 1), part("<u8", n_words)
    return [k if p else None for p, k in zip(present.tolist(), known.tolist())], starts, simple8b.decode(words, offsets, n_ids, block), shard_start


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int | None = 2, shards: int | None = None, segment_ids: int = 262_144, block: int = 1024) -> None:
    """Encode docs (doc_id, text; other columns aren't read) and write segments below path.

    Null text counts as empty and gets the end id alone. Null doc_ids come first. Rows of one doc_id stay together, in an order fixed
    by their texts. No rows: files without segments. shards: files to write, by default spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer or vocabulary_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, shard, segment, shard_start = ChunkEncoder.of(vocabulary), TaskContext.get().partitionId(), 0, 0
        end = np.zeros(0, dtype=np.uint32) if end_id is None else np.array([end_id], dtype=np.uint32)
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal segment, shard_start, size
            payload = pack_segment(held_ids, held, shard_start, block)
            out = pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "n_docs": len(held), "n_ids": size, "payload": payload}], schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))
            segment, shard_start, size = segment + 1, shard_start + size, 0
            held_ids.clear()
            held.clear()
            return out

        for part in parts:
            ids, texts = part.column("doc_id").to_pylist(), part.column("text")
            for a, b in batches(texts):
                for doc_id, doc in zip(ids[a:b], encoder.encode(texts.slice(a, b - a))):
                    held_ids.append(doc_id)
                    held.append(np.concatenate([doc, end]))
                    size += len(held[-1])
                    if size >= segment_ids:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below path: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def decode(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            for shard, payload in zip(part.column("shard").to_pylist(), part.column("payload").to_pylist()):
                doc_ids, starts, ids, shard_start = unpack_segment(payload)
                raw = ids.astype("<u4").tobytes()
                cuts = (starts * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(doc_ids), pa.int32()),
                        pa.array(starts[:-1] + shard_start, pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    names=["shard", "shard_start", "n_tokens", "doc_id", "ids"],
                )

    from pyspark.sql import Window

    # one row per shard, and shards are at most the number given to the writer: small enough for one window and a broadcast
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select(F.col("shard").alias("of_shard"), (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    docs = segments.select("shard", "payload").mapInArrow(decode, IDS)
    return docs.join(F.broadcast(bases), F.col("shard") == F.col("of_shard")).select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files, read them back."""
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
