"""Op 6: order-preserving packing into windows by dynamic programming.

The documents of a partition form one row of tokens. Windows of at most max_len tokens cut it, with the cuts taken from candidates:
document ends (free), sentence ends, and inner places of long sentences. The cost of a window that ends at candidate j is its padding
max_len - (c_j - c_i) plus the penalty of cutting at j, so best(j) = penalty(j) + max_len - c_j + min over i of (best(i) + c_i) with
c_j - c_i <= max_len: a sliding minimum, which a monotone queue gives in constant time per candidate.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import ChunkEncoder, batches, vocabulary_path

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def candidates(ends_sentence: np.ndarray, doc_ends: np.ndarray, sentence_penalty: float, inner_penalty: float, inner_step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions, from 0 to the number of tokens, and the penalty of each."""
    n = len(ends_sentence)
    penalty = np.full(n + 1, np.inf)
    penalty[1:][ends_sentence] = sentence_penalty
    penalty[doc_ends] = 0.0
    penalty[[0, n]] = 0.0
    cuts = np.flatnonzero(penalty < np.inf)
    inside = (np.diff(cuts) - 1) // inner_step
    nth = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside)
    penalty[np.repeat(cuts[:-1], inside) + (nth + 1) * inner_step] = inner_penalty
    cuts = np.flatnonzero(penalty < np.inf)
    return cuts, penalty[cuts]


def best_cuts(cuts: np.ndarray, penalties: np.ndarray, max_len: int) -> np.ndarray:
    """The positions, first and last included, whose windows have the least padding plus penalties. No gap may exceed max_len."""
    c, pen = cuts.tolist(), penalties.tolist()
    back = [0] * len(c)
    queue: deque = deque([(c[0], c[0], 0)])  # (best + position, position, index), values rising
    for j in range(1, len(c)):
        here = c[j]
        while queue[0][1] < here - max_len:
            queue.popleft()
        value, _, back[j] = queue[0]
        value += pen[j] + max_len  # best(j) + c_j
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    out, j = [], len(c) - 1
    while j:
        out.append(c[j])
        j = back[j]
    return np.array([c[0], *out[::-1]], dtype=np.int64)


def tail_cuts(start: int, stop: int) -> list[int]:
    """The last, short window as windows whose lengths are powers of two, which need no padding."""
    out, left = [], stop - start
    while left:
        start += 1 << (left.bit_length() - 1)
        out.append(start)
        left = stop - start
    return out


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 0, max_len: int = 1024, sentence_penalty: float = 2.0, inner_penalty: float = 8.0, inner_step: int = 16, chunk_ids: int = 400_000) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most max_len tokens, one row each, with the piece's ids (little-endian uint32).

    The order of documents within the input's partitions is kept and no data is shuffled. Null text counts as empty: its document
    is the end id alone. Rows that repeat a doc_id are documents of their own. No rows: no pieces. Documents of any length are cut.
    Windows never cross partitions; the last one of each is cut to powers of two, so that it needs no padding.
    """
    vocabulary = tokenizer or vocabulary_path()

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = ChunkEncoder.of(vocabulary)
        next_sequence = TaskContext.get().partitionId() << 32
        #: Documents not yet packed whole: id, ids, and how many of the first one's ids are packed.
        held: list[tuple[int | None, np.ndarray]] = []
        packed = 0

        def emit(last: bool):
            nonlocal held, packed, next_sequence
            sizes = np.array([len(ids) for _, ids in held], dtype=np.int64)
            tokens = np.concatenate([ids for _, ids in held])[packed:]
            doc_starts = np.cumsum(sizes) - sizes - packed
            doc_ends = doc_starts + sizes
            cuts = best_cuts(*candidates(encoder.ends_sentence[tokens], doc_ends, sentence_penalty, inner_penalty, min(inner_step, max_len)), max_len)
            if last and cuts[-1] - cuts[-2] < max_len:
                cuts = np.concatenate([cuts[:-1], tail_cuts(int(cuts[-2]), int(cuts[-1]))])
            elif not last:
                cuts = cuts[:-1]
            stop = int(cuts[-1])
            bounds = np.union1d(cuts, np.concatenate([[0], doc_ends[doc_ends < stop]]))
            start, end = bounds[:-1], bounds[1:]
            doc = np.searchsorted(doc_ends, start, side="right")
            window = np.searchsorted(cuts, start, side="right") - 1
            raw = tokens.astype("<u4").tobytes()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in doc.tolist()], pa.int64()),
                    pa.array(start - doc_starts[doc], pa.int64()),
                    pa.array(end - start, pa.int64()),
                    pa.array(sizes[doc], pa.int64()),
                    pa.array(window + next_sequence, pa.int64()),
                    pa.array(start - cuts[window], pa.int64()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist())], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            next_sequence += len(cuts) - 1
            first = int(np.searchsorted(doc_ends, stop, side="right"))
            packed = int(stop - doc_starts[first]) if first < len(held) else 0
            held = held[first:]
            return out

        end, size = np.array([end_id], dtype=np.uint32), 0
        try:
            for part in parts:
                ids, texts = part.column("doc_id").to_pylist(), part.column("text")
                for a, b in batches(texts):
                    for doc_id, doc in zip(ids[a:b], encoder.encode(texts.slice(a, b - a))):
                        held.append((doc_id, np.concatenate([doc, end])))
                        size += len(doc) + 1
                        if size >= max(chunk_ids, 4 * max_len):
                            yield emit(last=False)
                            size = sum(len(x) for _, x in held) - packed
            if held:
                yield emit(last=True)
        finally:
            encoder.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
