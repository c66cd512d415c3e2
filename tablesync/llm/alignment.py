"""Op 12: aligning the tokens of two tokenizers over the same bytes.

Token ends that both sides share cut a text into groups. An interval between shared ends is divided at the shared end nearest to its middle,
found by bisecting both rows of ends; both halves are divided again; an interval without an inner shared end is a group. All open intervals
of a level are handled at once in numpy.

Neither tokenizer lets a token cross the place between a non-space character and a single space that a non-space character follows, so both
have an end there whatever stands around. Texts fall into chunks at these first shared ends; each different chunk is divided once per worker.

How many documents hold a linked pair of ids is known only over the whole corpus. Documents are gathered into blocks of bounded size, each
with the dictionary of its pairs: blocks' dictionaries are what is counted and joined, not the links of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .tokens import ChunkEncoder, vocabulary_path

#: Chunks that a worker remembers before it starts anew.
MAX_CHUNKS = 250_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space that isn't a single space between other characters: such texts are split by _CUT, the others at every space.
_ODD = re.compile(r" \s|\s |^\s|\s$").search
BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, pairs binary, times binary, codes array<long>, docs array<long>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def shared_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices into a of the ends that a and b share. Both ascend strictly and have the same last end; none: empty."""
    shared = np.zeros(len(a), dtype=bool)
    if not len(a):
        return np.flatnonzero(shared)
    shared[-1] = True
    # an interval holds the tokens [a0, a1) and [b0, b1); its bounds are shared
    a0, a1, b0, b1 = (np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b)))
    while len(a0):
        open_ = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[open_], a1[open_], b0[open_], b1[open_]
        start = np.where(a0 > 0, a[a0 - 1], 0)
        up = np.clip(np.searchsorted(a, (start + a[a1 - 1]) // 2), a0, a1 - 1)
        down, hit_a, hit_b = up - 1, np.full(len(a0), -1), np.full(len(a0), -1)
        left = np.arange(len(a0))
        while len(left):  # outward from the middle, a step up and a step down at a time
            for at, inside in ((up[left], up[left] < a1[left] - 1), (down[left], down[left] >= a0[left])):
                i = at[inside]
                j = np.searchsorted(b, a[i])
                same = b[j] == a[i]
                to = left[inside][same]
                new = hit_a[to] < 0
                hit_a[to[new]], hit_b[to[new]] = i[same][new], j[same][new]
            up[left] += 1
            down[left] -= 1
            left = left[(hit_a[left] < 0) & ((up[left] < a1[left] - 1) | (down[left] >= a0[left]))]
        cut = hit_a >= 0
        i, j = hit_a[cut] + 1, hit_b[cut] + 1
        shared[i - 1] = True
        a0, a1, b0, b1 = np.concatenate([a0[cut], i]), np.concatenate([i, a1[cut]]), np.concatenate([b0[cut], j]), np.concatenate([j, b1[cut]])
    return np.flatnonzero(shared)


class Aligner:
    """Aligns texts; made once per Python worker. Row r of what it remembers belongs to one chunk."""

    _made: dict[tuple[str, str], "Aligner"] = {}

    @classmethod
    def of(cls, byte_path: str, piece_path: str) -> "Aligner":
        if (byte_path, piece_path) not in cls._made:
            cls._made[byte_path, piece_path] = cls(byte_path, piece_path)
        return cls._made[byte_path, piece_path]

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.encoder = ChunkEncoder(byte_path)
        self.encoder.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.byte_bpe = self.encoder.tokenizer
        self.piece_bpe = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        others = [*range(0x21), *range(0x7F, 0xA1), 0xAD]  # the byte-level alphabet, a fixed value
        byte_of = {chr(b): b for b in range(256)} | {chr(0x100 + i): b for i, b in enumerate(others)}
        self.a_bytes = [bytes(byte_of[c] for c in self.byte_bpe.id_to_token(i) or "") for i in range(self.byte_bpe.get_vocab_size(with_added_tokens=False))]
        self.a_bytes += [b""] * (self.byte_bpe.get_vocab_size() - len(self.a_bytes))
        pieces = [self.piece_bpe.id_to_piece(i) for i in range(self.piece_bpe.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.piece_bpe.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{piece_path} has pieces that cross a space")
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        #: An id with each of the marks that may follow it: id * 4 + 0 (,), 1 (|), 2 (;) and 3 (the end of a chunk).
        self.marked = [f"{i}{m}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for m in ",|;\n"]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.strings: list[str] = []
        #: n_a, n_b, n_groups, n_links; n_a is -1 where the joined bytes aren't the chunk's.
        self.counts = np.zeros((1 << 12, 4), dtype=np.int64)
        self.codes, self.stops, self.n_codes = np.zeros(1 << 14, dtype=np.int64), np.zeros((1 << 12) + 1, dtype=np.int64), 0

    def _grow(self, rows: int, codes: int) -> None:
        while rows > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.stops = np.concatenate([self.stops, np.zeros(len(self.stops) - 1, dtype=np.int64)])
        while codes > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])

    def learn(self, chunks: list[str]) -> None:
        """Align chunks, each a text that both tokenizers see behind a space, and remember them. All are divided together."""
        if len(self.encoder.memo) > MAX_CHUNKS:
            self.encoder.rest()
        for at in range(0, len(chunks), 20_000):
            part = chunks[at : at + 20_000]
            spaced = [" " + c for c in part]
            a, a_stops = self.encoder.encode_each(spaced)
            a, of_b = a.astype(np.int64), self.piece_bpe.encode(part, num_threads=1)
            b_stops = np.cumsum(np.fromiter(map(len, of_b), dtype=np.int64, count=len(part)))
            b = np.fromiter(chain.from_iterable(of_b), dtype=np.int64, count=int(b_stops[-1]))
            sizes = np.array([len(x) if x.isascii() else len(x.encode()) for x in spaced], dtype=np.int64)
            good = self._whole(spaced, sizes, a, a_stops, b, b_stops)
            n_a, n_b = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
            if not good.all():
                a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            ends_a, ends_b, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(sizes[good])
            last_a = shared_ends(ends_a, ends_b) + 1
            group_ends = ends_a[last_a - 1]
            last_b = np.searchsorted(ends_b, group_ends) + 1
            spans = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
            spans = spans[np.diff(spans, prepend=0) > 0]  # between two ends of either side lies one linked pair
            codes = (a[np.searchsorted(ends_a, spans)] << 32) | b[np.searchsorted(ends_b, spans)]
            n_links = np.diff(np.searchsorted(spans, ends, side="right"), prepend=0)
            n_groups = np.diff(np.searchsorted(group_ends, ends, side="right"), prepend=0)
            first = len(self.memo)
            self._grow(first + len(part), self.n_codes + len(codes))
            rows = slice(first, first + len(part))
            self.counts[rows] = -1
            self.counts[rows][good] = np.stack([n_a[good], n_b[good], n_groups, n_links], axis=1)
            texts = iter(self._written(a, b, last_a, last_b, np.isin(group_ends, ends, assume_unique=True)))
            self.strings += [next(texts) if g else "" for g in good.tolist()]
            self.codes[self.n_codes : self.n_codes + len(codes)] = codes
            linked = np.zeros(len(part), dtype=np.int64)
            linked[good] = n_links
            self.stops[first + 1 : first + 1 + len(part)] = self.n_codes + np.cumsum(linked)
            self.n_codes += len(codes)
            self.memo.update(zip(part, range(first, first + len(part))))

    def _whole(self, spaced: list[str], sizes: np.ndarray, a: np.ndarray, a_stops: np.ndarray, b: np.ndarray, b_stops: np.ndarray) -> np.ndarray:
        """Which chunks have tokens, of both sides, that join to their bytes."""
        raw = "".join(spaced).encode()
        good = np.ones(len(spaced), dtype=bool)
        for ids, stops, size, table in ((a, a_stops, self.a_size, self.a_bytes), (b, b_stops, self.b_size, self.b_bytes)):
            total = np.concatenate([[0], np.cumsum(size[ids])])[stops]
            joined = b"".join(map(table.__getitem__, ids.tolist()))
            if joined != raw or (np.diff(total, prepend=0) != sizes).any():
                to = total.tolist()
                good &= [joined[i:j] == x.encode() for i, j, x in zip([0, *to], to, spaced)]
        return good

    def _written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends_chunk: np.ndarray) -> list[str]:
        """The groups of each chunk: the marked ids of all, in the order of groups and first A, then B, joined at once and split at the chunks' ends."""
        in_a, in_b = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=0)), np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=0))
        mark_a, mark_b = a * 4, b * 4
        mark_a[last_a - 1] += 1
        mark_b[last_b - 1] += 2 + ends_chunk
        out = np.empty(len(a) + len(b), dtype=np.int64)
        out[np.arange(len(a)) + (last_b[in_a - 1] if len(last_b) else 0) * (in_a > 0)] = mark_a
        out[np.arange(len(b)) + last_a[in_b]] = mark_b
        return "".join(map(self.marked.__getitem__, out.tolist())).split("\n")

    def learn_texts(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text, all of them known from now on; none for a null or empty text."""
        chunks = [[] if not t else (_CUT.split(t) if _ODD(t) else t.split(" ")) for t in texts]
        known = self.memo
        self.learn(list(dict.fromkeys(c for part in chunks for c in part if c not in known)))
        return chunks

    def groups(self, text: str | None) -> str:
        """The groups of a text: a1,a2|b1;a3|b2,b3 in decimal ids; empty where it has no tokens."""
        rows = [self.memo[c] for c in self.learn_texts([text])[0]]
        return "" if not rows or self.counts[rows, 0].min() < 0 else ";".join(map(self.strings.__getitem__, rows))

    def digest(self, chunks: list[str]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """Counts (n_a, n_b, n_groups, n_links), hash of the groups, different pairs in ascending order and how often each is linked."""
        none = np.zeros(0, dtype=np.int64)
        rows = np.fromiter(map(self.memo.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if not len(rows) or self.counts[rows, 0].min() < 0:
            return np.zeros(4, dtype=np.int64), "", none, none
        sha = hashlib.sha256()
        for at in range(0, len(rows), 50_000):
            sha.update(((";" if at else "") + ";".join(map(self.strings.__getitem__, rows[at : at + 50_000].tolist()))).encode())
        different, n = np.unique(rows, return_counts=True)
        starts = self.stops[different]
        sizes = self.stops[different + 1] - starts
        stops = np.cumsum(sizes)
        codes = self.codes[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1])]
        order = np.argsort(codes)
        codes, weights = codes[order], np.repeat(n, sizes)[order]
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return self.counts[rows].sum(axis=0), sha.hexdigest(), codes[heads], np.add.reduceat(weights, heads)


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, block_pairs: int) -> DataFrame:
    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, block = Aligner.of(byte_path, piece_path), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        found: list[tuple] = []
        size = 0

        def flush():
            nonlocal block, size
            codes, place, n = np.unique(np.concatenate([f[2] for f in found]), return_inverse=True, return_counts=True)
            counts = np.array([f[0] for f in found])
            row = {
                "block": block, "doc_id": ids, **{c: counts[:, i].tolist() for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": [f[1] for f in found],
                "n_pairs": [len(f[2]) for f in found], "pairs": np.diff(place, prepend=0).astype("<i4").tobytes(), "times": np.concatenate([f[3] for f in found]).astype("<u4").tobytes(), "codes": codes.tolist(), "docs": n.tolist(),
            }
            out = pa.RecordBatch.from_pylist([row], schema=schema)
            block, size = block + 1, 0
            ids.clear()
            found.clear()
            if len(aligner.memo) > MAX_CHUNKS:
                aligner.forget()
            return out

        longs = pa.list_(pa.int64())
        schema = pa.schema([("block", pa.int64()), *[(c, longs) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.list_(pa.string())), ("n_pairs", longs), ("pairs", pa.binary()), ("times", pa.binary()), ("codes", longs), ("docs", longs)])
        for part in parts:
            for at in range(0, part.num_rows, 128):
                some = part.slice(at, 128)
                for doc_id, chunks in zip(some.column("doc_id").to_pylist(), aligner.learn_texts(some.column("text").to_pylist())):
                    ids.append(doc_id)
                    found.append(aligner.digest(chunks))
                    size += len(found[-1][2]) + 16
                if size >= block_pairs:
                    yield flush()
        if found:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def _sums(parts: Iterator) -> Iterator:
    """Blocks with known, which holds twice a pair's count, plus one if it is the best of its first id, by the places of the dictionary."""
    import pyarrow as pa

    for part in parts:
        for r in range(part.num_rows):
            row = {c: part.column(c)[r] for c in part.schema.names}
            known = np.array(row["known"].as_py() or [], dtype=np.int64)
            n_pairs = np.array(row["n_pairs"].as_py(), dtype=np.int64)
            place = np.cumsum(np.frombuffer(row["pairs"].as_py(), dtype="<i4").astype(np.int64))
            times = np.frombuffer(row["times"].as_py(), dtype="<u4").astype(np.int64)
            stops = np.cumsum(n_pairs)
            of_pair = known[place]
            total, best = (np.concatenate([[0], np.cumsum(x)]) for x in (times * (of_pair >> 1), times * (of_pair & 1)))
            sums = [pa.array(x[stops] - x[stops - n_pairs], pa.int64()) for x in (best, total)]
            plain = [row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*plain, *sums, row["groups_sha256"].values], names=[f.split(" ")[0] for f in DIGEST.split(", ")])


def align(docs: DataFrame, *, byte_bpe: str | None = None, piece_bpe: str | None = None, block_pairs: int = 400_000) -> DataFrame:
    """The alignment digest of docs (doc_id, text; other columns aren't read), one row for each: DIGEST.

    byte_bpe is a byte-level vocabulary of the tokenizers library (A), which gets a space and the text; piece_bpe one of sentencepiece (B), which
    adds the space itself. n_links counts the pairs of token occurrences whose bytes overlap; count_sum adds up, over them, how many documents
    hold the pair of ids linked; n_best counts those whose pair has the largest such number of its A id. Null and empty texts, and texts whose joined
    bytes differ, have no tokens: zeros and an empty hash. Rows that repeat a document are documents of their own. No rows: no rows.
    Aligner.groups() gives the groups of a text themselves.
    """
    spark = docs.sparkSession
    path = scratch(spark, "alignment")
    _blocks(docs, byte_bpe or vocabulary_path(), piece_bpe or vocabulary_path("piece_bpe_32k.model"), block_pairs).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "x")).select("block", "place", F.col("x.codes").alias("code"), F.col("x.docs").alias("n"))
    counts = pairs.groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("code", 32))
    most = counts.groupBy(F.col("a").alias("of_a")).agg(F.max("n").alias("most"))
    known = counts.join(most, F.col("a") == F.col("of_a")).select(F.col("code").alias("of_code"), (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("known"))
    filled = pairs.select("block", "place", "code").join(known, F.col("code") == F.col("of_code"))
    filled = filled.groupBy(F.col("block").alias("of_block")).agg(F.sort_array(F.collect_list(F.struct("place", "known"))).alias("x"))  # a block's dictionary is bounded by block_pairs
    met = blocks.drop("codes", "docs").join(filled.select("of_block", F.col("x.known").alias("known")), F.col("block") == F.col("of_block"), "left")
    return met.drop("block", "of_block").mapInArrow(_sums, DIGEST)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text by both vocabularies."""
    return align(table(spark, sf_dir, "documents"))
