"""Op 7: nearest neighbours by largest cosine, found with randomly rotated one-bit codes.

A vector is made of length one and turned at random into at least code_bits dimensions; its code is the signs of the result, packed, with one
correction scalar, the inner product f of the turned vector and its sign vector scaled to length one. For a query q, <code, q> / f estimates
the cosine without bias, and the error stays below epsilon * sqrt((1 - f^2) / f^2) / sqrt(bits - 1) but for a probability that falls as
exp(-c epsilon^2).

Different vectors are coded once and stored. Each query needs a threshold below which no vector can be among its nearest: a first one is the
k-th best cosine within a bounded sample. Then codes of larger and larger nested samples, the last the whole table, meet the queries in
blocks; vectors whose upper bound reaches the threshold survive, and they alone are joined with their original components and measured,
which gives the result or the next sample's threshold. So the survivors of a query hardly grow with the table. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CODES = "row_id long, ids array<long>, v array<double>, d int, code binary, f double"


def rotation(d: int, bits: int, seed: int) -> np.ndarray:
    """A random bits x d matrix with orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, d)))
    return q * np.sign(np.diag(r))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows made of length one; the lengths neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def one_bit_codes(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (rows of uint8) and correction scalars f of rows of length one."""
    turned = units @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(len(turn))


def estimates(codes: np.ndarray, f: np.ndarray, turned: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (codes x queries; the queries are of length one and turned) and the error bound of each code."""
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    f = np.maximum(f, 1e-9)
    inner = signs @ turned.T.astype(np.float32)
    return inner / (f * np.sqrt(bits)).astype(np.float32)[:, None], epsilon * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(1, bits - 1))


def usable(vector: Column) -> Column:
    """The vector as doubles, or null if it is null, empty, zero or holds a null, NaN or infinite component."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), v)


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, places, matrix) for each length of the lists of numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        yield d, own, flat[starts[own][:, None] + np.arange(d)]


def coded(rows: DataFrame, k: int, code_bits: int, seed: int) -> DataFrame:
    """CODES of rows (vec_id, v): one row for each different vector, with its k + 1 smallest ids (one may be the query's own)."""
    # equal rows go before they meet; of the rows of one vector each task passes on k + 1
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("turn", turn).where(F.col("turn") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def encode(parts: Iterator) -> Iterator:
        from pyspark import TaskContext

        n, turns = TaskContext.get().partitionId() << 33, {}
        for part in parts:
            v = part.column("v")
            codes, dims, f = [b""] * len(v), np.zeros(len(v), dtype=np.int32), np.zeros(len(v))
            for d, own, matrix in _by_length(v):
                if d not in turns:
                    turns[d] = rotation(d, max(d, code_bits), seed)
                packed, f[own] = one_bit_codes(unit(matrix), turns[d])
                dims[own] = d
                for i, c in zip(own.tolist(), packed):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + len(v))), part.column("ids"), v, pa.array(dims), pa.array(codes, pa.binary()), pa.array(f)], names=["row_id", "ids", "v", "d", "code", "f"])
            n += len(v)

    return written(classes.select("v", "ids").mapInArrow(encode, CODES), "one-bit-codes")


def _first_thresholds(asked: DataFrame, sample: DataFrame, blocks: int, k: int) -> DataFrame:
    """(q_row, t, near): the k-th best cosine of each query with vectors of other ids in a bounded sample, minus infinity if it has fewer, and
    the row_ids of these vectors, which stay candidates whatever their codes say."""
    def measure(key, left, right):
        t, near = np.full(len(right), -np.inf), [[] for _ in range(len(right))]
        ids, row_ids = left.column("ids").to_pylist(), left.column("row_id").to_pylist()
        rows = {d: (own, unit(m)) for d, own, m in _by_length(left.column("v"))}
        own_ids = right.column("query_id").to_pylist()
        for d, q_own, m in _by_length(right.column("q")):
            if d not in rows:
                continue
            r_own, vectors = rows[d]
            for at in range(0, len(q_own), 1024):
                scores = vectors @ unit(m[at : at + 1024]).T
                for j, place in enumerate(q_own[at : at + 1024].tolist()):
                    top = min(2 * k + 2, len(vectors))
                    best = np.argpartition(-scores[:, j], top - 1)[:top]
                    seen: set[int] = set()
                    for i in best[np.argsort(-scores[best, j])].tolist():
                        seen.update(x for x in ids[r_own[i]] if x != own_ids[place])
                        near[place].append(row_ids[r_own[i]])
                        if len(seen) >= k:
                            t[place] = scores[i, j] - 1e-9
                            break
        return pa.table({"q_row": right.column("q_row"), "t": pa.array(t), "near": pa.array(near, pa.list_(pa.int64()))})

    spread = asked.select("q_row", "query_id", "q", "q_block")
    copies = sample.select("row_id", "ids", "v").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return copies.groupBy("q_block").cogroup(spread.groupBy("q_block")).applyInArrow(measure, "q_row long, t double, near array<long>")


def _survivors(codes: DataFrame, asked: DataFrame, row_blocks: int, query_blocks: int, epsilon: float, code_bits: int, seed: int) -> DataFrame:
    """(q_row, row_id) of the pairs whose upper bound reaches the query's threshold t. Only codes are sent to the queries' blocks."""
    block = lambda key, n: F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r_side = codes.select("row_id", "d", "code", "f").withColumn("r_block", block("row_id", row_blocks)).withColumn("q_block", every(query_blocks))
    q_side = asked.select("q_row", "q", "t", "q_block").withColumn("r_block", every(row_blocks))

    def meet(key, left, right):
        row_ids, dims, f = (left.column(c).to_numpy() for c in ("row_id", "d", "f"))
        packed = left.column("code").to_pylist()
        q_rows, t = right.column("q_row").to_numpy(), right.column("t").to_numpy()
        out = [(np.zeros(0, dtype=np.int64),) * 2]
        for d, q_own, m in _by_length(right.column("q")):
            r_own = np.flatnonzero(dims == d)
            turned = unit(m) @ rotation(d, max(d, code_bits), seed).T
            for a in range(0, len(r_own), 2048):
                mine = r_own[a : a + 2048]
                codes_ = np.frombuffer(b"".join([packed[i] for i in mine.tolist()]), dtype=np.uint8).reshape(len(mine), -1)
                for b in range(0, len(q_own), 2048):
                    asked_ = q_own[b : b + 2048]
                    est, err = estimates(codes_, f[mine], turned[b : b + 2048], epsilon)
                    i, j = np.nonzero(est + err[:, None] >= t[asked_])
                    out.append((q_rows[asked_[j]], row_ids[mine[i]]))
        q, r = (np.concatenate(x) for x in zip(*out))
        return pa.table({"q_row": pa.array(q, pa.int64()), "row_id": pa.array(r, pa.int64())})

    return r_side.groupBy("q_block", "r_block").cogroup(q_side.groupBy("q_block", "r_block")).applyInArrow(meet, "q_row long, row_id long")


def _measured(pairs: DataFrame, codes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q_row, query_id, vec_id, score): the k best of each query among its survivors, exactly measured on the original vectors."""
    with_rows = pairs.join(codes.select(F.col("row_id").alias("c_row"), "ids", "v"), F.col("row_id") == F.col("c_row"))
    both = with_rows.join(asked.select(F.col("q_row").alias("a_row"), "query_id", "q"), F.col("q_row") == F.col("a_row")).select("q_row", "query_id", "ids", "v", "q")

    def measure(parts: Iterator) -> Iterator:
        for part in parts:
            score = np.zeros(len(part))
            q = part.column("q")
            for _, own, m in _by_length(part.column("v")):
                _, _, other = next(_by_length(q.take(pa.array(own))))
                score[own] = (unit(m) * unit(other)).sum(axis=1)  # the same sum for equal vectors
            yield pa.RecordBatch.from_arrays([part.column("q_row"), part.column("query_id"), part.column("ids"), pa.array(score)], names=["q_row", "query_id", "ids", "score"])

    scored = both.mapInArrow(measure, "q_row long, query_id long, ids array<long>, score double")
    each = scored.select("q_row", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return _best(each.groupBy("q_row", "query_id", "vec_id").agg(F.max("score").alias("score")), "q_row", k)


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, epsilon: float = 2.5, code_bits: int = 512, sample_rows: int = 4096, growth: int = 4, query_block: int = 16_384, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors (vec_id, embedding) for each row of queries (vec_id, embedding).

    A query's own vec_id is no candidate. Unusable vectors (see usable) take no part, nor do pairs of unlike length; other columns aren't
    read. Fewer candidates than k: all of them. Ties go to the smaller vec_id; repeated rows of a vec_id count once, with their best score.
    No usable vector or query: no rows. The first sample has about sample_rows vectors, each next one is growth times as large.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("v")).where("v is not null and vec_id is not null")
    codes = coded(rows, k, code_bits, seed)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), usable(F.col("embedding")).alias("q")).where("q is not null and query_id is not null").distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("q_row"), "query_id", "q"), "queries")
    n_rows, n_queries = codes.count(), asked.count()  # from the files' footers; the number of blocks grows with the input, not their size
    query_blocks = -(-max(1, n_queries) // query_block)
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64(F.lit(seed), "q_row"), F.lit(query_blocks)).cast("int"))
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "row_id"), F.lit(1 << 40))
    part = lambda n: codes.where(place < int(min(1.0, n / max(1, n_rows)) * (1 << 40)))  # noqa: E731  nested samples
    t = written(_first_thresholds(asked, part(sample_rows), query_blocks, k), "first")
    found = _measured(t.select("q_row", F.explode("near").alias("row_id")), codes, asked, k)
    size = sample_rows
    while True:
        size = size * growth if size * growth * 2 < n_rows else n_rows
        inside = part(size) if size < n_rows else codes
        known = written(t.select(F.col("q_row").alias("t_row"), "t"), "thresholds")
        held = asked.join(known, F.col("q_row") == F.col("t_row")).drop("t_row")
        row_blocks = -(-max(1, size) // min(65_536, max(4096, size // 64)))
        pairs = written(_survivors(inside, held, row_blocks, query_blocks, epsilon, code_bits, seed), "survivors")
        best = found.unionByName(_measured(pairs, codes, asked, k)).drop("rank")  # what was measured before isn't lost
        found = _best(best.groupBy("q_row", "query_id", "vec_id").agg(F.max("score").alias("score")), "q_row", k)
        if size >= n_rows:
            once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            return _best(once, "query_id", k).select("query_id", "rank", "vec_id", "score")
        found = written(found, "found")
        better = found.groupBy(F.col("q_row").alias("b_row")).agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
        t = held.join(better, F.col("q_row") == F.col("b_row"), "left").select("q_row", F.greatest("t", F.col("kth") - 1e-9).alias("t"))


def op7_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all vectors for every vector whose id 50 divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
