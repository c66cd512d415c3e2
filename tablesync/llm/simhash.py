"""Op 2: near duplicates by SimHash with pigeonring filtering.

A fingerprint has 64 bits in 4 segments of 16 on a ring. If two differ in at most 3 bits, some segment starts a chain whose 1, 2, 3 and 4
consecutive segments together differ in at most 0, 1, 2 and 3 bits (length x 3 / 4, rounded down). So pairs are looked up by a segment
that is equal and a next one that differs in one bit at most: every fingerprint is stored under 4 keys of 32 bits and asked for under
4 x 17. The longer chains prune what the lookup finds; the full Hamming distance decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_classes, table, text_udf, written
from .graph import components

SEGMENTS, SEGMENT_BITS = 4, 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text, repeats included; 0 for a text without words."""
    import xxhash

    words = text.encode().lower().split() if text else []  # bytes: lower() touches A-Z alone and split() cuts at ASCII white space
    if not words:
        return 0
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(line, seed)]
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *[e + 1 for e in ends]]
        hashes = [h(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), 255):
        ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs, each row packed whole into a struct column row, with its fingerprint fp. Null text: 0."""
    from pyspark.sql.types import LongType

    def start():
        import pyarrow as pa

        return lambda texts: pa.array([fingerprint(t, shingle) for t in texts], pa.int64())

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_udf(LongType(), start)(F.col("text").cast("string")).alias("fp"))


def _turned(x: Column, by: Column) -> Column:
    """x rotated right by a number of bits."""
    return F.when(by == 0, x).otherwise(F.call_function("shiftrightunsigned", x, by).bitwiseOR(F.call_function("shiftleft", x, 64 - by)))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a < b) of different fingerprints of fps (fp, distinct) that differ in 3 bits or fewer. Complete: nothing is capped."""
    low = F.lit((1 << 2 * SEGMENT_BITS) - 1)
    at = F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)]))
    placed = fps.select("fp", at.alias("seg")).select("fp", "seg", _turned(F.col("fp"), F.col("seg") * SEGMENT_BITS).bitwiseAND(low).alias("low"))
    key = lambda flip: F.struct("seg", flip.alias("key"))
    stored = placed.select(F.col("fp").alias("b"), F.col("seg").alias("b_seg"), F.col("low").alias("b_key"))
    flips = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << (SEGMENT_BITS + k)).cast("long") for k in range(SEGMENT_BITS)]))
    asked = placed.select(F.col("fp").alias("a"), "seg", "low", flips.alias("flip")).select("a", "seg", F.col("low").bitwiseXOR(F.col("flip")).alias("key"))
    # a merge join always: Spark doesn't see that explode multiplies rows, so it would broadcast the keys of a table of fingerprints that is far too large for it
    met = asked.join(stored.hint("merge"), (F.col("key") == F.col("b_key")) & (F.col("seg") == F.col("b_seg")) & (F.col("a") < F.col("b")))
    apart = _turned(F.col("a").bitwiseXOR(F.col("b")), F.col("seg") * SEGMENT_BITS)
    chain = F.bit_count(apart.bitwiseAND(F.lit((1 << 3 * SEGMENT_BITS) - 1))) <= 2
    return met.where(chain).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3).select("a", "b").distinct()


def near_duplicates(fps: DataFrame) -> DataFrame:
    """(fp, n, root, component_id, group_rows) for each fingerprint of fps (doc_id, fp): n rows have it, and component_id is the least doc_id of
    all documents that links reach.

    Equal fingerprints are one class. Null doc_ids don't count for component_id, which is null where a group has no other.
    """
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    linked = components(links(classes.select("fp")))
    roots = written(classes.join(linked.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    groups = roots.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component_id"), F.sum("n").alias("group_rows"), F.count("*").alias("n_fps"))
    return join_classes(roots, groups, "root", "n_fps", roots.count(), merge=True).select("fp", "n", "root", "component_id", "group_rows")


def one_of_each_group(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs without all but one row of each group of near duplicates: the row of the least doc_id stays.

    Of rows that repeat this doc_id and text one stays. A group whose doc_ids are all null keeps one row of its least fingerprint. Texts
    without words, null and empty ones included, are one group. No rows: no rows. Copies of one text are not brought together in a task.
    """
    from pyspark.sql import Window

    held = written(fingerprints(docs, shingle), "fingerprints")
    ids = held.select(F.col("row.doc_id").alias("doc_id"), "fp")
    groups = written(near_duplicates(ids), "groups")
    crowded = groups.where("group_rows > 1").select(F.col("fp").alias("of_fp"), F.col("n").alias("fp_rows"), "root", "component_id")
    rows = join_classes(ids, crowded, "fp", "fp_rows", held.count(), merge=True).groupBy("doc_id", "fp", "root", "component_id").agg(F.count("*").alias("n"))
    winners = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = winners.groupBy(F.col("root").alias("win_root")).agg(F.min("fp").alias("win_fp"))
    kept = winners.join(first, (F.col("root") == F.col("win_root")) & (F.col("fp") == F.col("win_fp")))
    single, repeated = kept.where("n = 1"), kept.where("n > 1").select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp"))
    gone = rows.join(single.select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp")), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("fp") == F.col("k_fp")), "left_anti")
    same = lambda i, f: F.col("row.doc_id").eqNullSafe(F.col(i)) & (F.col("fp") == F.col(f))
    plain = held.join(gone.select(F.col("doc_id").alias("g_id"), F.col("fp").alias("g_fp")), same("g_id", "g_fp"), "left_anti")
    one = held.join(repeated, same("k_id", "k_fp"), "left_semi").select("fp", "row", F.col("row.doc_id").alias("doc_id")).dropDuplicates(["fp", "doc_id"])
    return plain.select("row.*").union(one.select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fps = written(fingerprints(docs).select(F.col("row.doc_id").alias("doc_id"), "fp"), "fps")
    groups = written(near_duplicates(fps).withColumnRenamed("fp", "of_fp"), "groups")
    joined = join_classes(fps, groups, "fp", "n", fps.count(), merge=True)
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
