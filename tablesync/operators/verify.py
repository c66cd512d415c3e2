"""Checksums of stored content against what is recorded: of bodies, of dumps of many parts, and trees of hashes over rows.

A tree has a row's hash at the bottom. Rows fall into blocks by the first hexadecimal digits of a hash of their key; a block's digest is
that of the number and the sums of its rows' hashes, so it doesn't hang on order and adds up from partial sums. Above it each node has the
digest of its 16 children at most, up to one root. Rows never meet in one task or value, whatever their number and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import checksum_text


def content_sums(bodies: DataFrame) -> DataFrame:
    """(id, size_bytes, checksum) of bodies (id, content), one per id."""
    return bodies.select("id", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size_bytes"), checksum_text(F.coalesce(F.col("content").cast("binary"), F.lit(b""))).alias("checksum"))


def dump_sums(parts: DataFrame) -> DataFrame:
    """(id, size_bytes, checksum) of dumps of many parts (id, part, content).

    Parts fall into 4,096 blocks by the hash of their name; a block's hash is that of its parts' hashes in order, a dump's that of its
    blocks' hashes in order, one per line. So contents never meet, and of a dump with any number of parts only a block's hashes do.
    """
    each = parts.select("id", "part", F.octet_length("content").cast("long").alias("n"), F.sha2(F.col("content").cast("binary"), 256).alias("h"), F.substring(F.sha2(F.col("part").cast("string").cast("binary"), 256), 1, 3).alias("block"))

    def together(key: str):
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n").cast("binary"), 256)

    blocks = each.groupBy("id", "block").agg(F.sum("n").alias("n"), together("part").alias("h"))
    return blocks.groupBy("id").agg(F.sum("n").alias("size_bytes"), F.concat(F.lit("sha256:"), together("block")).alias("checksum"))


def verify(recorded: DataFrame, computed: DataFrame) -> DataFrame:
    """(id, recorded, computed, ok) for every recorded (id, checksum): an empty record passes, a missing body does not."""
    c = computed.select(F.col("id").alias("c_id"), F.col("checksum").alias("computed"))
    met = recorded.select("id", F.coalesce("checksum", F.lit("")).alias("recorded")).join(c, F.col("id") == F.col("c_id"), "left")
    return met.select("id", "recorded", "computed", (F.col("computed").isNotNull() & ((F.col("recorded") == "") | (F.col("recorded") == F.col("computed")))).alias("ok"))


def _row_text(rows: DataFrame, columns: list[str]) -> Column:
    """Columns as JSON that doesn't hang on the session: absent values stay, times have all digits, in UTC."""
    options = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), options)


def content_blocks(rows: DataFrame, keys: list[str] | None = None, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """(by ..., block, n, digest): the leaves of a tree for each value of the columns by, which aren't part of the content.

    keys place a row (by default all of it does): a row that changed without them stays in its block. digits: 16 ** digits blocks.
    """
    by = list(by or [])
    content = [c for c in rows.columns if c not in by]
    hashed = rows.select(*by, F.sha2(_row_text(rows, content).cast("binary"), 256).alias("_h"), *([F.sha2(F.concat_ws("\0", *[F.col(f"`{k}`").cast("string") for k in keys]).cast("binary"), 256).alias("_k")] if keys else []))
    number = lambda at: F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(28,0)")
    summed = hashed.groupBy(*by, F.substring("_k" if keys else "_h", 1, digits).alias("block")).agg(F.count("*").alias("n"), F.sum(number(1)).alias("_a"), F.sum(number(16)).alias("_b"))
    return summed.select(*by, "block", "n", F.sha2(F.concat_ws(":", "n", "_a", "_b").cast("binary"), 256).alias("digest"))


def tree_roots(blocks: DataFrame, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """(by ..., n, digest) of the trees over blocks: level by level a node is the digest of its children, 16 at most, in order."""
    by, level = list(by or []), blocks.select(*list(by or []), "block", "n", "digest")
    for d in range(digits - 1, -1, -1):
        children = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "block", "digest"))), "\n")
        level = level.groupBy(*by, F.substring("block", 1, d).alias("_up")).agg(F.sum("n").alias("n"), F.sha2(children.cast("binary"), 256).alias("digest")).withColumnRenamed("_up", "block")
    return level.select(*by, "n", "digest")


def differing_blocks(recorded: DataFrame, found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by ..., block, n_recorded, n_found) of the blocks whose content isn't the same; a block that one side lacks has 0 rows there."""
    on = [*(by or []), "block"]
    r = recorded.select(*on, F.col("n").alias("n_recorded"), F.col("digest").alias("d_recorded"))
    f = found.select(*on, F.col("n").alias("n_found"), F.col("digest").alias("d_found"))
    zero = F.lit(0).cast("long")
    met = r.join(f, on, "full_outer").where(~F.col("d_recorded").eqNullSafe(F.col("d_found")))
    return met.select(*on, F.coalesce("n_recorded", zero).alias("n_recorded"), F.coalesce("n_found", zero).alias("n_found"))
