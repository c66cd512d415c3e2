"""Op 13: lines that many documents repeat, kept in levelled sorted runs of line hashes.

A run is a bucketed, sorted table (h1, h2, n, keeper): 128 bits of hash of a line, the number of documents of some batches that hold it, and
the document that keeps it, which is the largest of the batch that brought it first. Each new batch sums up its own lines, is anti-joined
with the runs there are to find the lines it brings, and adds its own run. When a level holds fanout runs they are merged into one of the
next level, so a line is rewritten once a level and the runs to look into grow with the logarithm of the batches. All runs have the same
buckets: these joins are sort-merge joins of sorted files, without a shuffle.

Batches come in descending order of doc_id, so the one that brings a line first holds the largest doc_id with it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_classes, scratch, table
from .spelling import ascii_lower

_BLANK = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def split_lines(text: Column) -> Column:
    """The lines of a whole text; null and the empty text are one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_points: int = 40) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, first): the lines of docs (doc_id, text) whose key has min_points code points.

    first marks a key's first line in its row. A row is known by its doc_id and the hash of its text: rows that agree in both are alike.
    """
    keys = F.transform(split_lines(F.col("text")), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos")))
    long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.sort_array(F.filter(keys, lambda x: F.length(x["key"]) >= min_points)).alias("long"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("long.key"))  # sorted: a key's lines follow each other
    rows = long.select("doc_id", "text_hash", F.explode(F.arrays_zip(F.col("long"), before.alias("before"))).alias("x")).where("x.long is not null")
    key = F.col("x.long.key")
    return rows.select("doc_id", "text_hash", F.col("x.long.pos").alias("pos"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), (~key.eqNullSafe(F.col("x.before"))).alias("first"))


class LineRuns:
    """Levelled runs of line hashes. Runs are tables of this session whose files lie in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Names of the runs of each level, oldest first.
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _store(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", scratch(self.spark, name)).saveAsTable(name)
        self.made.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _on(self, a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        return a.join(b.hint("merge"), _HASH, how)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (doc_id, h1, h2), one row for each document and line. Batches are to come in descending order of doc_id."""
        summed = lines.groupBy(*_HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        own = self.spark.table(self._store(summed))
        new = reduce(lambda left, run: self._on(left, run.select(*_HASH), "left_anti"), self.runs(), own) if self.levels else own
        seen = self._on(own, new.select(*_HASH), "left_anti") if self.levels else own.limit(0)
        run = new.select(*_HASH, "n", F.col("top").alias("keeper")).unionByName(seen.select(*_HASH, "n", F.lit(None).cast("long").alias("keeper")))
        self._push(self._store(run), 0)

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._push(self._store(merged), level + 1)

    def _merged(self, names: list[str]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            other = b.select(*_HASH, F.col("n").alias("b_n"), F.col("keeper").alias("b_keeper"))
            zero = F.lit(0).cast("long")
            return self._on(a, other, "full_outer").select(*_HASH, (F.coalesce("n", zero) + F.coalesce("b_n", zero)).alias("n"), F.coalesce("keeper", "b_keeper").alias("keeper"))

        return reduce(two, [self.spark.table(n) for n in names])

    def totals(self) -> DataFrame:
        """(h1, h2, n, keeper) over all batches."""
        return self._merged([name for level in self.levels for name in level])

    def close(self) -> None:
        """Forget the tables; their files stay in the shared folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, *, min_points: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs (doc_id, text; other columns aren't read) as (doc_id, lines, kept): all lines of each row, and those that stay.

    Lines whose key has min_points code points and is in min_docs documents stay in that of the largest doc_id alone. A row is a document: rows that
    repeat a doc_id count again, and all rows of the largest doc_id keep the line. Null doc_ids are smaller than any other and keep a line
    only where no other document holds it. Null text is one empty line. No rows: no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "line-hashes")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = sum(((F.col("doc_id") <= c).cast("int") for c in cuts or []), F.lit(0))
    line_hashes(docs, min_points).withColumn("batch", F.coalesce(batch, F.lit(len(cuts or []) + 1))).write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema("doc_id long, text_hash long, pos int, h1 long, h2 long, first boolean, batch int").parquet(path)
    runs = LineRuns(spark, fanout=fanout)
    for b in range(len(cuts or []) + 2):  # the last one holds the rows without a doc_id
        runs.add(hashes.where((F.col("batch") == b) & F.col("first")).select("doc_id", *_HASH))
    often = runs.totals().where(F.col("n") >= min_docs).select(F.col("h1").alias("of_h1"), "h2", "n", "keeper")
    out = scratch(spark, "often")
    often.write.parquet(out)
    often = spark.read.schema(often.schema).parquet(out).withColumnRenamed("h2", "o_h2")
    total = hashes.count()
    runs.close()
    hit = join_classes(hashes.select("doc_id", "text_hash", "pos", "h1", "h2"), often, "h1", "n", total).where((F.col("h2") == F.col("o_h2")) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = hit.groupBy(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash")).agg(F.collect_set("pos").alias("drops"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), split_lines(F.col("text")).alias("lines"))
    met = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.when(F.size("drops") < F.size("lines"), F.transform(places, lambda i: F.get(F.col("lines"), i))).otherwise(F.array().cast("array<string>")))
    return met.select("doc_id", "lines", kept.alias("kept"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the lines of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
  k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  marked AS (SELECT k.doc_id, k.i, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS dropped FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""
