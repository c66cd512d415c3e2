"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A round over so many counted edges at most broadcasts the least neighbours, so that a hub's edges stay spread; a larger one merges. Spark
#: isn't asked: edges take far less room in Parquet, by which it would choose, than in memory.
SMALL = 50_000


def _large_star(edges: DataFrame, how: str = "merge") -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "of")
    return both.where("b > a").join(least.hint(how), F.col("a") == F.col("of")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, how: str = "merge") -> DataFrame:
    """A node and its neighbours below it are tied to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "of")
    near = edges.join(least.hint(how), F.col("b") == F.col("of")).select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("of").alias("y"))
    return near.union(own).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a < b, both long): root is the least node that paths reach.

    Each round is written to the shared folder, so lost executors cost at most a round. No edges: no rows.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    stars = written(edges.select("a", "b").distinct(), "edges")
    before = state(stars)
    for _ in range(max_rounds):
        how = "broadcast" if before[0] <= SMALL else "merge"
        stars = written(_small_star(_large_star(stars, how), how), "stars")
        after = state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).union(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
