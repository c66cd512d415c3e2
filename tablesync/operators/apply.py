"""Applying changes to a table.

Replaying an ordered log row by row equals a closed form. Per key let d be the last delete and s the first insert behind it. A row that has
no delete keeps the base, with the latest update of each column on top; otherwise the insert at s, with the updates behind s, is the row, or
there is none. The latest update of a column over the whole log suffices: if it lies before d (or s), so do all others. So updates and
deletes fold in one aggregation with map-side partial results, and only inserts meet d again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .changes import typed


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _keys(changes: DataFrame, schema: StructType, keys: list[str]) -> DataFrame:
    """changes with typed key columns k_<name>."""
    return changes.select("*", *[typed(F.element_at("key", k), schema, k).alias(f"k_{k}") for k in keys])


def fold(changes: DataFrame, schema: StructType, keys: list[str], order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row per complete key: what the log does to it, without looking at the base.

    order: columns of changes that order it, unique together. Result: k_<key>, has_delete, s (order of the insert, null if none), i_<col>
    (insert's value) and u_<col> (struct(at, v) of the latest update that has the column).
    """
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)  # a plain number keeps the search for deletes in hash aggregates
    keyed = _keys(changes, schema, keys).withColumn("at", at)
    complete = keyed.where(_all([F.col(f"k_{k}").isNotNull() for k in keys]))
    names, by = [f.name for f in schema if f.name not in keys], [f"k_{k}" for k in keys]
    held = lambda c: F.map_contains_key("values", F.lit(c))
    value = lambda c: typed(F.element_at("values", F.lit(c)), schema, c)
    deletes = F.max(F.when(F.col("op") == "delete", F.col("at"))).alias("d")
    n_inserts = F.count_if(F.col("op") == "insert").alias("n_inserts")
    updates = [F.max(F.when((F.col("op") == "update") & held(c), F.struct("at", value(c).alias("v")))).alias(f"u_{c}") for c in names]
    folded = complete.groupBy(*by).agg(deletes, *updates)
    last = complete.where("op <> 'update'").groupBy(*by).agg(deletes, n_inserts).where("n_inserts > 0").select(*[F.col(b).alias(f"d_{b}") for b in by], "d")
    inserts = complete.where("op = 'insert'").join(last, _all([F.col(b) == F.col(f"d_{b}") for b in by])).where("d is null or at > d")
    first = inserts.groupBy(*by).agg(F.min(F.struct("at", *[value(c).alias(f"v_{c}") for c in names])).alias("i"))
    first = first.select(*[F.col(b).alias(f"i_{b}") for b in by], F.col("i.at").alias("s"), *[F.col(f"i.v_{c}").alias(f"i_{c}") for c in names])
    out = folded.join(first, _all([F.col(b) == F.col(f"i_{b}") for b in by]), "left")
    return out.select(*by, F.col("d").isNotNull().alias("has_delete"), "s", *[f"i_{c}" for c in names], *[f"u_{c}" for c in names])


def null_key_inserts(changes: DataFrame, schema: StructType, keys: list[str]) -> DataFrame:
    """Inserts with a NULL in the key: it equals nothing, so each is a row of its own, and no other change meets it."""
    keyed = _keys(changes, schema, keys).where((F.col("op") == "insert") & ~_all([F.col(f"k_{k}").isNotNull() for k in keys]))
    return keyed.select(*[(F.col(f"k_{f.name}") if f.name in keys else typed(F.element_at("values", F.lit(f.name)), schema, f.name)).alias(f.name) for f in schema])


def merge(target: DataFrame, changes: DataFrame, keys: list[str], order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """target after all changes, as if replayed one by one; target's columns, one full outer join on the key."""
    schema = target.schema
    folded = fold(changes, schema, keys, order)
    base = target.withColumn("_base", F.lit(True))
    joined = base.join(folded, _all([F.col(k) == F.col(f"k_{k}") for k in keys]), "full_outer")
    stays = F.col("_base").isNotNull() & ~F.coalesce(F.col("has_delete"), F.lit(False))
    kept = joined.where(stays | F.col("s").isNotNull())

    def column(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"k_{c}"))
        update = F.col(f"u_{c}")
        on_base = F.when(update.isNotNull(), update["v"]).otherwise(F.col(c))
        on_insert = F.when(update["at"] > F.col("s"), update["v"]).otherwise(F.col(f"i_{c}"))
        return F.when(stays, on_base).otherwise(on_insert)

    return kept.select(*[column(f.name).alias(f.name) for f in schema]).unionByName(null_key_inserts(changes, schema, keys))


def insert_ignore(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target and the inserts whose key it lacks, the first by seq of each key."""
    schema = target.schema
    inserts = _keys(changes.where("op = 'insert'"), schema, keys).where(_all([F.col(f"k_{k}").isNotNull() for k in keys]))
    values = [typed(F.element_at("values", F.lit(f.name)), schema, f.name).alias(f.name) for f in schema if f.name not in keys]
    first = inserts.groupBy(*[f"k_{k}" for k in keys]).agg(F.min_by(F.struct(F.lit(1).alias("_"), *values), "seq").alias("v"))
    rows = first.select(*[F.col(f"k_{k}").alias(k) for k in keys], *[f"v.{f.name}" for f in schema if f.name not in keys])
    new = rows.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new).unionByName(null_key_inserts(changes, schema, keys))


def update_by_key(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target with the columns that updates hold set, the latest of each; a key without a row changes nothing."""
    return merge(target, changes.where("op = 'update'"), keys)


def delete_by_key(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target without the rows whose key is deleted; a key without a row changes nothing."""
    gone = _keys(changes.where("op = 'delete'"), target.schema, keys).select(*[F.col(f"k_{k}").alias(k) for k in keys]).distinct()
    return target.join(gone, keys, "left_anti")
