import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablesync.model import CHANGE
from tablesync.operators import apply, changes

SCHEMA = "id long, a string, b decimal(10,2)"


def replay(base, log):
    rows, extra = {k: dict(v) for k, v in base.items()}, []
    for op, key, values in log:
        if key is None:
            if op == "insert":
                extra.append((None, values.get("a"), values.get("b")))
        elif op == "insert":
            rows.setdefault(key, {"a": values.get("a"), "b": values.get("b")})
        elif op == "update" and key in rows:
            rows[key].update(values)
        elif op == "delete":
            rows.pop(key, None)
    return sorted([(k, v["a"], v["b"]) for k, v in rows.items()] + extra, key=str)


def as_changes(spark, log):
    text = lambda v: None if v is None else str(v)
    return spark.createDataFrame([(Decimal(i), i, op, "t", {"id": text(k)}, {c: text(x) for c, x in v.items()}) for i, (op, k, v) in enumerate(log, 1)], CHANGE)


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_replay(spark, seed):
    rng = random.Random(seed)
    base = {k: {"a": f"s{k}", "b": Decimal(k)} for k in rng.sample(range(40), 20)}
    log = []
    for _ in range(600):
        op = rng.choice(["insert", "update", "update", "delete"])
        names = [c for c in "ab" if op == "insert" or rng.random() < 0.6] if op != "delete" else []
        values = {c: rng.choice([None, "x", "y"]) if c == "a" else rng.choice([None, Decimal("1.50"), Decimal(7)]) for c in names}
        log.append((op, rng.choice([None, *range(40)]), values))
    target = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in base.items()], SCHEMA)
    got = sorted([tuple(r) for r in apply.merge(target, as_changes(spark, log), ["id"]).collect()], key=str)
    assert got == replay(base, log)


def test_single_operations(spark):
    target = spark.createDataFrame([(1, "oak", None), (2, "elm", Decimal(2))], SCHEMA)
    log = as_changes(spark, [("insert", 1, {"a": "other"}), ("insert", 3, {"a": "ash"}), ("insert", 3, {"a": "later"}), ("update", 1, {"a": "yew"}), ("update", 9, {"a": "none"}), ("delete", 2, {})])
    rows = lambda df: sorted((r.id, r.a) for r in df.collect())
    assert rows(apply.insert_ignore(target, log, ["id"])) == [(1, "oak"), (2, "elm"), (3, "ash")]
    assert rows(apply.update_by_key(target, log, ["id"])) == [(1, "yew"), (2, "elm")]
    assert rows(apply.delete_by_key(target, log, ["id"])) == [(1, "oak")]
    assert rows(apply.merge(target, log, ["id"])) == [(1, "yew"), (3, "ash")]


def test_rejects_and_modes(spark):
    log = as_changes(spark, [("insert", 1, {"a": "x"}), ("update", 1, {"a": "y"}), ("truncate", 1, {}), ("insert", 2, {})])
    no_key = log.limit(1).select("pos", F.lit(9).cast("long").alias("seq"), F.lit("delete").alias("op"), "tbl", F.create_map().cast("map<string,string>").alias("key"), "values")
    only_key = log.limit(1).select("pos", F.lit(10).cast("long").alias("seq"), F.lit("update").alias("op"), "tbl", "key", F.col("key").alias("values"))
    every = log.unionByName(no_key).unionByName(only_key)
    assert {r.seq: r.reason for r in changes.rejects(every).collect()} == {3: "unknown operation", 4: "insert without columns", 9: "missing primary key", 10: "nothing to set"}
    assert changes.valid(every, "quarantine").count() == 2
    with pytest.raises(Exception, match="bad change"):
        changes.valid(every).collect()


def test_bounds_need_a_start(spark):
    with pytest.raises(ValueError):
        changes.bounded(as_changes(spark, []), None, 5)
    got = changes.bounded_binlog(spark.createDataFrame([("bin.000009", 5), ("bin.000010", 1), ("bin.000010", 9)], "file string, offset long"), (9, 5), (10, 1))
    assert [tuple(r) for r in got.collect()] == [("bin.000010", 1)]


def test_running_counts_across_blocks(spark):
    log = as_changes(spark, [("delete", 1, {})] * 25)
    assert [r.running for r in changes.running_applied(log, block=4).orderBy("seq").collect()] == list(range(1, 26))


def test_key_moves_are_counted(spark):
    log = as_changes(spark, [("update", 1, {"id": 2, "a": "x"}), ("update", 1, {"id": 1, "a": "x"})])
    assert changes.key_change_count(log).first().key_changes == 1
