import random

import pytest
from pyspark.sql import functions as F

from tablesync.llm.common import join_classes
from tablesync.llm.graph import _large_star, _small_star, components
from tablesync.llm.simhash import fingerprint, fingerprints, links, near_duplicates, one_of_each_group

from .conftest import odd_rows

M = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def by_hand(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [r[1] for r in odd_rows()] + ["a", "A b", "É É É É", "x y z", "a b c a b c a b c"])
def test_fingerprint_by_hand(text):
    assert fingerprint(text) & M == by_hand(text)


def test_links_are_complete(spark):
    rng = random.Random(0)
    made = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        made.add(x)
        for _ in range(4):
            made.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    made |= {0, M, 1, M ^ 7}
    made = sorted(map(signed, made))
    want = {(a, b) for i, a in enumerate(made) for b in made[i + 1 :] if bin((a ^ b) & M).count("1") <= 3}
    got = links(spark.createDataFrame([(x,) for x in made], "fp long"))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(1000, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, 1000: 1000, 1001: 1000}


def test_groups_and_what_stays(odd, clashing, empty):
    groups = {r.doc_id: r.component_id for r in near_duplicates(fingerprints(odd).select("row.doc_id", "fp")).join(fingerprints(odd).select("row.doc_id", "fp"), "fp").collect()}
    assert groups[9] == 8 and groups[5] == 2 == groups[3]  # texts without words are one group
    kept = one_of_each_group(clashing).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "None", "4", "6", "7", "8", "-3"])
    assert kept[0].asDict().keys() == dict.fromkeys(clashing.columns).keys()
    assert one_of_each_group(empty).count() == 0


def test_groups_of_null_ids_keep_one(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "f g h i j"), (4, "k l m n"), (4, "o p q r")], "doc_id long, text string")
    assert sorted(r.text for r in one_of_each_group(docs).collect()) == ["a b c d e", "f g h i j", "k l m n", "o p q r"]


def test_a_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words in a third of all rows").otherwise(F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i))).cast("binary")) for i in range(5)])).alias("text"))
    assert one_of_each_group(docs).count() == 2001


def joins(df):
    """Kinds of the joins that Spark plans at first, before it has seen any size."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: plan.count(k + " [") + plan.count(k + "(skew") for k in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")}


def test_tables_that_grow_are_not_broadcast(spark, tmp_path):
    """Small in Parquet, and smaller than they are by Spark's estimate: still merge joins. Of classes the heavy ones alone are broadcast."""
    spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    for df in (links(edges.select(F.col("a").alias("fp"))), _large_star(edges), _small_star(edges)):
        assert joins(df) == {"BroadcastHashJoin": 0, "SortMergeJoin": 1, "ShuffledHashJoin": 0}
    classes = edges.groupBy(F.col("a").alias("of_a")).agg(F.count("*").alias("n"))
    found = joins(join_classes(edges, classes, "a", "n", 50, merge=True))
    assert found["BroadcastHashJoin"] == 3 and found["SortMergeJoin"] == 1


def test_components_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tablesync.llm.graph.SMALL", 0)
    edges = [(0, 3), (1, 3), (1, 2), (5, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5}
