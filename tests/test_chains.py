import datetime
import random

import pytest
from pyspark.sql import functions as F

from tablesync.model import MANIFEST, RetentionPolicy
from tablesync.operators import chains, retention
from tablesync.plans.backup import prune

NOW = datetime.datetime(2026, 3, 15, 12)


def day(n):
    return NOW - datetime.timedelta(days=n)


def manifest(spark, rows):
    """rows: (id, created, base, parent) with optional profile."""
    full = [{"id": r[0], "created": r[1], "base_id": r[2], "parent_id": r[3], "profile": r[4] if len(r) > 4 else "p", "driver": "postgres", "size_bytes": 100} for r in rows]
    return spark.createDataFrame([tuple(x.get(n) for n in MANIFEST.names) for x in full], MANIFEST)


#: A dump alone, a base with a forked chain on it, and one whose base is gone.
CASES = [("solo", day(60), "", ""), ("may", day(44), "may", ""), ("may+1", day(43), "may", "may"), ("may+2", day(41), "may", "may+1"), ("stray", day(6), "april", "april")]


def test_grouping(spark):
    got = {r.root: (r.members, r.bytes) for r in chains.group(manifest(spark, CASES)).collect()}
    assert got == {"solo": (1, 100), "may": (3, 300), "april": (1, 100)}


def test_resolution(spark):
    m = manifest(spark, [*CASES, ("c1", day(3), "b", "c2"), ("c2", day(2), "b", "c1"), ("behind", day(1), "b", "c1"), ("np", day(1), "b", "")])
    got = {r.id: (r.status, r.broken_at, r.depth) for r in chains.resolve(m).collect()}
    assert got["may+2"] == ("ok", None, 2) and got["solo"] == ("ok", None, 0)
    assert got["stray"][:2] == ("missing parent", "april") and got["np"][0] == "no parent"
    assert [got[i] for i in ("c1", "c2", "behind")] == [("cycle", None, None)] * 3
    every = {(r.target, r.link_no, r.id) for r in chains.links(m).collect()}
    assert every == {("solo", 0, "solo"), ("may", 0, "may"), ("may+1", 0, "may"), ("may+1", 1, "may+1"), ("may+2", 0, "may"), ("may+2", 1, "may+1"), ("may+2", 2, "may+2")}
    links = chains.links(m, ["may+2", "stray", "c1"])
    assert [r.id for r in chains.up_to(links, "may+1").orderBy("link_no").collect()] == ["may", "may+1"]
    with pytest.raises(ValueError):
        chains.up_to(links, "solo")
    stops = lambda last: spark.createDataFrame([("may+2", last)], "target string, last string")
    assert [r.id for r in chains.up_to_each(links, stops("may+1")).orderBy("link_no").collect()] == ["may", "may+1"]
    with pytest.raises(Exception, match="no part of the chain"):
        chains.up_to_each(links, stops("solo")).collect()


def test_a_chain_of_ten_thousand_links(spark):
    n = 10_000
    rows = spark.range(n).select(F.format_string("d%05d", "id").alias("id"), F.lit("d00000").alias("base_id"), F.when(F.col("id") == 0, "").otherwise(F.format_string("d%05d", F.col("id") - 1)).alias("parent_id"))
    found = chains.resolve(rows)
    assert found.where("status = 'ok'").agg(F.count("*"), F.max("depth")).first() == (n, n - 1)
    got = chains.links(rows, ["d09999", "d00003"], found)
    assert got.where("target = 'd09999' and id = format_string('d%05d', link_no)").count() == n and got.count() == n + 4


def passes(members, root):
    """Apply order by repeated passes over members in time order."""
    todo, done, out = sorted(members, key=lambda m: (m[1], m[0])), set(), []
    ids = {m[0] for m in members}
    for m in [m for m in todo if m[0] == root]:
        out.append(m[0])
        done.add(m[0])
    todo = [m for m in todo if m[0] != root]
    while todo:
        ready = [m for m in todo]
        left, moved = [], False
        for m in ready:
            if m[3] in done or m[3] in ("", root, m[0]) or m[3] not in ids:
                out.append(m[0])
                done.add(m[0])
                moved = True
            else:
                left.append(m)
        todo = left
        if not moved:
            return out + [m[0] for m in todo]
    return out


def test_member_order_on_random_chains(spark):
    rng, rows, want = random.Random(5), [], {}
    for c in range(40):
        names = [f"c{c}m{i}" for i in range(rng.randint(1, 8))]
        members = []
        for i, n in enumerate(names):
            parent = "" if i == 0 else rng.choice([names[0], rng.choice(names), "", "elsewhere"])
            members.append((n, day(rng.randint(0, 4)), names[0] if i else rng.choice(["", names[0]]), parent))
        rows += members
        want[names[0]] = passes(members, names[0])
    got = {}
    for r in sorted(chains.member_order(manifest(spark, rows)).collect(), key=lambda r: r.member_no):
        got.setdefault(r.root, []).append(r.id)
    assert got == want


def test_delete_order_stops_at_failures(spark):
    members = chains.member_order(manifest(spark, CASES))
    failed = spark.createDataFrame([("may+1",)], "id string")
    got = chains.delete_order(members.where("root = 'may'"), failed).orderBy("delete_no").collect()
    assert [r.id for r in got] == ["may+2", "may+1"]


def test_compatibility(spark):
    m = manifest(spark, CASES).withColumn("driver", F.when(F.col("id") == "may+2", "mysql").otherwise(F.col("driver")))
    assert [(r.id, r.reason) for r in chains.incompatible(m).collect()] == [("may+2", "driver")]


# ------------------------------------------------------------------ retention


def kept(spark, rows, policy):
    planned = retention.plan_one_pool(retention.chains_by_profile(manifest(spark, rows)), policy, NOW)
    one = {r.root for r in planned.where("decision = 'keep'").collect()}
    limits = spark.createDataFrame([("p", *[getattr(policy, f) for f in retention.FIELDS])], "profile string, " + ", ".join(f"{f} long" for f in retention.FIELDS))
    each = {r.root for r in retention.plan(retention.chains_by_profile(manifest(spark, rows)), limits, NOW).where("decision = 'keep'").collect()}
    assert one == each  # both ways to plan agree
    return one


FIVE = [(f"f{i}", day(i), "", "") for i in range(5)]


def test_rules(spark):
    assert kept(spark, FIVE, RetentionPolicy()) == {f"f{i}" for i in range(5)}
    assert kept(spark, FIVE, RetentionPolicy(keep_last=2)) == {"f0", "f1"}
    assert kept(spark, FIVE, RetentionPolicy(max_age_seconds=2 * 86400)) == {"f0", "f1"}
    assert kept(spark, CASES, RetentionPolicy(max_age_seconds=42 * 86400)) == {"may", "april"}  # the newest member counts
    assert kept(spark, FIVE, RetentionPolicy(keep_last=1, gfs_monthly=9)) == {"f0"}
    twice = [*FIVE, ("late", day(1) + datetime.timedelta(hours=3), "", "")]
    assert kept(spark, twice, RetentionPolicy(gfs_daily=2)) == {"f0", "late"}
    gaps = [("a", day(0), "", ""), ("b", day(20), "", ""), ("c", day(40), "", ""), ("d", day(41), "", "")]
    assert kept(spark, gaps, RetentionPolicy(gfs_daily=3)) == {"a", "b", "c"}
    assert kept(spark, gaps, RetentionPolicy(gfs_weekly=2)) == {"a", "b"}
    assert kept(spark, [("x", day(1), "", ""), ("w", day(1), "", "")], RetentionPolicy(keep_last=1)) == {"w"}


def test_policies(spark):
    with pytest.raises(ValueError):
        RetentionPolicy(keep_last=-1)
    fields = ", ".join(f"{f} long" for f in retention.FIELDS)
    rows = spark.createDataFrame([("", 7, 0, 0, 0, 0), ("own", 0, 60, 0, 0, 0)], f"profile string, {fields}")
    profiles = spark.createDataFrame([("own",), ("other",)], "profile string")
    got = {r.profile: (r.keep_last, r.max_age_seconds) for r in retention.effective_policies(profiles, rows).collect()}
    assert got == {"own": (0, 60), "other": (7, 0)}
    got = {r.profile: r.keep_last for r in retention.effective_policies(profiles, rows, {"keep_last": 3}).collect()}
    assert got == {"own": 3, "other": 3}
    with pytest.raises(Exception, match="negative"):
        retention.effective_policies(profiles, rows, {"keep_last": -1}).collect()


def test_prune_job(spark):
    m = manifest(spark, [("keep", day(0), "", ""), *CASES[1:4], ("other", day(90), "", "", "q")])
    planned, report, order = prune(m, RetentionPolicy(keep_last=1), NOW, profile="p")
    assert {r.decision: (r.chains, r.dumps, r.bytes) for r in report.collect()} == {"keep": (1, 1, 100), "prune": (1, 3, 300)}
    assert [r.id for r in order.orderBy("delete_no").collect()] == ["may+2", "may+1", "may"]
