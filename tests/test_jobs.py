import datetime
import os
import shutil
import threading
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablesync.model import CHANGE, RetentionPolicy
from tablesync.operators import apply, verify
from tablesync.plans import backup
from tablesync.storage import Conflict, publish, published_table, published_tables, read_text
from tablesync.streaming.cdc import Table, Target, apply_stream, cdc, change_stream

from .conftest import SF

DAY = datetime.datetime(2026, 1, 1)


def changes(spark, rows):
    return spark.createDataFrame([(Decimal(p), p, op, t, {"id": str(k)}, v) for p, op, t, k, v in rows], CHANGE)


def widgets(spark):
    return spark.createDataFrame([(1, "bolt"), (2, "leaving")], "id int, name string")


def names(df):
    return {r.id: r.name for r in df.collect()}


def target_of(spark, root, pos, **options):
    table = Target(spark, root, {"widgets": Table(widgets(spark).schema, ["id"])}, **options)
    table.create({"widgets": widgets(spark)}, pos)
    return table


def test_backup_chain(spark, tmp_path):
    root, common = f"file://{tmp_path}", {"profile": "p", "driver": "postgres"}
    log = changes(spark, [(1, "insert", "widgets", 3, {"id": "3", "name": "fresh"}), (2, "update", "widgets", 1, {"name": "screw"}), (3, "delete", "widgets", 2, {}), (4, "delete", "other", 1, {}), (5, "insert", "widgets", 9, {"name": "late"})])
    backup.full_backup({"widgets": widgets(spark), "parts": widgets(spark)}, root, "base", created=DAY, end_pos=0, exclude_data=["parts"], **common)
    backup.incremental_backup(log, root, "inc1", parent_id="base", created=DAY, end_pos=2, **common)
    backup.incremental_backup(log, root, "inc2", parent_id="inc1", created=DAY, end_pos=4, **common)
    keys = {"widgets": ["id"], "parts": ["id"]}
    got = backup.restore(spark, root, "inc2", keys, driver="postgres")
    assert names(got["widgets"]) == {1: "screw", 3: "fresh"} and got["parts"].count() == 0
    assert names(backup.restore(spark, root, "inc2", keys, driver="postgres", up_to="inc1", tables=["widgets"])["widgets"]) == {1: "screw", 2: "leaving", 3: "fresh"}
    assert names(backup.restore(spark, root, "base", keys, driver="postgres")["widgets"]) == {1: "bolt", 2: "leaving"}
    with pytest.raises(ValueError):
        backup.restore(spark, root, "inc2", keys, driver="postgres", up_to="nope")
    with pytest.raises(backup.Incompatible):
        backup.restore(spark, root, "inc2", keys, driver="mysql")
    with pytest.raises(backup.Incompatible):
        backup.incremental_backup(log, root, "x", parent_id="base", created=DAY, end_pos=2, profile="other", driver="postgres")
    assert all(r.ok for r in backup.verify_dumps(spark, root).collect())
    assert backup.damaged_blocks(spark, root, "inc1").count() == 0
    part = next((tmp_path / "data" / "inc1").rglob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert {r.id: r.ok for r in backup.verify_dumps(spark, root).collect()} == {"base": True, "inc1": False, "inc2": True}
    assert {(r.tbl, r.n_recorded, r.n_found) for r in backup.damaged_blocks(spark, root, "inc1").collect()} == {("changes", 1, 0)}
    shutil.rmtree(tmp_path / "data" / "inc2")
    assert {r.id: (r.computed is None, r.ok) for r in backup.verify_dumps(spark, root, ["inc2", "base"]).collect()} == {"base": (False, True), "inc2": (True, False)}


def test_sync_and_cross_engine(spark, tmp_path):
    target = f"file://{tmp_path}"
    backup.sync({"a": widgets(spark), "b": widgets(spark)}, target, tables=["a"])
    assert names(published_table(spark, target, "a")) == {1: "bolt", 2: "leaving"} and list(published_tables(spark, target)[1]) == ["a"]
    broken = widgets(spark).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        backup.sync({"b": widgets(spark), "a": broken}, target)
    assert names(published_table(spark, target, "a")) == {1: "bolt", 2: "leaving"} and list(published_tables(spark, target)[1]) == ["a"]
    out = backup.cross_engine({"a": spark.sql("select cast(1 as smallint) as n, cast('z' as binary) as b")})["a"]
    assert [t for _, t in out.dtypes] == ["int", "string"]


def test_stream_restarts_without_gap_or_repeat(spark, tmp_path):
    log, root = f"file://{tmp_path}/log", f"file://{tmp_path}/t"
    table = target_of(spark, root, 1)
    changes(spark, [(1, "delete", "widgets", 1, {}), (2, "insert", "widgets", 3, {"id": "3", "name": "fresh"})]).write.parquet(log)
    run = lambda: apply_stream(change_stream(spark, log, 1), table, f"file://{tmp_path}/cp", tables=["widgets"]).awaitTermination()
    run()
    assert names(table.read("widgets")) == {1: "bolt", 2: "leaving", 3: "fresh"}  # position 1 lies in the snapshot
    before = table.version()
    run()
    assert table.version() == before  # nothing new, no new version
    more = changes(spark, [(3, "update", "widgets", 3, {"name": "newer"}), (4, "delete", "widgets", 2, {}), (5, "delete", "others", 1, {})])
    more.write.mode("append").parquet(log)
    run()
    assert names(table.read("widgets")) == {1: "bolt", 3: "newer"}
    table.apply(more.where("tbl = 'widgets'"), *table.position()[1:])
    assert names(table.read("widgets")) == {1: "bolt", 3: "newer"} and names(table.read("widgets", 0)) == {1: "bolt", 2: "leaving"}


def test_a_bad_change_publishes_nothing(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    table = target_of(spark, f"file://{tmp_path}/t", 0)
    changes(spark, [(1, "delete", "widgets", 1, {}), (2, "truncate", "widgets", 2, {})]).write.parquet(log)
    with pytest.raises(Exception):
        apply_stream(change_stream(spark, log), table, f"file://{tmp_path}/cp").awaitTermination()
    assert table.version() == 0 and names(table.read("widgets")) == {1: "bolt", 2: "leaving"}
    apply_stream(change_stream(spark, log), table, f"file://{tmp_path}/cp2", mode="quarantine").awaitTermination()
    assert names(table.read("widgets")) == {2: "leaving"}


def gadgets(spark):
    return spark.createDataFrame([("eu", 1, "x"), ("us", 1, "y")], "region string, no int, name string")


def keyed(spark, rows):
    return spark.createDataFrame([(Decimal(p), p, op, t, k, v) for p, op, t, k, v in rows], CHANGE)


def test_each_change_reaches_its_own_table(spark, tmp_path):
    """Three tables with equal key values, one with a composite key; batches merged on read and then into the bases; versions stay readable."""
    bases = {"widgets": widgets(spark), "gadgets": gadgets(spark), "other": widgets(spark)}
    kept = {n: Table(df.schema, ["region", "no"] if n == "gadgets" else ["id"]) for n, df in bases.items()}
    target = Target(spark, f"file://{tmp_path}/t", kept, buckets=3, merge_every=2)
    target.create(bases, 0)
    first = keyed(spark, [(1, "update", "widgets", {"id": "1"}, {"name": "w1"}), (2, "update", "gadgets", {"region": "us", "no": "1"}, {"name": "g1"}), (3, "delete", "other", {"id": "1"}, {})])
    target.apply(first, 0, "s")
    state = lambda v=None: (names(target.read("widgets", v)), {(r.region, r.no): r.name for r in target.read("gadgets", v).collect()}, names(target.read("other", v)))
    after = ({1: "w1", 2: "leaving"}, {("eu", 1): "x", ("us", 1): "g1"}, {2: "leaving"})
    assert state() == after and target.version() == 1
    target.apply(keyed(spark, [(4, "insert", "gadgets", {"region": "eu", "no": "2"}, {"region": "eu", "no": "2", "name": "g2"}), (5, "delete", "widgets", {"id": "2"}, {})]), 1, "s")
    assert target.version() == 3  # the batch, and the bases merged
    assert state() == ({1: "w1"}, {("eu", 1): "x", ("us", 1): "g1", ("eu", 2): "g2"}, {2: "leaving"}) and state(1) == after
    again = Target(spark, f"file://{tmp_path}/t", kept)
    assert again.counts() == (5, 0) and names(again.read("widgets")) == {1: "w1"}


def test_a_table_that_isnt_kept_is_an_error(spark, tmp_path):
    target = target_of(spark, f"file://{tmp_path}/t", 0)
    foreign = keyed(spark, [(1, "update", "widgets", {"id": "1"}, {"name": "a"}), (2, "update", "gadgets", {"id": "1"}, {"name": "OTHER"}), (3, "insert", "gadgets", {"id": "9"}, {"id": "9", "name": "OTHER"})])
    with pytest.raises(Exception, match="unknown table"):
        target.apply(foreign, 0, "s")
    assert target.version() == 0
    target.apply(foreign, 0, "s", mode="quarantine")
    assert names(target.read("widgets")) == {1: "a", 2: "leaving"} and target.counts() == (1, 2)
    assert sorted((r.tbl, int(r.pos), r.reason) for r in target.rejected().collect()) == [("gadgets", 2, "unknown table"), ("gadgets", 3, "unknown table")]
    foreign.write.parquet(f"file://{tmp_path}/log")
    other = target_of(spark, f"file://{tmp_path}/t2", 0)
    apply_stream(change_stream(spark, f"file://{tmp_path}/log"), other, f"file://{tmp_path}/cp", tables=["widgets"]).awaitTermination()
    assert names(other.read("widgets")) == {1: "a", 2: "leaving"} and other.counts() == (1, 0)


def test_rejects_are_kept_once(spark, tmp_path):
    target = target_of(spark, f"file://{tmp_path}/t", 0, merge_every=2)
    batch = lambda at: keyed(spark, [(at, "update", "widgets", {"id": "1"}, {"name": f"n{at}"}), (at + 1, "truncate", "widgets", {"id": "1"}, {}), (at + 2, "delete", "widgets", {}, {})])
    for n in range(3):
        for _ in range(2):  # each is delivered twice
            target.apply(batch(1 + 10 * n), n, "s", mode="quarantine")
    assert target.counts() == (3, 6) and names(target.read("widgets")) == {1: "n21", 2: "leaving"}
    assert sorted((int(r.pos), r.reason) for r in target.rejected().collect()) == sorted((p + 10 * n, why) for n in range(3) for p, why in ((2, "unknown operation"), (3, "missing primary key")))
    before = target.version()
    target.apply(batch(1).limit(0), 3, "s")  # an empty batch is a batch
    assert target.version() == before + 1 and target.position()[1] == 3 and target.counts() == (3, 6)


def test_the_whole_job_with_many_tables(spark, tmp_path):
    bases = {"widgets": widgets(spark), "gadgets": gadgets(spark)}
    kept = {"widgets": Table(bases["widgets"].schema, ["id"]), "gadgets": Table(bases["gadgets"].schema, ["region", "no"])}
    log = f"file://{tmp_path}/log"
    keyed(spark, [(1, "update", "widgets", {"id": "1"}, {"name": "in the snapshot"}), (2, "update", "widgets", {"id": "1"}, {"name": "a"}), (3, "delete", "gadgets", {"region": "eu", "no": "1"}, {}), (4, "delete", "unfollowed", {"id": "1"}, {})]).write.parquet(log)
    for _ in range(2):
        target, running = cdc(spark, "from", "to", log=log, root=f"file://{tmp_path}/jobs", tables=kept, position=lambda: 1, snapshots=lambda: bases)
        running.awaitTermination()
    assert names(target.read("widgets")) == {1: "a", 2: "leaving"} and [r.region for r in target.read("gadgets").collect()] == ["us"]


def test_a_merge_leaves_the_target_where_it_lies(spark, tmp_path):
    """A bucketed target meets its changes without being shuffled."""
    base = spark.range(1000).select(F.col("id").cast("int").alias("id"), F.col("id").cast("string").alias("name"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from tablesync.sources.bucketed import read_bucketed, write_bucketed

    write_bucketed(base, f"file://{tmp_path}/b", ["id"], n)
    stored = read_bucketed(spark, f"file://{tmp_path}/b", base.schema, ["id"], n)
    log = changes(spark, [(i, "update", "t", 3 * i, {"name": f"new{i}"}) for i in range(1, 50)])
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = apply.merge(stored, log, ["id"])
        plan = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    at = next(i for i, line in enumerate(plan) if "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, here = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < here:
            here = depth(line)
            above.append(line)
    assert any("FullOuter" in line for line in above) and not any("Exchange" in line for line in above)
    got = names(merged)
    assert len(got) == 1000 and got[9] == "new3" and got[10] == "10"


def test_trees_of_hashes(spark):
    base = spark.range(5000).select("id", F.concat(F.lit("row "), F.col("id")).alias("v"), F.when(F.col("id") % 3 == 0, F.current_timestamp()).alias("t"))
    base = base.withColumn("t", F.to_timestamp(F.lit("2024-05-06 07:08:09.123456")))
    blocks = verify.content_blocks(base, ["id"]).persist()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:  # neither order nor the session's time zone counts
        assert verify.differing_blocks(blocks, verify.content_blocks(base.withColumn("t", F.to_timestamp(F.lit("2024-05-06 16:08:09.123456"))).orderBy(F.desc("v")).repartition(7), ["id"])).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for odd in (
        base.withColumn("t", F.when(F.col("id") == 77, F.to_timestamp(F.lit("2024-05-06 07:08:09.123457"))).otherwise(F.col("t"))),
        base.where("id <> 77"),
        base.unionByName(base.where("id = 77")).unionByName(base.where("id = 77")),
        base.withColumn("v", F.when(F.col("id") == 77, None).otherwise(F.col("v"))),
    ):
        other = verify.content_blocks(odd, ["id"])
        assert [r.block for r in verify.differing_blocks(blocks, other).collect()] == [spark.range(1).select(F.substring(F.sha2(F.lit("77"), 256), 1, 3)).first()[0]]
        assert verify.tree_roots(blocks).first() != verify.tree_roots(other).first()
    assert verify.tree_roots(blocks).first().n == 5000 and verify.tree_roots(blocks, digits=3).count() == 1
    blocks.unpersist()


def test_backup_of_wide_rows(spark, tmp_path):
    root = f"file://{tmp_path}"
    wide = spark.range(3000).select(F.col("id").cast("int").alias("id"), F.expr("repeat(cast(id as string), 10240 div length(cast(id as string)))").alias("name"))
    backup.full_backup({"widgets": wide}, root, "wide", created=DAY, end_pos=0, profile="p", driver="postgres")
    assert [(r.id, r.ok) for r in backup.verify_dumps(spark, root).collect()] == [("wide", True)]


def test_of_writers_at_the_same_time_one_wins(spark, tmp_path):
    for turn in range(10):
        path, gate = f"file://{tmp_path}/v{turn}", threading.Barrier(6)

        def write(i):
            gate.wait()
            return publish(spark, path, f"writer {i}")

        with ThreadPoolExecutor(6) as pool:
            won = list(pool.map(write, range(6)))
        assert sum(won) == 1 and read_text(spark, path) == f"writer {won.index(True)}"
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith("v")] == []


def test_a_version_is_published_once(spark, tmp_path):
    table = target_of(spark, f"file://{tmp_path}/t", 0)
    with pytest.raises(Conflict):
        table.create({"widgets": widgets(spark)}, 0)


def test_a_new_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    table = target_of(spark, f"file://{tmp_path}/t", 0)
    run = lambda n: apply_stream(change_stream(spark, log, 1), table, f"file://{tmp_path}/cp{n}").awaitTermination()
    batches = [
        [(1, "update", "widgets", 1, {"name": "a"}), (2, "insert", "widgets", 3, {"id": "3", "name": "b"})],
        [(3, "delete", "widgets", 3, {}), (3, "insert", "widgets", 3, {"id": "3", "name": "c"})],
        [(4, "update", "widgets", 1, {"name": "d"})],
        [(5, "delete", "widgets", 2, {}), (6, "insert", "widgets", 4, {"id": "4", "name": "e"})],
    ]
    want = [{1: "a", 2: "leaving", 3: "b"}, {1: "a", 2: "leaving", 3: "c"}, {1: "d", 2: "leaving", 3: "c"}, {1: "d", 3: "c", 4: "e"}]
    for n, (rows, after) in enumerate(zip(batches, want)):
        # two changes at one position are ordered by seq
        spark.createDataFrame([(Decimal(p), 10 * p + i, op, t, {"id": str(k)}, v) for i, (p, op, t, k, v) in enumerate(rows)], CHANGE).coalesce(1).write.mode("append").parquet(log)
        run(n)  # each time with a checkpoint that knows nothing, from the first file on
        assert names(table.read("widgets")) == after
    assert int(table.position()[0]) == 6


def test_restore_into_a_target(spark, tmp_path):
    root, target, keys = f"file://{tmp_path}/d", f"file://{tmp_path}/t", {"widgets": ["id"]}
    backup.full_backup({"widgets": widgets(spark)}, root, "base", created=DAY, end_pos=0, profile="p", driver="postgres")
    with pytest.raises(backup.Incompatible):
        backup.full_backup({"widgets": widgets(spark)}, root, "base", created=DAY, end_pos=0, profile="p", driver="postgres")
    listed = backup.inspect_dump(spark, root, "base").first()
    assert [(t.name, t.rows, t.size_bytes) for t in listed.tables] == [("widgets", 2, listed.size_bytes)] and listed.size_bytes > 0
    write = lambda **o: backup.restore_to(spark, root, "base", keys, target, driver="postgres", **o)
    with pytest.raises(backup.Incompatible):
        write(data_only=True)
    assert write(schema_only=True) == 0 and published_table(spark, target, "widgets").count() == 0
    with pytest.raises(backup.Incompatible):
        write()
    assert write(data_only=True) == 1 and names(published_table(spark, target, "widgets")) == {1: "bolt", 2: "leaving"}
    with pytest.raises(ValueError, match="duplicate"):
        write(data_only=True)
    assert write(clean=True) == 2 and published_tables(spark, target)[0] == 2
    with pytest.raises(ValueError):
        write(clean=True, data_only=True)
    with pytest.raises(backup.Incompatible):
        backup.restore_to(spark, root, "base", keys, target, driver="mysql", clean=True)
    assert published_tables(spark, target)[0] == 2


def test_prune_deletes_leaves_first_and_stops_a_chain_at_a_failure(spark, tmp_path, monkeypatch):
    root, common = f"file://{tmp_path}", {"profile": "p", "driver": "postgres"}
    log = changes(spark, [(1, "delete", "widgets", 1, {}), (2, "delete", "widgets", 2, {})])
    for label, day in (("x", 1), ("y", 2), ("z", 9)):
        at = DAY + datetime.timedelta(days=day)
        backup.full_backup({"widgets": widgets(spark)}, root, label, created=at, end_pos=0, **common)
        backup.incremental_backup(log, root, f"{label}1", parent_id=label, created=at, end_pos=1, **common)
    remove = backup.remove
    monkeypatch.setattr(backup, "remove", lambda s, p: remove(s, p) if "/y1" not in p else False)
    got = backup.apply_prune(spark, root, RetentionPolicy(keep_last=1), DAY + datetime.timedelta(days=10)).collect()
    assert [(r.id, r.deleted) for r in got] == [("x1", True), ("x", True), ("y1", False)]
    assert sorted(r.id for r in backup.manifest(spark, root).collect()) == ["y", "y1", "z", "z1"]
    assert sorted(p.name for p in (tmp_path / "data").iterdir()) == ["y", "y1", "z", "z1"]


def test_inspection_gives_the_files_sizes(spark):
    got = {r.name: (r.rows, r.size_bytes) for r in entry.queries()["table_inspection"](spark, SF).collect()}
    for name in ("region", "orders"):
        assert got[name] == (pq.read_metadata(f"{SF}/{name}.parquet").num_rows, os.path.getsize(f"{SF}/{name}.parquet"))
    sizes = [r.size_bytes for r in entry.queries()["table_inspection"](spark, SF).collect()]
    assert sizes == sorted(sizes, reverse=True)


