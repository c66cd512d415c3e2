"""Queries that run whole jobs: backups and restores, streams, a relational round trip."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..model import CHANGE, RetentionPolicy
from ..plans import backup
from ..sources import rows as rows_io
from ..storage import published_table, remove, scratch
from ..streaming.counters import RunningCounts
from ..streaming.counters import applied_stream as stream_counts
from ..streaming.cdc import Table, Target, apply_stream, catch_up, cdc, change_stream
from ..streaming.state import current_rows
from ..streaming.transcripts import transcript_stream as stream_transcripts
from . import fixtures as fx
from .core import ORACLE_SQL, query, transcript_columns
from .fixtures import ACCOUNTS_SQL, CHANGES_SQL, MANY, MANY_SQL, fold_sql, table

FOLD = ORACLE_SQL["change_fold"]


def _steps(log, parts: int):
    """End positions that cut a log into parts."""
    last = int(log.agg(F.max("pos")).first()[0] or 0)
    return [last * (i + 1) // parts for i in range(parts)]


def _day(n: int) -> datetime.datetime:
    return datetime.datetime(2001, 1, 1) + datetime.timedelta(days=n)


COMMON = {"profile": "p", "driver": "postgres"}


def _chain(spark, sf, root: str, label: str, first_day: int, increments: int) -> None:
    """A base of the accounts before any change, and increments that cut the change log into equal parts."""
    log, parent = fx.change_log(spark, sf), f"{label}base"
    backup.full_backup({"accounts": fx.accounts(spark, sf)}, root, parent, created=_day(first_day), end_pos=0, **COMMON)
    for i, end in enumerate(_steps(log, increments) if increments else [], 1):
        backup.incremental_backup(log, root, f"{label}inc{i}", parent_id=parent, created=_day(first_day + i), end_pos=end, **COMMON)
        parent = f"{label}inc{i}"


@query(f"""WITH {ACCOUNTS_SQL}, {CHANGES_SQL}, part AS (SELECT * FROM changes WHERE seq <= (SELECT (max(event_id) + 1) * 2 // 3 FROM events)), {fold_sql('part')} SELECT * FROM folded""")
def point_in_chain_restore(spark, sf):
    """A base and three increments, restored up to the second."""
    root = scratch(spark, "dumps")
    _chain(spark, sf, root, "", 0, 3)
    return backup.restore(spark, root, "inc3", {"accounts": ["id"]}, driver="postgres", up_to="inc2")["accounts"]


@query(FOLD)
def restore_write(spark, sf):
    """A chain restored over an older copy of its table in the target."""
    root, target = scratch(spark, "dumps"), scratch(spark, "target")
    _chain(spark, sf, root, "", 0, 2)
    backup.sync({"accounts": fx.accounts(spark, sf)}, target)
    backup.restore_to(spark, root, "inc2", {"accounts": ["id"]}, target, driver="postgres", clean=True)
    return published_table(spark, target, "accounts")


@query("""SELECT 'customer' AS name, CAST(c_custkey AS BIGINT) AS k FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT 'orders', o_orderkey FROM orders""")
def sync_replace(spark, sf):
    """Two tables are copied; then one of them, which has changed meanwhile, is copied again."""
    target, customer = scratch(spark, "target"), table(spark, sf, "customer")
    backup.sync({"customer": customer, "orders": table(spark, sf, "orders")}, target)
    gone = table(spark, sf, "events").where("event_type = 'error'")
    backup.sync({"customer": customer.join(gone, F.col("c_custkey") == F.col("user_id"), "left_anti")}, target, tables=["customer"])
    keys = {"customer": "c_custkey", "orders": "o_orderkey"}
    out = [published_table(spark, target, n).select(F.lit(n).alias("name"), F.col(k).cast("long").alias("k")) for n, k in keys.items()]
    return out[0].unionByName(out[1])


@query(f"""WITH {ACCOUNTS_SQL}, {CHANGES_SQL}, kept AS (SELECT 'b' AS label UNION ALL SELECT 'c')
SELECT label || 'base' AS id, true AS ok, (SELECT count(*) FROM accounts) AS "rows" FROM kept UNION ALL SELECT 'binc1', true, count(*) FROM changes""")
def prune_apply(spark, sf):
    """Three chains of which the two newest are kept: what the catalog holds behind the deletions."""
    root = scratch(spark, "dumps")
    for label, day, increments in (("a", 0, 2), ("b", 10, 1), ("c", 20, 0)):
        _chain(spark, sf, root, label, day, increments)
    backup.apply_prune(spark, root, RetentionPolicy(keep_last=2), _day(30))
    return _checked(spark, root)


def _checked(spark, root: str):
    """(id, ok, rows) of all dumps below root."""
    seen = backup.verify_dumps(spark, root).select("id", "ok")
    rows = backup.list_dumps(spark, root).select(F.col("id").alias("m_id"), F.aggregate("tables", F.lit(0).cast("long"), lambda s, t: s + t["rows"]).alias("rows"))
    return seen.join(rows, F.col("id") == F.col("m_id")).select("id", "ok", "rows")


@query("SELECT 'base' AS id, true AS ok, count(*) AS \"rows\" FROM orders")
def backup_verify(spark, sf):
    root, orders = scratch(spark, "dumps"), table(spark, sf, "orders")
    backup.full_backup({"orders": orders}, root, "base", created=_day(0), end_pos=0, **COMMON)
    return _checked(spark, root)


def _parts(log, parts: int):
    """The log cut into runs of consecutive positions."""
    since = 0
    for end in _steps(log, parts):
        yield log.where((F.col("pos") > since) & (F.col("pos") <= end))
        since = end


def _kept(bases: dict) -> dict[str, Table]:
    return {name: Table(base.schema, MANY[name]) for name, base in bases.items()}


def _target(spark, label: str, bases: dict, **options) -> Target:
    out = Target(spark, scratch(spark, label), _kept(bases), **options)
    out.create(bases, 0)
    return out


@query(FOLD)
def cdc_apply_stream(spark, sf):
    """Snapshot, then the log as a stream whose files arrive in four runs."""
    target, path, checkpoint = _target(spark, "cdc", {"accounts": fx.accounts(spark, sf)}), scratch(spark, "log"), scratch(spark, "cdc-checkpoint")
    for part in _parts(fx.change_log(spark, sf), 4):
        part.write.mode("append").parquet(path)
        apply_stream(change_stream(spark, path), target, checkpoint, tables=["accounts"]).awaitTermination()
    return target.read("accounts")


@query(FOLD)
def cdc_resume(spark, sf):
    """The stream stops with half of the log there, starts again from its checkpoint, and its last batch is delivered once more."""
    target, checkpoint, path = _target(spark, "resume", {"accounts": fx.accounts(spark, sf)}), scratch(spark, "resume-checkpoint"), scratch(spark, "log")
    for part in _parts(fx.change_log(spark, sf), 2):
        part.write.mode("append").parquet(path)
        apply_stream(change_stream(spark, path), target, checkpoint).awaitTermination()
    target.apply(part, *target.position()[1:])  # redelivery changes nothing
    return target.read("accounts")


@query(FOLD)
def cdc_new_checkpoint(spark, sf):
    """The job with saved state: half of the log, then its checkpoint is lost and the whole log is there."""
    root, path, bases = scratch(spark, "cdc-job"), scratch(spark, "log"), {"accounts": fx.accounts(spark, sf)}
    for part in _parts(fx.change_log(spark, sf), 2):
        part.write.mode("append").parquet(path)
        target, running = cdc(spark, "shop", "copy", log=path, root=root, tables=_kept(bases), position=lambda: 0, snapshots=lambda: bases)
        running.awaitTermination()
        remove(spark, target.root.rpartition("/")[0] + "/checkpoint")
    return target.read("accounts")


@query(f"""WITH {ACCOUNTS_SQL}, {CHANGES_SQL}, part AS (SELECT * FROM changes WHERE seq <= (SELECT (max(event_id) + 1) * 4 // 5 FROM events)), {fold_sql('part')} SELECT * FROM folded""")
def stream_bounded(spark, sf):
    """The stream up to a position within a file, then on from there to a later one."""
    log, path = fx.change_log(spark, sf), scratch(spark, "log")
    for part in _parts(log, 3):
        part.write.mode("append").parquet(path)
    target, checkpoint, ends = _target(spark, "bounded", {"accounts": fx.accounts(spark, sf)}), scratch(spark, "bounded-checkpoint"), _steps(log, 5)
    for stop in (ends[1], ends[3]):
        apply_stream(change_stream(spark, path, 1), target, checkpoint, stop=stop).awaitTermination()
    return target.read("accounts")


@query(FOLD)
def catch_up_by_position(spark, sf):
    """A log laid out by position, applied in two runs of bounded batches; the second one goes on behind the first one's end."""
    log, path = fx.change_log(spark, sf), scratch(spark, "log")
    middle, last = _steps(log, 2)
    span = max(1, last // 32)
    rows_io.write_log(log, path, span)
    target = _target(spark, "caught-up", {"accounts": fx.accounts(spark, sf)}, merge_every=3)
    catch_up(target, path, span, stop=middle + 1, positions=-(-last // 4))
    catch_up(target, path, span, positions=-(-last // 4))
    return target.read("accounts")


@query(f"""WITH {MANY_SQL}, {fold_sql('many', 'many_base')}
SELECT split_part(id, ':', 1) AS tbl, split_part(id, ':', 2) AS k, segment, balance FROM folded""")
def cdc_many_tables(spark, sf):
    """One log of three tables, one of them with a composite key, as a stream in five runs; on the way the bases are merged twice."""
    bases, log = fx.many_tables(spark, sf)
    target, path, checkpoint = _target(spark, "many", bases, merge_every=2), scratch(spark, "log"), scratch(spark, "many-checkpoint")
    for part in _parts(log, 5):
        part.write.mode("append").parquet(path)
        apply_stream(change_stream(spark, path), target, checkpoint).awaitTermination()
    out = [target.read(n).select(F.lit(n).alias("tbl"), F.concat_ws("/", *[F.col(k).cast("string") for k in MANY[n]]).alias("k"), "segment", "balance") for n in MANY]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH bad AS ({ORACLE_SQL["change_rejects"]}), n AS (SELECT (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM bad) AS bad)
SELECT 'applied' AS kind, total - bad AS n, NULL AS seq, NULL AS reason FROM n UNION ALL SELECT 'rejected', bad, NULL, NULL FROM n UNION ALL SELECT 'reject', 1, seq, reason FROM bad""")
def cdc_quarantine(spark, sf):
    """A log with faulty changes as a stream in three runs, the last batch delivered twice: what was applied and what was set aside."""
    target, path, checkpoint = _target(spark, "quarantine", {"accounts": fx.accounts(spark, sf)}), scratch(spark, "log"), scratch(spark, "quarantine-checkpoint")
    for part in _parts(fx.faulty_changes(spark, sf), 3):
        part.write.mode("append").parquet(path)
        apply_stream(change_stream(spark, path), target, checkpoint, mode="quarantine").awaitTermination()
    target.apply(part, *target.position()[1:], mode="quarantine")
    applied, rejected = target.counts()
    counts = spark.createDataFrame([("applied", applied, None, None), ("rejected", rejected, None, None)], "kind string, n long, seq long, reason string")
    return counts.unionByName(target.rejected().select(F.lit("reject").alias("kind"), F.lit(1).cast("long").alias("n"), "seq", "reason"))


@query(FOLD)
def keyed_state_stream(spark, sf):
    """Current row of each key as a stream that starts from the base: half of the log, then the other half."""
    base = fx.accounts(spark, sf)
    path, out, checkpoint = scratch(spark, "state-log"), scratch(spark, "state-out"), scratch(spark, "state-checkpoint")
    buckets = 16 + base.count() // 1000
    _rocksdb(spark)
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    for rows in _parts(fx.change_log(spark, sf), 2):
        rows.select(*CHANGE.names).write.mode("append").parquet(path)
        states = current_rows(change_stream(spark, path), "id", base, buckets)
        states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy(F.col("key").cast("long").alias("id")).agg(F.max_by(F.struct("alive", "row"), "seq").alias("s"))
    changed = last.where("s.alive").select("id", F.try_element_at("s.row", F.lit("segment")).alias("segment"), F.try_element_at("s.row", F.lit("balance")).cast("decimal(18,2)").alias("balance"))
    return base.join(last, "id", "left_anti").unionByName(changed)


@query(f"""SELECT 'running' AS kind, tbl, CAST(seq AS BIGINT) AS seq, NULL AS op, running AS n FROM ({ORACLE_SQL["running_applied"]})
UNION ALL SELECT 'applied', tbl, NULL, op, applied FROM ({ORACLE_SQL["applied_counters"]})""")
def applied_stream(spark, sf):
    """Both counters of applied changes as streams in three runs: the last state of each (table, operation), and every change's number."""
    path, out, checkpoint = scratch(spark, "log"), scratch(spark, "counts"), scratch(spark, "counts-checkpoint")
    running = RunningCounts(spark, scratch(spark, "running"))
    write = lambda batch, k: batch.withColumn("batch_id", F.lit(k)).write.mode("overwrite").parquet(f"{out}/batch={k}")
    for part in _parts(fx.change_log(spark, sf, by_type=True), 3):
        part.write.mode("append").parquet(path)
        counts = stream_counts(change_stream(spark, path))
        counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        running.follow(change_stream(spark, path), f"{checkpoint}-running").awaitTermination()
    last = spark.read.parquet(out).groupBy("tbl", "op").agg(F.max_by("applied", "batch_id").alias("n"))
    nothing = F.lit(None)
    return running.read().select(F.lit("running").alias("kind"), "tbl", "seq", nothing.cast("string").alias("op"), F.col("running").alias("n")).unionByName(last.select(F.lit("applied").alias("kind"), "tbl", nothing.cast("long").alias("seq"), "op", "n"))


def _rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(ORACLE_SQL["transcript_changes"])
def transcript_stream(spark, sf):
    """The transcripts of transcript_changes as growing files: three runs of lines, with an event of each file cut between any two."""
    n, i = F.col("seq") - 1, F.col("i")
    lines = fx.transcript_lines(spark, sf).select(F.col("no").cast("string").alias("path"), (F.col("seq") * 100 + i).alias("line_no"), F.col("value").alias("line"), "seq", "i")
    run = F.when((n % 1000 < 300) | ((n % 1000 == 300) & (i < 2)), 0).when((n % 1000 < 700) | ((n % 1000 == 700) & (i < 5)), 1).otherwise(2)
    path, out, checkpoint = scratch(spark, "lines"), scratch(spark, "decoded"), scratch(spark, "lines-checkpoint")
    _rocksdb(spark)
    write = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")
    for k, (first, last) in enumerate(((0, 300), (300, 700), (700, 999))):  # the bounds tell before an event's lines are made
        lines.where((n % 1000).between(first, last) & (run == k)).select("path", "line_no", "line").write.mode("append").parquet(path)
        stream = spark.readStream.schema("path string, line_no long, line string").parquet(path)
        decoded = stream_transcripts(stream, fx.transcript_catalog(spark))
        decoded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return transcript_columns(spark.read.parquet(out))


@query("SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment FROM customer")
def jdbc_roundtrip(spark, sf):
    """customer through a relational database, read back in ranges of its key. The embedded database lives in the driver's JVM, so local sessions only."""
    url = "jdbc:derby:memory:" + scratch(spark, "db").rpartition("/")[2].replace("-", "") + ";create=true"
    customer = table(spark, sf, "customer").withColumn("c_acctbal", fx.money("c_acctbal"))
    rows_io.write_jdbc(backup.cross_engine({"customer": customer})["customer"].coalesce(4), url, "customer", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    top = customer.agg(F.max("c_custkey")).first()[0]
    return rows_io.read_jdbc(spark, url, "customer", partition_column="c_custkey", lower=0, upper=top or 1, partitions=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
