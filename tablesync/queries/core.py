"""Queries over the given tables, one or more per operator, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.positions import lsn_number, stream_job_id
from ..functions.text import checksum_text
from ..model import RetentionPolicy
from ..operators import apply, chains, changes, decode, retention, statistics, types, verify
from ..plans import backup
from ..sources import manifest as manifests
from ..sources import rows as rows_io
from ..storage import scratch
from . import fixtures as fx
from .fixtures import ACCOUNTS_SQL, CHAINS_SQL, CHANGES_SQL, MANIFEST_SQL, NOW, fold_sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------------ applying changes


@query(f"WITH {ACCOUNTS_SQL}, {CHANGES_SQL}, {fold_sql()} SELECT * FROM folded")
def change_fold(spark: SparkSession, sf: str) -> DataFrame:
    return apply.merge(fx.accounts(spark, sf), fx.change_log(spark, sf), ["id"])


@query(f"""WITH {ACCOUNTS_SQL}, {CHANGES_SQL}, firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM changes WHERE op = 'insert')
SELECT id, segment, balance FROM accounts UNION ALL SELECT id, segment, balance FROM firsts WHERE r = 1 AND id NOT IN (SELECT id FROM accounts)""")
def insert_ignore(spark, sf):
    return apply.insert_ignore(fx.accounts(spark, sf), fx.change_log(spark, sf), ["id"])


@query(f"WITH {ACCOUNTS_SQL}, {CHANGES_SQL}, ups AS (SELECT * FROM changes WHERE op = 'update'), {fold_sql('ups')} SELECT * FROM folded")
def update_by_key(spark, sf):
    return apply.update_by_key(fx.accounts(spark, sf), fx.change_log(spark, sf), ["id"])


@query("SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def delete_by_key(spark, sf):
    """All customers without those that a change deletes."""
    everyone = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), fx.money("c_acctbal").alias("balance"))
    return apply.delete_by_key(everyone, fx.change_log(spark, sf), ["id"])


@query(f"""WITH {CHANGES_SQL}, f AS (SELECT seq, (seq - 1) AS n, CASE WHEN (seq - 1) % 19 = 0 THEN 'truncate' ELSE op END AS op, op AS was FROM changes)
SELECT * FROM (SELECT seq, CASE WHEN op = 'truncate' THEN 'unknown operation' WHEN op IN ('update', 'delete') AND n % 17 = 0 THEN 'missing primary key'
WHEN op = 'update' AND n % 23 = 0 THEN 'nothing to set' END AS reason FROM f) WHERE reason IS NOT NULL""")
def change_rejects(spark, sf):
    return changes.rejects(fx.faulty_changes(spark, sf)).select("seq", "reason")


@query(f"""WITH {CHANGES_SQL} SELECT seq, 'id' AS key_columns,
CASE tbl WHEN 'signup' THEN 'balance,segment' WHEN 'view' THEN 'balance,segment' WHEN 'purchase' THEN 'balance' WHEN 'click' THEN 'segment' ELSE '' END AS set_columns FROM changes""")
def set_key_split(spark, sf):
    c = fx.change_log(spark, sf)
    return c.select("seq", F.array_join(changes.key_columns(), ",").alias("key_columns"), F.array_join(changes.set_columns(), ",").alias("set_columns"))


@query(f"WITH {CHANGES_SQL} SELECT tbl, op, count(*) AS applied FROM changes GROUP BY tbl, op")
def applied_counters(spark, sf):
    return changes.applied_counts(fx.change_log(spark, sf, by_type=True))


@query(f"WITH {CHANGES_SQL} SELECT tbl, seq, CAST(count(*) OVER (PARTITION BY tbl ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM changes")
def running_applied(spark, sf):
    return changes.running_applied(fx.change_log(spark, sf, by_type=True)).select("tbl", "seq", "running")


@query("SELECT event_type AS tbl, event_id + 1 AS seq FROM events WHERE event_type IN ('click', 'view')")
def table_filtered_changes(spark, sf):
    return changes.only_tables(fx.change_log(spark, sf, by_type=True), ["click", "view"]).select("tbl", "seq")


def _lsn(n):
    return F.concat_ws("/", F.hex(F.floor(n / 256).cast("long")), F.hex((n % 256) * 16777216))


@query("""WITH e AS (SELECT event_id, CAST(event_id // 256 AS DECIMAL(20,0)) * 4294967296 + (event_id % 256) * CAST(16777216 AS BIGINT) AS pos FROM events)
SELECT event_id, CAST(pos AS DECIMAL(20,0)) AS pos FROM e WHERE pos > CAST(6442450944 AS DECIMAL(20,0)) AND pos <= CAST(68719476736 AS DECIMAL(20,0))""")
def bounded_capture_lsn(spark, sf):
    e = table(spark, sf, "events").select("event_id", _lsn(F.col("event_id")).alias("lsn"))
    return changes.bounded_lsn(e, "1/80000000", "10/0").select("event_id", lsn_number(F.col("lsn")).alias("pos"))


@query("SELECT event_id FROM events WHERE (event_id // 1000 > 0 OR event_id % 1000 > 299) AND (event_id // 1000 < 7 OR (event_id // 1000 = 7 AND event_id % 1000 <= 5))")
def bounded_capture_binlog(spark, sf):
    n = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("bin."), F.lpad(F.floor(n / 1000).cast("string"), 6, "0")).alias("file"), ((n % 1000) * 100).alias("offset"))
    return changes.bounded_binlog(e, (0, 29900), (7, 500)).select("event_id")


@query("SELECT c_custkey, 'cdc-' || substr(sha256(c_name || chr(0) || c_mktsegment), 1, 16) AS job_id FROM customer")
def stream_job_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", stream_job_id(F.col("c_name"), F.col("c_mktsegment")).alias("job_id"))


# ------------------------------------------------------------------ chains


@query(f"WITH {MANIFEST_SQL}, {CHAINS_SQL} SELECT root, newest, members, bytes FROM chains")
def chain_groups(spark, sf):
    return chains.group(fx.manifest(spark, sf))


@query(f"""WITH {MANIFEST_SQL}, {CHAINS_SQL} SELECT root, id, CAST(row_number() OVER (PARTITION BY root ORDER BY CASE WHEN id = root THEN 0 ELSE 1 END, created, CAST(substr(id, 2) AS BIGINT)) AS INTEGER) AS member_no FROM rooted""")
def member_order(spark, sf):
    """Bases come first although the times of some say otherwise."""
    return chains.member_order(fx.skewed_manifest(spark, sf))


_WALK = """walk AS (SELECT id AS target, id AS cur, 0 AS back FROM manifest
  UNION ALL SELECT w.target, m.parent_id, w.back + 1 FROM walk w JOIN manifest m ON m.id = w.cur WHERE m.parent_id <> '' AND w.back < 60)"""


@query(f"WITH RECURSIVE {MANIFEST_SQL}, {_WALK} SELECT target, CAST(max(back) OVER (PARTITION BY target) - back AS INTEGER) AS link_no, cur AS id FROM walk")
def resolve_chain(spark, sf):
    return chains.links(fx.manifest(spark, sf))


@query(f"""WITH RECURSIVE {MANIFEST_SQL}, broken AS (SELECT id, base_id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 101 = 0 AND parent_id <> '' THEN id ELSE parent_id END AS parent_id
  FROM manifest WHERE CAST(substr(id, 2) AS BIGINT) % 13 <> 0),
  walk AS (SELECT id AS target, id AS cur, 0 AS back FROM broken
    UNION ALL SELECT w.target, m.parent_id, w.back + 1 FROM walk w JOIN broken m ON m.id = w.cur WHERE m.base_id <> '' AND m.base_id <> m.id AND w.back < 60),
  ends AS (SELECT target, cur, back FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY back DESC) AS r FROM walk) WHERE r = 1)
SELECT e.target AS id, CASE WHEN b.id IS NULL THEN 'missing parent' WHEN e.back >= 60 THEN 'cycle' ELSE 'ok' END AS status,
CASE WHEN b.id IS NULL THEN e.cur END AS broken_at FROM ends e LEFT JOIN broken b ON b.id = e.cur""")
def broken_chains(spark, sf):
    return chains.resolve(fx.broken_manifest(spark, sf)).select("id", "status", "broken_at")


@query(f"""WITH RECURSIVE {MANIFEST_SQL}, {_WALK}, links AS (SELECT target, max(back) OVER (PARTITION BY target) AS depth, back, cur AS id FROM walk)
SELECT target, CAST(depth - back AS INTEGER) AS link_no, id FROM links WHERE back > 0 OR depth = 0""")
def restore_prefix(spark, sf):
    """Every chain cut behind its last dump's parent; a base alone stays."""
    m = fx.manifest(spark, sf)
    stops = m.select(F.col("id").alias("target"), F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.col("id")).alias("last"))
    return chains.up_to_each(chains.links(m), stops)


@query(f"""WITH {MANIFEST_SQL} SELECT m.id, m.base_id, CASE WHEN m.driver <> b.driver THEN 'driver' ELSE 'profile' END AS reason FROM manifest m JOIN manifest b ON m.base_id = b.id
WHERE m.base_id <> m.id AND (m.driver <> b.driver OR m.profile <> b.profile)""")
def chain_compatibility(spark, sf):
    return chains.incompatible(fx.manifest(spark, sf))


@query(f"WITH {MANIFEST_SQL} SELECT id, profile, driver, size_bytes, created FROM manifest ORDER BY created DESC, id")
def list_dumps(spark, sf):
    """All dumps, newest first."""
    return manifests.newest_first(fx.manifest(spark, sf).select("id", "profile", "driver", "size_bytes", "created"))


@query(f"WITH {MANIFEST_SQL} SELECT id, profile, size_bytes, created FROM manifest WHERE CAST(substr(id, 2) AS BIGINT) % 29 <> 0 AND CAST(substr(id, 2) AS BIGINT) % 31 <> 0")
def manifest_scan(spark, sf):
    """A manifest written as JSON lines, some cut short and some with ids that leave their folder, and read again."""
    m, n = fx.manifest(spark, sf), F.substring("id", 2, 20).cast("long")
    line = F.to_json(F.struct(F.when(n % 31 == 0, F.concat(F.lit("../"), "id")).otherwise(F.col("id")).alias("id"), *m.columns[1:]))
    path = scratch(spark, "manifest")
    m.select(F.when(n % 29 == 0, F.substring(line, 1, 25)).otherwise(line).alias("value")).write.text(path)
    return manifests.scan_manifest_lines(spark, path).select("id", "profile", "size_bytes", "created")


# ------------------------------------------------------------------ retention


def _chains(spark, sf):
    return retention.chains_by_profile(fx.manifest(spark, sf))


@query(f"WITH {MANIFEST_SQL}, {CHAINS_SQL} SELECT root, profile, newest FROM (SELECT *, row_number() OVER (ORDER BY newest DESC, root) AS r FROM chains) WHERE r <= 50")
def keep_last(spark, sf):
    return retention.keep_last(_chains(spark, sf), 50).select("root", "profile", "newest")


@query(f"WITH {MANIFEST_SQL}, {CHAINS_SQL} SELECT root, newest FROM chains WHERE TIMESTAMP '{NOW}' - newest < INTERVAL 90 DAY")
def max_age(spark, sf):
    return retention.max_age(_chains(spark, sf), NOW, 90 * 86400).select("root", "newest")


def _gfs(tier: str, label: str, n: int):
    sql = f"""WITH {MANIFEST_SQL}, {CHAINS_SQL}, b AS (SELECT root, newest, {label} AS bucket FROM chains),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY newest DESC, root) AS r FROM b)
    SELECT root, bucket, newest FROM (SELECT *, row_number() OVER (ORDER BY newest DESC, root) AS place FROM firsts WHERE r = 1) WHERE place <= {n}"""
    query(sql, f"gfs_{tier}")(lambda spark, sf: retention.gfs(_chains(spark, sf), tier, n).select("root", "bucket", "newest"))


_gfs("daily", "strftime(newest, '%Y-%m-%d')", 30)
_gfs("weekly", "strftime(newest, '%G') || '-W' || strftime(newest, '%V')", 20)
_gfs("monthly", "strftime(newest, '%Y-%m')", 24)

_PLAN_SQL = f"""{MANIFEST_SQL}, {CHAINS_SQL},
  tiers AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY newest DESC, root) AS place,
    row_number() OVER (PARTITION BY profile, strftime(newest, '%Y-%m-%d') ORDER BY newest DESC, root) AS d1,
    row_number() OVER (PARTITION BY profile, strftime(newest, '%G-%V') ORDER BY newest DESC, root) AS w1,
    row_number() OVER (PARTITION BY profile, strftime(newest, '%Y-%m') ORDER BY newest DESC, root) AS m1 FROM chains),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY profile, d1 = 1 ORDER BY newest DESC, root) AS dn,
    row_number() OVER (PARTITION BY profile, w1 = 1 ORDER BY newest DESC, root) AS wn,
    row_number() OVER (PARTITION BY profile, m1 = 1 ORDER BY newest DESC, root) AS mn FROM tiers),
  planned AS (SELECT root, profile, newest, members, bytes, CASE
    WHEN profile = '1-URGENT' THEN CASE WHEN (w1 = 1 AND wn <= 2) OR TIMESTAMP '{NOW}' - newest < INTERVAL 40000000 SECOND THEN 'keep' ELSE 'prune' END
    WHEN profile = '2-HIGH' THEN CASE WHEN m1 = 1 AND mn <= 5 THEN 'keep' ELSE 'prune' END
    ELSE CASE WHEN place <= 2 OR (d1 = 1 AND dn <= 3) THEN 'keep' ELSE 'prune' END END AS decision FROM numbered)"""


def _plan(spark, sf):
    c = _chains(spark, sf)
    return retention.plan(c, retention.effective_policies(c, fx.policies(spark)), NOW)


@query(f"WITH {_PLAN_SQL} SELECT root, profile, newest, members, bytes, decision FROM planned")
def retention_plan(spark, sf):
    return _plan(spark, sf)


@query(f"WITH {_PLAN_SQL} SELECT decision, count(*) AS chains, CAST(sum(members) AS BIGINT) AS dumps, CAST(sum(bytes) AS BIGINT) AS bytes FROM planned GROUP BY decision")
def prune_report(spark, sf):
    return retention.report(_plan(spark, sf))


@query(f"""WITH {_PLAN_SQL}, gone AS (SELECT r.* FROM rooted r JOIN planned p ON r.root = p.root WHERE p.decision = 'prune'),
  placed AS (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY created DESC, CAST(substr(id, 2) AS BIGINT) DESC) AS delete_no FROM gone),
  halted AS (SELECT root, min(delete_no) AS h FROM placed WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0 GROUP BY root)
SELECT p.root, p.id, CAST(p.delete_no AS INTEGER) AS delete_no FROM placed p LEFT JOIN halted h ON p.root = h.root WHERE h.h IS NULL OR p.delete_no <= h.h""")
def delete_order(spark, sf):
    """Deletions of pruned chains, where those of every 50th dump fail and stop their chain."""
    m = fx.manifest(spark, sf)
    gone = retention.dumps_of_plan(_plan(spark, sf), m).where("decision = 'prune'")
    return chains.delete_order(gone, m.where(F.substring("id", 2, 20).cast("long") % 50 == 0))


@query(f"WITH {_PLAN_SQL} SELECT p.root, r.id, r.size_bytes, p.decision FROM planned p JOIN rooted r ON p.root = r.root")
def plan_dumps(spark, sf):
    return retention.dumps_of_plan(_plan(spark, sf), fx.manifest(spark, sf)).select("root", "id", "size_bytes", "decision")


@query(f"""WITH {MANIFEST_SQL.replace("manifest AS", "all_dumps AS")}, manifest AS (SELECT * FROM all_dumps WHERE profile = '1-URGENT'), {CHAINS_SQL}
SELECT root, newest, members, CASE WHEN row_number() OVER (ORDER BY newest DESC, root) <= 30 THEN 'keep' ELSE 'prune' END AS decision FROM chains""")
def profile_prune(spark, sf):
    """What keeping 30 chains of one profile means for its dumps."""
    return backup.prune(fx.manifest(spark, sf), RetentionPolicy(keep_last=30), NOW, profile="1-URGENT")[0].select("root", "newest", "members", "decision")


# ------------------------------------------------------------------ content, statistics, operation log


def _bodies(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))


@query("""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'sha256:' || sha256(text) AS computed,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'sha256:' || sha256('x') ELSE 'sha256:' || sha256(text) END AS recorded FROM documents)
SELECT id, recorded, computed, recorded = '' OR recorded = computed AS ok FROM b""")
def verify_checksums(spark, sf):
    n = F.col("doc_id")
    recorded = F.when(n % 11 == 0, "").when(n % 7 == 0, checksum_text(F.lit("x"))).otherwise(checksum_text(F.col("text")))
    record = table(spark, sf, "documents").select(n.cast("string").alias("id"), recorded.alias("checksum"))
    return verify.verify(record, verify.content_sums(_bodies(spark, sf)))


@query("""WITH p AS (SELECT source AS id, doc_id AS part, octet_length(encode(text)) AS n, sha256(text) AS h, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS block FROM documents),
  b AS (SELECT id, block, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY part)) AS h FROM p GROUP BY id, block)
SELECT id, CAST(sum(n) AS BIGINT) AS size_bytes, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY block)) AS checksum FROM b GROUP BY id""")
def dump_sizes(spark, sf):
    """Each source is a dump, each document a part of it."""
    return verify.dump_sums(table(spark, sf, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("part"), F.col("text").alias("content")))


@query("""WITH changed AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 997 = 3), gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 1009 = 5 AND o_orderkey % 997 <> 3),
  extra AS (SELECT -o_orderkey AS k FROM orders WHERE o_orderkey % 1013 = 7), was AS (SELECT o_orderkey AS k FROM orders),
  now AS (SELECT k FROM was WHERE k NOT IN (SELECT k FROM gone) UNION ALL SELECT k FROM extra),
  hit AS (SELECT DISTINCT substr(sha256(CAST(k AS VARCHAR)), 1, 3) AS block FROM (SELECT k FROM changed UNION ALL SELECT k FROM gone UNION ALL SELECT k FROM extra)),
  sizes AS (SELECT substr(sha256(CAST(k AS VARCHAR)), 1, 3) AS block, sum(a) AS n_recorded, sum(b) AS n_found FROM (SELECT k, 1 AS a, 0 AS b FROM was UNION ALL SELECT k, 0, 1 FROM now) GROUP BY 1)
SELECT block, CAST(n_recorded AS BIGINT) AS n_recorded, CAST(n_found AS BIGINT) AS n_found FROM sizes WHERE block IN (SELECT block FROM hit)""")
def verify_blocks(spark, sf):
    """The blocks of orders in which a copy with rows changed, missing and added differs."""
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    copy = orders.where((k % 1009 != 5) | (k % 997 == 3)).withColumn("o_totalprice", F.when(k % 997 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    copy = copy.unionByName(orders.where(k % 1013 == 7).withColumn("o_orderkey", -k))
    return verify.differing_blocks(*[verify.content_blocks(df, ["o_orderkey"]) for df in (orders, copy)])


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS \"rows\" FROM {t}" for t in TABLES))
def table_stats(spark, sf):
    return statistics.table_rows({t: table(spark, sf, t) for t in TABLES})


@query("""WITH r AS (SELECT coalesce(source, '?') AS name, count(*) AS n, sum(n_chars) AS size FROM documents GROUP BY 1)
SELECT name, n AS "rows", CAST(CASE WHEN n % 5 = 0 OR n % 3 = 0 THEN 0 ELSE size END AS BIGINT) AS size_bytes FROM r""")
def source_inspection(spark, sf):
    """Rows and sizes of sources, largest first; some sizes are negative and some unknown."""
    d = table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("?")).alias("name")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("size"))
    sizes = d.where("rows % 5 <> 0").select("name", F.when(F.col("rows") % 3 == 0, -F.col("size")).otherwise(F.col("size")).alias("size_bytes"))
    return statistics.inspect(d.select("name", "rows"), sizes)


@query()
def table_inspection(spark, sf):
    """Rows and bytes of the tables' files. SQL doesn't see file sizes: tested against the file system."""
    found = {t: table(spark, sf, t) for t in TABLES}
    return statistics.inspect(statistics.table_rows(found), statistics.table_files(found))


_OPS = "CASE event_type WHEN 'click' THEN 'backup' WHEN 'view' THEN 'restore' WHEN 'signup' THEN 'prune' ELSE 'sync' END"


@query(f"SELECT {_OPS} AS op, count(*) AS operations, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, sum(CAST(floor(value) AS BIGINT))::BIGINT AS duration_ms FROM events GROUP BY 1")
def op_counters(spark, sf):
    path = scratch(spark, "operations")
    e = table(spark, sf, "events")
    e.select(F.col("ts").alias("time"), F.expr(_OPS).alias("op"), F.lit("p").alias("profile"), F.col("user_id").cast("string").alias("target"), F.lit("a").alias("actor"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"), F.floor("value").cast("long").alias("duration_ms")).write.json(path)
    return statistics.operation_counters(manifests.scan_operations(spark, path))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN 'short read' WHEN doc_id % 7 = 0 THEN 'missing magic' WHEN doc_id % 9 = 0 THEN 'bad json' ELSE 'ok' END AS status,
CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'base' ELSE 'incremental' END AS type,
CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0 THEN NULL ELSE lang END AS driver FROM documents""")
def envelope_audit(spark, sf):
    n = F.col("doc_id")
    header = F.to_json(F.struct(F.when(n % 2 == 0, "base").otherwise("incremental").alias("type"), F.col("lang").alias("driver")))
    whole = manifests.envelope(F.when(n % 9 == 0, F.lit("{not json")).otherwise(header), F.col("text"))
    odd = F.when(n % 5 == 0, F.substring(whole, 1, 100)).when(n % 7 == 0, F.concat(F.lit("XXXX").cast("binary"), whole)).otherwise(whole)
    return manifests.audit_envelopes(table(spark, sf, "documents").select(n.cast("string").alias("id"), odd.alias("content"))).select("id", "status", "type", "driver")


# ------------------------------------------------------------------ types and transfer

_PG = ["integer", "SMALLINT", "bigint", "text", "character varying", "boolean", "numeric", "decimal", "uuid", "timestamp with time zone", "json", "jsonb", "bytea", "geometry"]
_MY = ["int", "tinyint", "bigint", "text", "char", "varchar", "decimal", "datetime", "json", "blob", "MEDIUMTEXT", "timestamp", "varbinary"]


def _catalog(spark, sf, native: list[str]) -> DataFrame:
    """A schema catalog with a column per event; the native types take turns."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in native]), (n % len(native) + 1).cast("int"))
    wide = F.when((kind == "tinyint") & (n % 2 == 0), "tinyint(1)").when((kind == "char") & (n % 2 == 0), "char(36)").otherwise(F.lower(kind))
    return table(spark, sf, "events").select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tbl"), n.cast("int").alias("ordinal"), F.concat(F.lit("c"), n.cast("string")).alias("col"), kind.alias("data_type"), wide.alias("column_type"), (n % 4 != 0).alias("nullable"), (n % 3 * 6).cast("int").alias("precision"), (n % 3).cast("int").alias("scale"))


# The rules once more, as SQL written out by hand: fixed values.
_PG_KIND = """CASE dt WHEN 'integer' THEN 'int' WHEN 'smallint' THEN 'int' WHEN 'bigint' THEN 'bigint' WHEN 'text' THEN 'text' WHEN 'character varying' THEN 'varchar' WHEN 'boolean' THEN 'boolean'
  WHEN 'numeric' THEN 'numeric' WHEN 'decimal' THEN 'numeric' WHEN 'uuid' THEN 'uuid' WHEN 'timestamp with time zone' THEN 'timestamptz' WHEN 'json' THEN 'json' WHEN 'jsonb' THEN 'json' END"""
_MY_KIND = """CASE WHEN dt IN ('int', 'tinyint') THEN 'int' WHEN dt = 'bigint' THEN 'bigint' WHEN dt IN ('text', 'mediumtext', 'char') THEN 'text' WHEN dt = 'varchar' THEN 'varchar' WHEN dt = 'decimal' THEN 'numeric'
  WHEN dt IN ('datetime', 'timestamp') THEN 'timestamptz' WHEN dt = 'json' THEN 'json' END"""
_PG_NAME = """CASE canonical WHEN 'int' THEN 'integer' WHEN 'timestamptz' THEN 'timestamptz' WHEN 'json' THEN 'jsonb' ELSE canonical END"""
_MY_NAME = """CASE canonical WHEN 'int' THEN 'INT' WHEN 'bigint' THEN 'BIGINT' WHEN 'text' THEN 'TEXT' WHEN 'varchar' THEN 'VARCHAR' WHEN 'boolean' THEN 'TINYINT(1)' WHEN 'numeric' THEN 'DECIMAL' WHEN 'uuid' THEN 'CHAR(36)'
  WHEN 'timestamptz' THEN 'TIMESTAMP' WHEN 'json' THEN 'JSON' END"""


def _listed(native: list[str]) -> str:
    return "list_extract([" + ", ".join(f"'{x}'" for x in native) + f"], CAST(event_id % {len(native)} + 1 AS INTEGER))"


_SIZED = """CASE WHEN canonical = 'varchar' AND precision > 0 THEN name || '(' || precision || ')'
WHEN canonical = 'numeric' AND precision > 0 THEN name || '(' || precision || ',' || scale || ')' ELSE name END || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END"""


@query(f"""WITH c AS (SELECT 'c' || event_id AS col, lower({_listed(_PG)}) AS dt, event_id % 4 <> 0 AS nullable, event_id % 3 * 6 AS precision, event_id % 3 AS scale FROM events),
  k AS (SELECT *, {_PG_KIND} AS canonical FROM c), t AS (SELECT *, {_MY_NAME} AS name FROM k)
SELECT col, canonical, {_SIZED} AS native FROM t""")
def type_plan(spark, sf):
    return types.type_plan(_catalog(spark, sf, _PG), "postgres", "mysql").select("col", "canonical", "native")


@query(f"""WITH c AS (SELECT event_id, lower({_listed(_MY)}) AS dt, 'c' || event_id AS col, event_id % 4 <> 0 AS nullable, event_id % 3 * 6 AS precision, event_id % 3 AS scale FROM events),
  k AS (SELECT *, CASE WHEN dt = 'tinyint' AND event_id % 2 = 0 THEN 'boolean' WHEN dt = 'char' AND event_id % 2 = 0 THEN 'uuid' ELSE {_MY_KIND} END AS canonical FROM c),
  t AS (SELECT *, {_PG_NAME} AS name FROM k) SELECT col, canonical, {_SIZED} AS native FROM t""")
def type_plan_reverse(spark, sf):
    return types.type_plan(_catalog(spark, sf, _MY), "mariadb", "postgres").select("col", "canonical", "native")


@query(f"SELECT 't' || user_id AS tbl, 'c' || event_id AS col, {_listed(_PG)} AS data_type FROM events WHERE event_id % 14 >= 12")
def unsupported_types(spark, sf):
    return types.unsupported(_catalog(spark, sf, _PG), "postgres")


@query("SELECT 't' || user_id AS tbl, 'c' || event_id AS col, event_id % 6 = 1 AS pk FROM events")
def pk_marking(spark, sf):
    cat = _catalog(spark, sf, _PG)
    return types.mark_primary_keys(cat, cat.where("ordinal % 6 = 1").select("tbl", "col")).select("tbl", "col", "pk")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def canonical_roundtrip(spark, sf):
    orders = table(spark, sf, "orders")
    ready = orders.withColumn("o_totalprice", fx.money("o_totalprice")).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    path = scratch(spark, "canonical")
    rows_io.write_rows({"orders": ready, "nation": table(spark, sf, "nation")}, path)
    return rows_io.load_rows(spark, path)["orders"].withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("""SELECT 'orders' AS tbl, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS text, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM customer UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, NULL FROM nation""")
def variant_rows(spark, sf):
    """Three tables as canonical rows, read in one scan as variants; a row's own table says which of its columns are taken."""
    path = scratch(spark, "variants")
    ready = {"orders": ["o_totalprice"], "customer": ["c_acctbal"], "nation": []}
    rows_io.write_rows({n: table(spark, sf, n).withColumns({c: fx.money(c) for c in cents} | ({"o_orderdate": F.col("o_orderdate").cast("timestamp")} if n == "orders" else {})) for n, cents in ready.items()}, path)
    rows = rows_io.load_variants(spark, path)

    def pick(kind: str, **paths: str):
        return F.coalesce(*[F.when(F.col("tbl") == n, F.variant_get("row", f"$.{c}", kind)) for n, c in paths.items()])

    return rows.select("tbl", pick("string", orders="o_orderkey", customer="c_custkey", nation="n_nationkey").alias("k"), pick("string", orders="o_orderstatus", customer="c_mktsegment", nation="n_name").alias("text"), pick("decimal(18,2)", orders="o_totalprice", customer="c_acctbal").cast("string").alias("amount"))


@query(f"WITH {CHANGES_SQL} SELECT seq, op, CAST(id AS VARCHAR) AS key_id FROM changes WHERE seq > (SELECT max(event_id) // 3 FROM events) AND seq <= (SELECT max(event_id) // 2 FROM events)")
def bounded_log(spark, sf):
    """A log laid out by position, of which a stretch is read."""
    log, path = fx.change_log(spark, sf), scratch(spark, "log")
    last = int(log.agg(F.max("pos")).first()[0] or 1) - 1
    span = max(1, last // 64)
    rows_io.write_log(log, path, span)
    return rows_io.read_log(spark, path, span, last // 3, last // 2).select("seq", "op", F.element_at("key", "id").alias("key_id"))


@query("SELECT doc_id, md5(text) AS body_md5, length(text) AS n_chars FROM documents")
def binary_text(spark, sf):
    """Texts as binary columns, decoded before they are encoded as rows."""
    raw = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return types.binary_as_text(raw).select("doc_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.length("body").cast("long").alias("n_chars"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key_check(spark, sf):
    return rows_io.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'part' AS name, p_partkey AS k FROM part")
def snapshot_selection(spark, sf):
    """part whole, supplier without its rows, the rest not at all."""
    plan = rows_io.select_tables(TABLES, include=["part", "supplier"], exclude_data=["supplier"])
    keys = {"part": "p_partkey", "supplier": "s_suppkey"}
    out = [rows_io.take(table(spark, sf, n), data).select(F.lit(n).alias("name"), F.col(keys[n]).cast("long").alias("k")) for n, (_, data) in plan.items()]
    return out[0].unionByName(out[1])


@query(f"WITH {CHANGES_SQL} SELECT seq, op, id AS key_id, segment, CAST(balance AS VARCHAR) AS balance, has_segment, has_balance FROM changes")
def change_log_roundtrip(spark, sf):
    path = scratch(spark, "changes")
    rows_io.write_changes(fx.change_log(spark, sf), path, "json")
    c = rows_io.read_changes(spark, path, "json")
    has = lambda n: F.map_contains_key("values", F.lit(n))
    return c.select("seq", "op", F.element_at("key", "id").cast("long").alias("key_id"), F.try_element_at("values", F.lit("segment")).alias("segment"), F.try_element_at("values", F.lit("balance")).alias("balance"), has("segment").alias("has_segment"), has("balance").alias("has_balance"))


# ------------------------------------------------------------------ decoding


@query(f"""WITH {CHANGES_SQL} SELECT 'bin.' || lpad(CAST((seq - 1) // 1000 AS VARCHAR), 6, '0') AS file, CAST(((seq - 1) % 1000) * 100 + 100 AS DECIMAL(20,0)) AS pos, op, CAST(id AS VARCHAR) AS key_id,
CASE WHEN op = 'delete' THEN NULL ELSE segment END AS segment, CASE WHEN op = 'delete' OR NOT has_balance THEN NULL ELSE CAST(balance AS VARCHAR) END AS balance FROM changes""")
def transcript_changes(spark, sf):
    """The change log rendered as transcripts, one per 1,000 events, and decoded again."""
    path = scratch(spark, "transcripts")
    fx.transcript_lines(spark, sf).repartition("no").sortWithinPartitions("no", "seq", "i").select("no", "value").write.partitionBy("no").text(path)
    return transcript_columns(decode.transcript_changes(rows_io.read_lines(spark, path), fx.transcript_catalog(spark)))


def transcript_columns(decoded: DataFrame) -> DataFrame:
    value = lambda c: F.try_element_at("values", F.lit(c)).alias(c)
    return decoded.select("file", "pos", "op", F.element_at("key", "id").alias("key_id"), value("segment"), value("balance"))


@query("""SELECT event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, 'accounts' AS tbl, CAST(user_id AS VARCHAR) AS key_id,
event_type <> 'error' AND event_id % 3 <> 1 AS has_kind, CASE WHEN event_type <> 'error' AND event_id % 3 = 2 THEN event_type END AS kind FROM events""")
def tuple_decode(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    image = F.when(F.col("event_type") == "error", "old").otherwise("new")
    kind = F.when(n % 3 == 0, "n").when(n % 3 == 1, "u").otherwise("t")
    cell = lambda i, k, v: F.struct(F.lit(i).alias("ordinal"), k.alias("kind"), v.alias("value"))
    cells = F.array(cell(1, F.lit("t"), F.col("user_id").cast("string")), cell(2, kind, F.col("event_type")))
    tuples = e.select((n + 1).alias("seq"), op.alias("op"), F.lit(7).alias("rel_id"), image.alias("image"), F.explode(cells).alias("c")).select("seq", "op", "rel_id", "image", "c.*")
    relations = spark.createDataFrame([(7, "accounts", 1, "id", True), (7, "accounts", 2, "kind", False)], "rel_id int, tbl string, ordinal int, col string, is_key boolean")
    out = decode.tuple_changes(tuples, relations)
    values = F.when(F.col("op") == "delete", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))).otherwise(F.col("values"))
    return out.select("seq", "op", "tbl", F.element_at("key", "id").alias("key_id"), F.map_contains_key(values, F.lit("kind")).alias("has_kind"), F.try_element_at(values, F.lit("kind")).alias("kind"))
