"""Change logs, manifests, transcripts and logs derived from the given tables; the SQL texts hold the same rules for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base table: all customers but those whose first event is a signup, which makes them anew."""
    first = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.min_by("event_type", "event_id").alias("first"))
    base = table(spark, sf_dir, "customer").join(first.where("first = 'signup'"), F.col("c_custkey") == F.col("u"), "left_anti")
    return base.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), money("c_acctbal").alias("balance"))


def change_log(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Changes on accounts, one per event; by_type: each event type is a table of its own."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    balance = F.struct(F.lit("balance").alias("k"), money("value").cast("string").alias("v"))
    segment = lambda v: F.struct(F.lit("segment").alias("k"), v.alias("v"))
    viewed = F.when(F.col("user_id") % 3 != 0, F.lit("view"))
    values = (
        F.when(F.col("event_type") == "signup", F.array(segment(F.lit("new")), balance))
        .when(F.col("event_type") == "purchase", F.array(balance))
        .when(F.col("event_type") == "click", F.array(segment(F.lit("click"))))
        .when(F.col("event_type") == "view", F.array(segment(viewed), balance))
        .otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    )
    seq = F.col("event_id") + 1
    tbl = F.col("event_type") if by_type else F.lit("accounts")
    return e.select(seq.cast("decimal(20,0)").alias("pos"), seq.alias("seq"), op.alias("op"), tbl.alias("tbl"), F.create_map(F.lit("id"), F.col("user_id").cast("string")).alias("key"), F.map_from_entries(values).alias("values"))


#: Tables of many_tables() and their keys.
MANY = {"accounts": ["id"], "holdings": ["id", "slot"], "nicknames": ["name"]}


def many_tables(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Bases of three tables, the first one's rows being those of accounts, and one log of all: events take turns."""
    base, n = accounts(spark, sf_dir), F.col("seq") - 1
    bases = {"accounts": base, "holdings": base.select("id", F.lit(0).alias("slot"), "segment", "balance"), "nicknames": base.select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"), "segment", "balance")}
    user = F.element_at("key", "id")
    tbl = F.element_at(F.array(*[F.lit(t) for t in MANY]), (n % 3 + 1).cast("int"))
    key = F.when(n % 3 == 0, F.col("key")).when(n % 3 == 1, F.create_map(F.lit("id"), user, F.lit("slot"), F.floor(n / 3 % 2).cast("int").cast("string"))).otherwise(F.create_map(F.lit("name"), F.concat(F.lit("u"), user)))
    return bases, change_log(spark, sf_dir).withColumn("tbl", tbl).withColumn("key", key)


def faulty_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log with empty keys, an unknown operation and updates that set nothing."""
    c, n = change_log(spark, sf_dir), F.col("seq") - 1
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    key = F.when(n % 17 == 0, none).otherwise(F.col("key"))
    op = F.when(n % 19 == 0, "truncate").otherwise(F.col("op"))
    values = F.when((n % 23 == 0) & (F.col("op") == "update"), F.col("key")).otherwise(F.col("values"))
    return c.select("pos", "seq", op.alias("op"), "tbl", key.alias("key"), values.alias("values"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(no, seq, i, value): the change log rendered as transcripts, one per 1,000 events; seq and i order the lines of a transcript."""
    e, n = change_log(spark, sf_dir), F.col("seq") - 1
    lit = lambda name: F.coalesce(F.concat(F.lit("'"), F.try_element_at("values", F.lit(name)), F.lit("' /* meta */")), F.lit("NULL"))
    cells = F.array(F.concat(F.lit("###   @1="), F.element_at("key", "id")), F.concat(F.lit("###   @2="), lit("segment")), F.concat(F.lit("###   @3="), lit("balance")))
    head = F.when(F.col("op") == "insert", "### INSERT INTO `db`.`accounts`").when(F.col("op") == "update", "### UPDATE `db`.`accounts`").otherwise("### DELETE FROM `db`.`accounts`")
    where, set_ = F.array(F.lit("### WHERE")), F.array(F.lit("### SET"))
    block = F.when(F.col("op") == "insert", F.concat(F.array(head), set_, cells)).when(F.col("op") == "update", F.concat(F.array(head), where, cells, set_, cells)).otherwise(F.concat(F.array(head), where, cells))
    number = F.floor(n / 1000).cast("long")
    rotate = F.when(n % 1000 == 0, F.array(F.concat(F.lit("#700101 Rotate to bin."), F.lpad(number.cast("string"), 6, "0"), F.lit("  pos: 4")))).otherwise(F.array().cast("array<string>"))
    close = F.array(F.concat(F.lit("# at "), (n % 1000 * 100 + 100).cast("string")))
    return e.select(number.alias("no"), "seq", F.posexplode(F.concat(rotate, F.array(F.concat(F.lit("# at "), (n % 1000 * 100).cast("string"))), block, close)).alias("i", "value"))


def transcript_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("accounts", 1, "id", True), ("accounts", 2, "segment", False), ("accounts", 3, "balance", False)], "tbl string, ordinal int, col string, pk boolean")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump per order: a customer's orders are chains that start at each status F."""
    o = table(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    starts = (F.col("o_orderstatus") == "F") | (F.row_number().over(by) == 1)
    o = o.withColumn("starts", starts).withColumn("chain", F.sum(F.col("starts").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("o_custkey", "chain").orderBy("o_orderdate", "o_orderkey")
    o = o.withColumn("first", F.first("o_orderkey").over(within)).withColumn("profile", F.first("o_orderpriority").over(within)).withColumn("prev", F.lag("o_orderkey").over(within))
    name = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    base = F.when(F.col("prev").isNotNull() | (F.col("o_orderkey") % 2 == 1), name("first")).otherwise("")
    driver = F.when(F.col("o_orderkey") % 97 == 0, "mariadb").when(F.col("o_custkey") % 3 == 0, "mysql").otherwise("postgres")
    return o.select(name("o_orderkey").alias("id"), "profile", driver.alias("driver"), F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderdate").alias("created"), base.alias("base_id"), F.coalesce(name("prev"), F.lit("")).alias("parent_id"))


def skewed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with bases that claim to be younger than what builds on them."""
    m = manifest(spark, sf_dir)
    late = (F.col("parent_id") == "") & (F.substring("id", 2, 20).cast("long") % 3 == 0)
    return m.withColumn("created", F.when(late, F.col("created") + F.expr("interval 9000 days")).otherwise(F.col("created")))


def broken_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with dumps missing, and with increments that are their own parents."""
    m = manifest(spark, sf_dir).withColumn("n", F.substring("id", 2, 20).cast("long"))
    loop = (F.col("n") % 101 == 0) & (F.col("parent_id") != "")
    return m.where("n % 13 <> 0").withColumn("parent_id", F.when(loop, F.col("id")).otherwise(F.col("parent_id"))).drop("n")


def policies(spark: SparkSession) -> DataFrame:
    """A default row and rows of two profiles."""
    rows = [("", 2, 0, 3, 0, 0), ("1-URGENT", 0, 40_000_000, 0, 2, 0), ("2-HIGH", 0, 0, 0, 0, 5)]
    return spark.createDataFrame(rows, "profile string, keep_last long, max_age_seconds long, gfs_daily long, gfs_weekly long, gfs_monthly long")


NOW = "2001-08-02 00:00:00"

# ---------------------------------------------------------------- the same in DuckDB's SQL

ACCOUNTS_SQL = """accounts AS (SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer
  WHERE c_custkey NOT IN (SELECT user_id FROM (SELECT user_id, arg_min(event_type, event_id) AS first FROM events GROUP BY user_id) WHERE first = 'signup'))"""

CHANGES_SQL = """changes AS (SELECT event_id + 1 AS seq, user_id AS id, event_type AS tbl,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  event_type IN ('signup', 'click', 'view') AS has_segment,
  CASE WHEN event_type = 'signup' THEN 'new' WHEN event_type = 'click' THEN 'click' WHEN event_type = 'view' AND user_id % 3 <> 0 THEN 'view' END AS segment,
  event_type IN ('signup', 'purchase', 'view') AS has_balance,
  CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN CAST(value AS DECIMAL(18,2)) END AS balance FROM events)"""


def fold_sql(changes: str = "changes", base: str = "accounts") -> str:
    """CTEs up to folded (id, segment, balance): the set form of replaying changes on a base."""
    return f"""
  entries AS (SELECT id, 0 AS seq, 'insert' AS op, true AS has_segment, segment, true AS has_balance, balance FROM {base}
    UNION ALL SELECT id, seq, op, has_segment, segment, has_balance, balance FROM {changes}),
  last_delete AS (SELECT id, max(CASE WHEN op = 'delete' THEN seq ELSE -1 END) AS d FROM entries GROUP BY id),
  starts AS (SELECT e.id, min(e.seq) AS s FROM entries e JOIN last_delete l ON e.id = l.id WHERE e.op = 'insert' AND e.seq > l.d GROUP BY e.id),
  live AS (SELECT e.* FROM entries e JOIN starts s ON e.id = s.id WHERE (e.op = 'insert' AND e.seq = s.s) OR (e.op = 'update' AND e.seq > s.s)),
  seg AS (SELECT id, segment, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM live WHERE has_segment),
  bal AS (SELECT id, balance, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM live WHERE has_balance),
  folded AS (SELECT s.id, seg.segment, bal.balance FROM starts s LEFT JOIN seg ON s.id = seg.id AND seg.r = 1 LEFT JOIN bal ON s.id = bal.id AND bal.r = 1)"""


#: many_tables() with a text for the key of every table.
MANY_SQL = f"""{ACCOUNTS_SQL}, {CHANGES_SQL},
  many_base AS (SELECT 'accounts:' || id AS id, segment, balance FROM accounts UNION ALL SELECT 'holdings:' || id || '/0', segment, balance FROM accounts UNION ALL SELECT 'nicknames:u' || id, segment, balance FROM accounts),
  many AS (SELECT seq, CASE (seq - 1) % 3 WHEN 0 THEN 'accounts:' || id WHEN 1 THEN 'holdings:' || id || '/' || ((seq - 1) // 3 % 2) ELSE 'nicknames:u' || id END AS id, op, has_segment, segment, has_balance, balance FROM changes)"""

MANIFEST_SQL = """ordered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
  chained AS (SELECT *, sum(CASE WHEN o_orderstatus = 'F' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS chain FROM ordered),
  linked AS (SELECT *, first_value(o_orderkey) OVER w AS first_key, first_value(o_orderpriority) OVER w AS prof, lag(o_orderkey) OVER w AS prev
    FROM chained WINDOW w AS (PARTITION BY o_custkey, chain ORDER BY o_orderdate, o_orderkey)),
  manifest AS (SELECT 'd' || CAST(o_orderkey AS VARCHAR) AS id, prof AS profile,
    CASE WHEN o_orderkey % 97 = 0 THEN 'mariadb' WHEN o_custkey % 3 = 0 THEN 'mysql' ELSE 'postgres' END AS driver,
    CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS created,
    CASE WHEN prev IS NOT NULL OR o_orderkey % 2 = 1 THEN 'd' || CAST(first_key AS VARCHAR) ELSE '' END AS base_id,
    CASE WHEN prev IS NULL THEN '' ELSE 'd' || CAST(prev AS VARCHAR) END AS parent_id FROM linked)"""

CHAINS_SQL = """rooted AS (SELECT *, CASE WHEN base_id = '' THEN id ELSE base_id END AS root FROM manifest),
  chains AS (SELECT root, min(profile) AS profile, max(created) AS newest, count(*) AS members, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM rooted GROUP BY root)"""
