import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.positions import binlog_order, lsn_number, lsn_text
from tablesync.functions.text import assignment_ordinal, assignment_value, clamp, marker_offset, rotate_target, table_name
from tablesync.operators import decode, types
from tablesync.sources import manifest as manifests
from tablesync.sources import rows as rows_io


def catalog(spark, cols):
    return spark.createDataFrame([("t", i, f"c{i}", d, c, True, 0, 0) for i, (d, c) in enumerate(cols)], "tbl string, ordinal int, col string, data_type string, column_type string, nullable boolean, precision int, scale int")


def test_native_to_canonical(spark):
    pg = [("integer", "int"), ("smallint", "int"), ("BIGINT", "bigint"), ("text", "text"), ("character varying", "varchar"), ("boolean", "boolean"), ("numeric", "numeric"), ("uuid", "uuid"), ("timestamp with time zone", "timestamptz"), ("jsonb", "json"), ("bytea", None), ("geometry", None), ("timestamp without time zone", None), ("double precision", None)]
    got = types.to_canonical(catalog(spark, [(d, d) for d, _ in pg]), "postgres").orderBy("ordinal").collect()
    assert [r.canonical for r in got] == [c for _, c in pg]
    my = [("tinyint", "tinyint(1)", "boolean"), ("tinyint", "tinyint(4)", "int"), ("char", "char(36)", "uuid"), ("char", "char(10)", "text"), ("datetime", "datetime", "timestamptz"), ("longtext", "longtext", "text"), ("decimal", "decimal(10,2)", "numeric"), ("blob", "blob", None), ("varbinary", "varbinary(9)", None)]
    got = types.to_canonical(catalog(spark, [m[:2] for m in my]), "mariadb").orderBy("ordinal").collect()
    assert [r.canonical for r in got] == [m[2] for m in my]
    with pytest.raises(types.UnsupportedType, match="t.c1"):
        types.require_supported(catalog(spark, [("text", "text"), ("blob", "blob")]), "mysql")
    with pytest.raises(ValueError):
        types.to_canonical(catalog(spark, [("text", "text")]), "oracle")


def test_canonical_to_native(spark):
    rows = spark.createDataFrame([("varchar", 255, 0), ("varchar", 0, 0), ("numeric", 10, 2), ("int", 9, 0), ("json", 0, 0)], "c string, p int, s int")
    native = lambda e: [r[0] for r in rows.select(types.native_type(F.col("c"), F.col("p"), F.col("s"), e)).collect()]
    assert native("postgres") == ["varchar(255)", "varchar", "numeric(10,2)", "integer", "jsonb"]
    assert native("mysql") == ["VARCHAR(255)", "VARCHAR", "DECIMAL(10,2)", "INT", "JSON"]
    with pytest.raises(types.UnsupportedType):
        types.spark_type("numeric", 40, 2)


def test_dataframe_schemas(spark):
    schema = T.StructType().add("id", T.IntegerType()).add("name", T.StringType()).add("d", T.DecimalType(9, 2)).add("x", T.DoubleType())
    got = {r.col: r.canonical for r in types.catalog_of(spark, {"t": schema}).collect()}
    assert got == {"id": "int", "name": "text", "d": "numeric", "x": None}
    assert types.create_table_columns(T.StructType(schema.fields[:3]), "postgres") == "id integer, name text, d numeric(9,2)"


def test_positions(spark):
    df = spark.createDataFrame([("0/0",), ("10/0",), ("2/FFFFFFFF",), ("FFFFFFFF/FFFFFFFF",), ("bad",), (None,)], "l string")
    got = [r[0] for r in df.select(lsn_number(F.col("l"))).collect()]
    assert [None if x is None else int(x) for x in got] == [0, 16 << 32, (2 << 32) + 0xFFFFFFFF, 2**64 - 1, None, None]
    assert [r[0] for r in df.limit(3).select(lsn_text(lsn_number(F.col("l")))).collect()] == ["0/0", "10/0", "2/FFFFFFFF"]
    assert tuple(spark.range(1).select(binlog_order(F.lit("bin.000012"), F.lit(5))).first()[0]) == (12, 5)


def test_text_expressions(spark):
    cases = [
        ("@12=-7.50", 12, "-7.50", False), ("@1='Lyon'", 1, "Lyon", False), ("@2='L''Isle-d''Abeau'", 2, "L'Isle-d'Abeau", False), ("@3=NULL", 3, None, True), ("@3='NULL'", 3, "NULL", False),
        ("@4='null'", 4, "null", False), ("@5=2024-02-29 /* DATE meta=0 nullable=1 is_null=0 */", 5, "2024-02-29", False), ("@6='1 /* 2 */ 3' /* STRING(9) */", 6, "1 /* 2 */ 3", False),
        ("@7='/*'", 7, "/*", False), (r"@8='back\\slash and \'tick\''", 8, r"back\slash and 'tick'", False), ("@9='' /* empty */", 9, "", False),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases] + [("at 5 = 6",)], "b string")
    got = df.select(assignment_ordinal(F.col("b")).alias("n"), assignment_value(F.col("b")).alias("v")).collect()
    assert [(r.n, r.v.text, r.v.is_null) for r in got[:-1]] == [c[1:] for c in cases]
    assert got[-1].n is None
    names = {"`harbour`.`ships`": "ships", "harbour.ships": "ships", "`ships`": "ships", "ships": "ships", "`harbour`.`berths` SET": "berths"}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "r string").select(table_name(F.col("r"))).collect()] == list(names.values())
    r = spark.range(1).select(marker_offset(F.lit("# at 1234")).alias("m"), marker_offset(F.lit("# of 1")).alias("o"), rotate_target(F.lit("#1 Rotate to bin.000002  pos: 4")).alias("f"), clamp(F.lit(-3)).alias("c"), clamp(F.lit(None).cast("long")).alias("z")).first()
    assert tuple(r) == (1234, None, "bin.000002", 0, 0)


#: Three events, the second of which holds two changes; only the forms of the lines are fixed values.
HARBOUR = """# at 900
### DELETE FROM `harbour`.`ships`
### WHERE
###   @1='Aurora'
###   @2=NULL
# at 1310
### INSERT INTO `harbour`.`ships`
### SET
###   @1='Borea' /* STRING(20) */
###   @2=41
###   @3='beyond the columns'
### UPDATE `harbour`.`ships`
### WHERE
###   @1='Borea'
###   @2=41
### SET
###   @1='Boreas'
###   @2=NULL
# at 1777
### UPDATE `harbour`.`tides`
### WHERE
###   @1=3
### SET
###   @1=4
"""
HARBOUR_CATALOG = [("ships", 1, "name", True), ("ships", 2, "crew", False), ("tides", 1, "height", False)]
HARBOUR_CHANGES = [
    ("delete", "ships", 1310, {"name": "Aurora"}, {}),
    ("insert", "ships", 1777, {"name": "Borea"}, {"name": "Borea", "crew": "41"}),
    ("update", "ships", 1777, {"name": "Borea"}, {"name": "Boreas", "crew": None}),
    ("update", "tides", 1778, {"height": "3"}, {"height": "4"}),
]


def test_transcript(spark, tmp_path):
    (tmp_path / "log.txt").write_text(HARBOUR)
    cat = spark.createDataFrame(HARBOUR_CATALOG, "tbl string, ordinal int, col string, pk boolean")
    got = decode.transcript_changes(rows_io.read_lines(spark, f"file://{tmp_path}"), cat).orderBy("seq").collect()
    assert [(r.op, r.tbl, int(r.pos), r.key, r["values"]) for r in got] == HARBOUR_CHANGES


def test_transcript_as_a_stream_cut_anywhere(spark, tmp_path):
    """Wherever a file's growth is cut, a block is sent with the marker behind it, once, and lines that come again are passed over."""
    from tablesync.streaming.transcripts import transcript_stream

    lines = list(enumerate([*HARBOUR.splitlines(), "# End of log file"]))
    cat = spark.createDataFrame(HARBOUR_CATALOG, "tbl string, ordinal int, col string, pk boolean")
    cuts = [[], [3], [1, 8, 9, 16, 20], [len(lines) - 1]]
    read, out, sent = f"file://{tmp_path}/in", f"file://{tmp_path}/out", {}
    for k in range(6):
        rows = []
        for f, at in enumerate(cuts):
            bounds = [0, *at, *[len(lines)] * (6 - len(at))]
            rows += [(f"f{f}", n, text) for n, text in lines[max(0, bounds[k] - 2) : bounds[k + 1]]]  # two lines are delivered again
        spark.createDataFrame(rows, "path string, line_no long, line string").write.mode("append").parquet(read)
        stream = transcript_stream(spark.readStream.schema("path string, line_no long, line string").parquet(read), cat)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        sent[k] = spark.read.parquet(f"{out}/{k}").where("path = 'f2'").count()
    got = spark.read.parquet(*[f"{out}/{k}" for k in range(6)]).orderBy("path", "seq").collect()
    assert [(r.path, r.op, r.tbl, int(r.pos), r.key, r["values"]) for r in got] == [(f"f{f}", *c) for f in range(4) for c in HARBOUR_CHANGES]
    assert sent == {0: 0, 1: 1, 2: 0, 3: 0, 4: 2, 5: 1}


def test_a_long_transcript_in_many_splits(spark, tmp_path):
    lines, want = ["#700101 Rotate to bin.000042  pos: 4"], []
    for n in range(3000):
        if n % 7 == 0:
            lines.append(f"# at {100 * n}")
        lines += ["### INSERT INTO `s`.`t`", "### SET", f"###   @1={n}", f"###   @2='{'x' * (n % 40)}'"]
        nxt = 100 * (n - n % 7 + 7)
        want.append((n + 1, nxt if nxt < 300_000 else 100 * (n - n % 7) + 1, str(n), "x" * (n % 40)))
    (tmp_path / "one.txt").write_text("\n".join(lines) + "\n")
    cat = spark.createDataFrame([("t", 1, "id", True), ("t", 2, "v", False)], "tbl string, ordinal int, col string, pk boolean")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read = rows_io.read_lines(spark, f"file://{tmp_path}")
        assert read.select("split").distinct().count() > 10
        got = decode.transcript_changes(read, cat).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.seq, int(r.pos), r["values"]["id"], r["values"]["v"]) for r in got] == want
    assert {r.file for r in got} == {"bin.000042"}


def test_tuples(spark):
    rel = spark.createDataFrame([(1, "t", 1, "id", True), (1, "t", 2, "v", False), (2, "k", 1, "a", False), (2, "k", 2, "b", False)], "rel_id int, tbl string, ordinal int, col string, is_key boolean")
    cells = [(1, "insert", 1, "new", 1, "t", "5"), (1, "insert", 1, "new", 2, "n", None), (2, "update", 1, "old", 1, "t", "4"), (2, "update", 1, "new", 1, "t", "5"), (2, "update", 1, "new", 2, "u", None), (3, "delete", 2, "old", 1, "t", "x"), (3, "delete", 2, "old", 2, "n", None), (4, "begin", 1, "new", 1, "t", "1"), (5, "insert", 9, "new", 1, "t", "1")]
    df = spark.createDataFrame(cells, "seq long, op string, rel_id int, image string, ordinal int, kind string, value string")
    with pytest.raises(Exception, match="unknown relation 9"):
        decode.tuple_changes(df, rel).collect()
    got = decode.tuple_changes(df, rel, unknown="skip").orderBy("seq").collect()
    assert [(r.seq, r.key, r["values"]) for r in got] == [(1, {"id": "5"}, {"id": "5", "v": None}), (2, {"id": "4"}, {"id": "5"}), (3, {"a": "x", "b": None}, {})]
    assert [r.rel_id for r in decode.unknown_relations(df, rel).collect()] == [9]


def test_sidecars_and_envelopes(spark, tmp_path):
    (tmp_path / "a.meta.json").write_text('{"id": "a", "created": "2026-01-01T00:00:00", "size_bytes": 5,\n "tables": [{"name": "t", "rows": 1, "size_bytes": 2}]}')
    (tmp_path / "b.meta.json").write_text('{"id": "b", "crea')
    (tmp_path / "c.meta.json").write_text('{"id": "../c", "created": "2026-01-01T00:00:00"}')
    (tmp_path / "d.txt").write_text("no sidecar")
    (tmp_path / "e.meta.json").write_text('{"id": "e", "created": "2026-02-01T00:00:00"}')
    assert [r.id for r in manifests.newest_first(manifests.scan_sidecars(spark, f"file://{tmp_path}")).collect()] == ["e", "a"]
    good = spark.range(1).select(manifests.envelope(F.lit('{"type":"base","driver":"mysql","wal_end":"0/1"}'), F.lit("body")).alias("c")).first().c
    assert len(good) == 4096 + 4
    (tmp_path / "x.dump").write_bytes(bytes(good))
    (tmp_path / "y.dump").write_bytes(bytes(good)[:100])
    (tmp_path / "z.dump").write_bytes(b"XXXX" + bytes(good)[4:])
    (tmp_path / "w.dump").write_bytes(bytes(good)[:4] + b"{oops" + bytes(good)[9:])
    got = {r.id: (r.status, r.type, r.wal_end) for r in manifests.audit_envelopes(manifests.read_bodies(spark, f"file://{tmp_path}", "*.dump")).collect()}
    assert got == {"x": ("ok", "base", "0/1"), "y": ("short read", None, None), "z": ("missing magic", None, None), "w": ("bad json", None, None)}


def test_rows_round_trip(spark, tmp_path):
    df = spark.sql("select 1 as id, cast(null as string) as name, cast(1.50 as decimal(9,2)) as d, 9007199254740993L as big, cast('x' as binary) as raw")
    rows_io.write_rows({"t": df}, f"file://{tmp_path}/r")
    got = rows_io.load_rows(spark, f"file://{tmp_path}/r")["t"].first()
    assert (got.id, got.name, str(got.d), got.big, got.raw) == (1, None, "1.50", 2**53 + 1, "x")
    with pytest.raises(types.UnsupportedType):
        rows_io.write_rows({"t": spark.sql("select cast(1 as double) as x")}, f"file://{tmp_path}/bad")
    with pytest.raises(ValueError, match="duplicate"):
        rows_io.append_rows(spark.sql("select 1 as id"), spark.sql("select 1 as id"), ["id"])
    assert rows_io.select_tables(["a", "b", "c"], exclude=["b"], exclude_data=["c"]) == {"a": (True, True), "c": (True, False)}


def test_lines_of_a_stream_travel_in_packs():
    """An Arrow batch of lines is a row for each of its files, and lines that say nothing are left out: rows of the state don't grow with lines."""
    import pyarrow as pa

    from tablesync.streaming.transcripts import LINES, _packed_lines, _unpack

    files = [None, "b", "a"] * 100
    given = {"path": pa.array(files, pa.string())} | {f.name: pa.nulls(300, f.type) for f in LINES}
    given |= {"line_no": pa.array(range(300)), "marker": pa.array([i if i % 2 else None for i in range(300)], pa.int64()), "ended": pa.array([False] * 300)}
    (out,) = _packed_lines(iter([pa.RecordBatch.from_pydict(given)]))
    got = {path: _unpack(pack, LINES).to_pylist() for path, pack in zip(out["path"].to_pylist(), out["pack"].to_pylist())}
    assert len(out) == 3 and {path: [(r["line_no"], r["marker"]) for r in rows] for path, rows in got.items()} == {f: [(i, i) for i in range(300) if i % 2 and files[i] == f] for f in files}
    (none,) = _packed_lines(iter([pa.RecordBatch.from_pydict(given).slice(0, 1)]))
    assert len(none) == 0
