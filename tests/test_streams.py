"""Streams with state, counters over batches, what a batch reads, and the layouts that they read from."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablesync.model import CHANGE
from tablesync.operators import apply
from tablesync.sources import rows as rows_io
from tablesync.streaming.cdc import Table, Target, apply_stream, catch_up, change_stream
from tablesync.streaming.counters import RunningCounts, applied_stream
from tablesync.streaming.state import CurrentRows, current_rows


def log_of(spark, rows):
    """rows: (seq, op, tbl, key, values)."""
    return spark.createDataFrame([(Decimal(s), s, op, t, {"id": str(k)}, v) for s, op, t, k, v in rows], CHANGE)


def run(stream, sink, checkpoint, mode="append"):
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_state_starts_from_the_base_and_equals_a_merge(spark, tmp_path):
    """Random changes in three runs over a base; one key is hot, and its inserts and deletes come in any order within a run."""
    rng = random.Random(3)
    base = spark.createDataFrame([(k, f"b{k}", None if k % 2 else "x") for k in range(8)], "id long, a string, b string")
    rows = []
    for seq in range(1, 400):
        key = 1 if rng.random() < 0.5 else rng.randint(0, 11)
        op = rng.choice(["insert", "update", "update", "delete"])
        values = {} if op == "delete" else {c: rng.choice([None, "p", "q"]) for c in "ab" if op == "insert" or rng.random() < 0.6}
        rows.append((seq, op, "t", key, values | ({"id": str(key)} if op == "insert" else {})))
    path, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    for n in range(3):
        log_of(spark, rows[133 * n : 133 * (n + 1)]).orderBy(F.rand(n)).repartition(3).write.mode("append").parquet(path)
        run(current_rows(change_stream(spark, path), "id", base), lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/{k}"), f"file://{tmp_path}/cp", "update")
    sent = spark.read.parquet(*[f"{out}/{k}" for k in range(3)]).groupBy("key").agg(F.max_by(F.struct("alive", "row"), "seq").alias("s")).collect()
    got = {r.id: (r.a, r.b) for r in base.collect()}
    for r in sent:
        got.pop(int(r.key), None)
        if r.s.alive:
            got[int(r.key)] = (r.s.row.get("a"), r.s.row.get("b"))
    want = {r.id: (r.a, r.b) for r in apply.merge(base, log_of(spark, rows), ["id"]).collect()}
    assert got == want


def test_counts_of_batches_add_up(spark, tmp_path):
    rows = [(s, "insert" if s % 3 else "delete", "hot" if s % 5 else "cold", s, {"id": str(s)}) for s in range(1, 301)]
    path, running, seen = f"file://{tmp_path}/log", RunningCounts(spark, f"file://{tmp_path}/running"), {}

    def keep(batch, n):
        seen.update({(r.tbl, r.op): r.applied for r in batch.collect()})

    for part in (rows[:100], rows[100:150], rows[150:]):
        log_of(spark, part).write.mode("append").parquet(path)
        run(applied_stream(change_stream(spark, path)), keep, f"file://{tmp_path}/cp", "update")
        running.follow(change_stream(spark, path), f"file://{tmp_path}/cp2").awaitTermination()
    version, state = running._state()
    running.add(log_of(spark, rows[150:]), state["batch_id"], state["stream"])  # delivered again
    assert running._state()[0] == version and running.totals() == {"hot": 240, "cold": 60}
    want = {}
    for tbl in ("hot", "cold"):
        want |= {(tbl, s): n for n, s in enumerate([r[0] for r in rows if r[2] == tbl], 1)}
    assert {(r.tbl, r.seq): r.running for r in running.read().collect()} == want
    assert seen == {(t, op): sum(r[1] == op and r[2] == t for r in rows) for t in ("hot", "cold") for op in ("insert", "delete")}


def test_a_batch_reads_a_bounded_number_of_files(spark, tmp_path):
    """Five files that wait at once come in three batches of two files at most, in order, and each batch is a version of its own."""
    path = f"file://{tmp_path}/log"
    for n in range(5):
        log_of(spark, [(10 * n + i, "update", "t", 1, {"v": f"{n}.{i}"}) for i in range(1, 4)]).coalesce(1).write.mode("append").parquet(path)
    base = spark.createDataFrame([(1, "old")], "id long, v string")
    target = Target(spark, f"file://{tmp_path}/t", {"t": Table(base.schema, ["id"])})
    target.create({"t": base}, 0)
    apply_stream(change_stream(spark, path, 2), target, f"file://{tmp_path}/cp").awaitTermination()
    assert [target.read("t", v).first().v for v in range(target.version() + 1)] == ["old", "1.3", "3.3", "4.3"]
    assert [int(target._state(v)["applied"]) for v in range(4)] == [0, 6, 12, 15]


def test_a_stream_stops_within_a_file_and_goes_on_there(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for rows in ([(s, "update", "t", 1, {"v": str(s)}) for s in range(1, 6)], [(s, "insert", "t", s, {"id": str(s), "v": "new"}) for s in range(6, 11)]):
        log_of(spark, rows).coalesce(1).write.mode("append").parquet(path)
    base = spark.createDataFrame([(1, "old")], "id long, v string")
    target = Target(spark, f"file://{tmp_path}/t", {"t": Table(base.schema, ["id"])})
    target.create({"t": base}, 0)
    rows = lambda: {r.id: r.v for r in target.read("t").collect()}
    for stop, want in ((3, {1: "3"}), (7, {1: "5", 6: "new", 7: "new"}), (None, {1: "5"} | {k: "new" for k in range(6, 11)})):
        for _ in range(2):  # a second run finds nothing to do
            apply_stream(change_stream(spark, path, 1), target, f"file://{tmp_path}/cp", stop=stop).awaitTermination()
            assert rows() == want and int(target.position()[0]) == (stop or 10)


def test_catching_up_by_position(spark, tmp_path):
    """Bounded batches, stretches without changes, a bad change in the middle, and a stream that goes on from there."""
    path = f"file://{tmp_path}/log"
    rows = [(s, "insert", "t", s, {"id": str(s), "v": "x"}) for s in (1, 2, 3, 500, 501, 900)]
    rows_io.write_log(log_of(spark, [*rows, (502, "truncate", "t", 1, {})]), path, 100)
    base = spark.createDataFrame([], "id long, v string")
    target = Target(spark, f"file://{tmp_path}/t", {"t": Table(base.schema, ["id"])})
    target.create({"t": base}, 0)
    ids = lambda: sorted(r.id for r in target.read("t").collect())
    with pytest.raises(Exception, match="bad change"):
        catch_up(target, path, 100, positions=250)
    assert ids() == [1, 2, 3, 500]  # the batches before the bad one
    catch_up(target, path, 100, stop=502, mode="quarantine")
    assert ids() == [1, 2, 3, 500, 501] and target.counts() == (5, 1)
    catch_up(target, path, 100)
    catch_up(target, path, 100)
    assert ids() == [1, 2, 3, 500, 501, 900] and target.counts() == (6, 1) and int(target.position()[0]) == 900
    later = f"file://{tmp_path}/later"
    log_of(spark, [*rows, (901, "delete", "t", 1, {})]).write.parquet(later)
    apply_stream(change_stream(spark, later), target, f"file://{tmp_path}/cp").awaitTermination()
    assert ids() == [2, 3, 500, 501, 900]


def files_read(df) -> int:
    """How many files the scans of a query have opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in text.splitlines()[0] else plan
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numFiles").value()) for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_a_bounded_read_opens_the_files_that_overlap(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = spark.range(1, 10_001).select(F.col("id").cast("decimal(20,0)").alias("pos"), F.col("id").alias("seq"), F.lit("delete").alias("op"), F.lit("t").alias("tbl"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("key"), F.create_map().cast("map<string,string>").alias("values"))
    rows_io.write_log(log.where("pos <= 6000"), path, 500)
    rows_io.write_log(log.where("pos > 6000"), path, 500)  # a log grows at its end
    every, some = rows_io.read_log(spark, path, 500), rows_io.read_log(spark, path, 500, 2600, 3400)
    assert [r.seq for r in some.orderBy("seq").collect()] == list(range(2601, 3401)) and every.count() == 10_000
    assert files_read(some) <= 4 < 20 <= files_read(every)
    assert rows_io.read_log(spark, path, 500, stop=10).count() == 10 and rows_io.read_log(spark, path, 500, since=9_999).count() == 1


def test_variants_keep_null_and_absent_apart(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows_io.write_rows({"a": spark.sql("select 1 as id, cast(null as string) as name, cast(2.50 as decimal(9,2)) as d"), "b": spark.sql("select 7L as `k'ey`, 'x' as name")}, path)
    rows = rows_io.load_variants(spark, path)
    flags = {r.tbl: (r.n, r.d) for r in rows.select("tbl", rows_io.variant_absent("row", "name").alias("n"), rows_io.variant_absent("row", "d").alias("d")).collect()}
    assert flags == {"a": (False, False), "b": (False, True)}
    kinds = {r.tbl: r.schema for r in rows_io.variant_schemas(rows).collect()}
    assert "name: VOID" in kinds["a"] and "id: BIGINT" in kinds["a"] and "name: STRING" in kinds["b"]
    schemas = {r["tbl"]: r["schema"] for r in map(json.loads, spark.read.text(f"{path}/schema").toPandas()["value"])}
    from pyspark.sql.types import StructType

    for tbl, want in (("a", (1, None, Decimal("2.50"))), ("b", (7, "x"))):
        kind = StructType.fromJson(json.loads(schemas[tbl]))
        got = rows_io.variant_columns(rows.where(F.col("tbl") == tbl), kind)
        assert tuple(got.first()) == want and [f.dataType for f in got.schema] == [f.dataType for f in kind]
    (tmp_path / "rows" / "tbl=a" / "odd.txt").write_text('{"t": "a", "v": {oops\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        rows_io.load_variants(spark, path).collect()


def test_state_is_a_value_for_each_bucket_of_keys(spark, tmp_path):
    """Calls of the state store grow with buckets, not with keys and columns."""
    base = spark.range(300).select("id", F.lit("b").alias("a"), F.lit("c").alias("b"))
    log_of(spark, [(s, "update", "t", s, {"a": "u"}) for s in range(1, 201)]).write.parquet(f"file://{tmp_path}/log")
    states = current_rows(change_stream(spark, f"file://{tmp_path}/log"), "id", base, buckets=5)
    running = states.writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.write.parquet(f"file://{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    running.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]) <= 5
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert {(int(r.key), r.seq, r.alive, r.row["a"], r.row["b"]) for r in got} == {(s, s, True, "u", "c") for s in range(1, 201)} and len(got) == 200


class Held:
    """State variables of one group, in memory."""

    def __init__(self):
        self.of = {}

    def getValueState(self, name, schema):
        return self.of.setdefault(name, Value())

    getMapState = lambda self, name, key, value: self.of.setdefault(name, Map())


class Value:
    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(Value):
    def __init__(self):
        self.value = {}

    exists = lambda self: bool(self.value)
    keys = lambda self: iter(list(self.value))
    iterator = lambda self: iter(list(self.value.items()))

    def updateValue(self, key, value):
        self.value[key] = value

    def clear(self):
        self.value = {}


def replayed(rows, state):
    """Rows (seq, op, key, values) one after the other; state: key to row."""
    for _, op, key, values in sorted(rows):
        if op == "delete":
            state.pop(key, None)
        elif op == "insert":
            state.setdefault(key, dict(values))
        elif key in state:
            state[key].update(values)
    return state


@pytest.mark.parametrize("max_waiting", [1, 7, 50_000])
def test_a_bucket_folds_changes_in_any_order(max_waiting):
    """Inserts in memory and in the state store give what a replay gives, batch after batch."""
    import pandas as pd

    rng = random.Random(max_waiting)
    processor, held, want, seq = CurrentRows(max_waiting), Held(), {"k0": {"a": "0", "b": None}}, 0
    processor.init(held)
    processor.handleInitialState((0,), pd.DataFrame({"k": ["k0"], "vals": ['{"a": "0", "b": null}']}), None)
    for _ in range(12):
        rows = []
        for _ in range(rng.randint(1, 40)):
            seq += 1
            op = rng.choice(["insert", "insert", "update", "delete"])
            rows.append((seq, op, f"k{rng.randint(0, 3)}", {} if op == "delete" else {c: rng.choice([None, "p", "q"]) for c in "ab" if rng.random() < 0.7}))
        cells = [(0, k, s, op, n, v) for s, op, k, values in rows for n, v in (values.items() or [(None, None)])]
        rng.shuffle(cells)
        pieces = [pd.DataFrame(cells[i : i + 9], columns=["bucket", "k", "seq", "op", "name", "value"]) for i in range(0, len(cells), 9)]
        (out,) = processor.handleInputRows((0,), iter(pieces), None)
        want = replayed(rows, want)
        assert json.loads(held.of["rows"].value[0]) == want and not held.of["inserts"].value
        assert {r.key: (r.seq, json.loads(r.vals) if r.alive else None) for r in out.itertuples()} == {k: (max(s for s, _, of, _ in rows if of == k), want.get(k)) for k in {r[2] for r in rows}}


def read_through(lines):
    """Blocks (pos, seq, file, op, tbl, cells) of a file's parsed lines, line by line; those without a position are left out."""
    out, waiting, file, start, section, is_open = [], [], None, None, "", False
    for r in lines:
        file = r["rotate"] or file
        if r["marker"] is not None or r["ended"]:
            pos = r["marker"] if r["marker"] is not None else (start or 0) + 1
            out += [(pos, *b) for b in waiting]
            waiting, is_open = [], False
            start = r["marker"] if r["marker"] is not None else start
        elif r["op"] is not None:
            section, is_open = "", True
            waiting.append((len(out) + len(waiting) + 1, file, r["op"], r["tbl"], []))
        elif r["section"] is not None:
            section = r["section"]
        elif r["n"] is not None and is_open:
            waiting[-1][4].append({"old": section == "WHERE", "n": r["n"], "text": r["text"]})
    return out


@pytest.mark.parametrize("seed", range(20))
def test_blocks_of_packs_equal_a_reading_line_by_line(seed, monkeypatch):
    """Random lines in random order within batches cut anywhere; some come twice; few blocks to a pack."""
    import pyarrow as pa

    from tablesync.streaming import transcripts
    from tablesync.streaming.transcripts import BLOCKS, LINES, OpenBlocks, _pack, _unpack
    from pyspark.sql.types import Row

    monkeypatch.setattr(transcripts, "MAX_BLOCKS", 2)
    rng, kinds = random.Random(seed), {
        "op": lambda i: {"op": rng.choice(["insert", "update"]), "tbl": f"t{i}"}, "cell": lambda i: {"n": rng.randint(1, 3), "text": rng.choice([None, f"x{i}"])}, "section": lambda i: {"section": rng.choice(["WHERE", "SET"])},
        "marker": lambda i: {"marker": 10 * i}, "rotate": lambda i: {"rotate": f"bin.{i}"}, "both": lambda i: {"rotate": f"bin.{i}", "marker": 10 * i}, "ended": lambda i: {"ended": True},
    }
    lines = []
    for i in range(rng.randint(1, 80)):
        kind = rng.choices(list(kinds), [3, 8, 3, seed % 3, 1, 0.3, 0.5])[0]
        lines.append({f.name: None for f in LINES} | {"line_no": 2 * i, "ended": False} | kinds[kind](i))
    processor, held, got, at = OpenBlocks(), Held(), [], 0
    processor.init(held)
    while at < len(lines):
        end = at + rng.randint(1, 12)
        batch = lines[max(0, at - rng.randint(0, 4)) : end] + lines[at : at + 1]
        rng.shuffle(batch)
        packs = [pa.RecordBatch.from_pylist(batch[i : i + 5], schema=LINES) for i in range(0, len(batch), 5)]
        got += [tuple(b.values()) for r in processor.handleInputRows(("f",), iter([Row(path="f", pack=_pack(p)) for p in packs]), None) for b in _unpack(r.pack, BLOCKS).to_pylist()]
        at = end
    assert got == read_through(lines)
