import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesync.llm import neighbours, shards
from tablesync.llm.neighbours import estimates, one_bit_codes, rotation, search
from tablesync.llm.quotes import link_quotes

from .conftest import odd_rows

# ------------------------------------------------------------------ nearest neighbours


def brute(rows, query_ids, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i in query_ids:
            best = {}
            for j, w in good:
                if j != i and len(w) == len(v):
                    best[j] = max(best.get(j, -2), round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12))
            out.setdefault(i, sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    return out


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 48))
    rows = [(i, (centre[i % 20] + 0.7 * rng.standard_normal(48)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(search(df, df.where("vec_id % 50 = 0"), sample_rows=100, growth=3, query_block=7)), brute(rows, set(range(0, 1500, 50)), 5)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 5 * len(want)


def test_odd_vectors_ties_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (50, [1e-200, 1e-200]), (8, [-1.0, 0.0]), (9, []), (100, [3.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(search(df, df.where("vec_id % 50 = 0"))) == brute([(i, [x * 1e200 for x in v] if i == 50 else v) for i, v in rows], {0, 50, 100}, 5)
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_many_copies_of_one_vector(spark):
    df = spark.range(900).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), F.when(F.col("id") % 3 == 0, 3.0).otherwise(F.col("id") / 100)).alias("embedding"))
    got = found(search(df, df.where("vec_id = 300"), sample_rows=100))
    assert [v for v, _ in got[300]] == [0, 3, 6, 9, 12]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 64)))
    a, b = unit(2000), unit(20)
    for bits in (64, 256):
        turn = rotation(64, bits, 3)
        codes, f = one_bit_codes(a, turn)
        assert codes.shape == (2000, bits // 8)
        est, err = estimates(codes, f, b @ turn.T, 2.5)
        assert (np.abs(est - a @ b.T) <= err[:, None]).mean() > 0.97
        assert abs((est - a @ b.T).mean()) < 0.005 and err.max() < 3 / np.sqrt(bits)


def test_the_query_finds_the_nearest_and_measures_few(spark, monkeypatch):
    """Recall of the registered query over its whole table, and the share of pairs that its codes leave to be measured."""
    sf_dir, left = "/root/testdata/sf0.1", []
    plain = neighbours._survivors
    monkeypatch.setattr(neighbours, "_survivors", lambda *a: left.append(plain(*a)) or left[-1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got, hits, asked = found(neighbours.op7_one_bit_search(spark, sf_dir)), 0, np.flatnonzero(ids % 50 == 0)
    for q in asked:
        score = np.where(ids == ids[q], -2, v @ v[q])
        hits += len({x for x, _ in got[ids[q]]} & set(ids[np.argsort(-score)[:5]].tolist()))
    assert hits >= 0.98 * 5 * len(asked)
    assert left[-1].count() < 0.1 * len(ids) * len(asked)


def test_vectors_with_other_columns(spark):
    df = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"), *[F.lit("x").alias(c) for c in ("v", "q", "t", "code", "f", "ids", "row_id", "q_row", "score", "rank", "query_id")])
    assert len(found(search(df, df.where("vec_id < 2")))[1]) == 5


# ------------------------------------------------------------------ quotations


def test_nested_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nSecond para here"),
        (1, 1, "a", "On Mon, Bob wrote:\n> hello   THERE.\nI agree"),
        (1, 2, "u", "> > Hello there.\n> I agree\nno"),
        (1, 3, None, None),
        (2, 0, "u", "> I agree\nelse"),
        (2, 1, "u", "> unknown thing\n> here\nbye"),
        (1, 1, "a", "On Mon, Bob wrote:\n> hello   THERE.\nI agree"),
        (None, 1, "x", "> I agree"),
        (3, 5, "u", ">"),
        (3, 6, "u", "1 > 0, said Ann:\nfine"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    assert len(got) == 9 and link_quotes(df).count() == 10
    text = {k: r.text for k, r in got.items()}
    assert text[1, 1] == "I agree" and text[1, 2] == "no" and text[1, 3] == "" and text[3, 6] == "1 > 0, said Ann:\nfine" and text[3, 5] == ""
    parent = {k: tuple(r.parent) if r.parent else None for k, r in got.items()}
    assert parent[1, 1] == (1, 0) and parent[1, 2] == (1, 1) and parent[2, 0] == (1, 1) and parent[2, 1] is None
    assert [tuple(p) for p in got[1, 2].path] == [(1, 0), (1, 1), (1, 2)]
    assert got[2, 1].thread_id == 1 and got[3, 5].thread_id == 3
    assert (got[1, 2].n_quoted, got[1, 2].n_found, got[2, 1].n_found) == (2, 2, 0)


def test_an_announcing_line_inside_a_quotation(spark):
    rows = [
        (1, 0, "u", "X"),
        (1, 1, "a", "Y\nOn Mon, A wrote:\n> X"),
        (1, 2, "u", "Z\nOn Tue, B wrote:\n> Y\n> On Mon, A wrote:\n>> X"),
        (1, 3, "a", "On Wed, C wrote:\n> On Tue, B wrote:\n>> Y\n>> On Mon, A wrote:\n>>> X\n> Z\nW"),
        (1, 4, "u", "> he wrote:\nend"),  # announces nothing: a passage
    ]
    got = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: r.parent.turn if r.parent else None for t, r in got.items()} == {0: None, 1: 0, 2: 1, 3: 2, 4: None}
    assert {t: (r.n_quoted, r.n_found) for t, r in got.items()} == {0: (0, 0), 1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (1, 0)}
    assert [p.turn for p in got[3].path] == [0, 1, 2, 3]


def test_answers_between_quoted_lines(spark):
    rows = [
        (1, 0, "u", "one\n\ntwo"),
        (1, 1, "a", "> one\nfirst answer\n> two\nsecond answer"),
        (1, 2, "u", ">> one\n> first answer\nwhy"),
        (1, 3, "a", "> second answer\nwhat"),
    ]
    got = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].text == "first answer\n\nsecond answer"
    assert {t: r.parent.turn if r.parent else None for t, r in got.items()} == {0: None, 1: 0, 2: 1, 3: 1}
    assert {t: (r.n_quoted, r.n_found) for t, r in got.items()} == {0: (0, 0), 1: (2, 2), 2: (2, 2), 3: (1, 1)}


def test_long_texts_and_other_columns(spark):
    long = "\n\n".join(f"paragraph {i} of many" for i in range(20_000))
    rows = [(1, 0, "u", long), (1, 1, "a", "> paragraph 19999 of many\nyes"), (2, 0, "u", "\n".join("> " + x for x in long.split("\n")) + "\nno")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("hash", "level", "run", "lines", "copy", "root", "node", "parent", "thread_id", "g", "at", "best", "of_hash", "heavy_key")])
    got = {(r.conv_id, r.turn): r for r in link_quotes(clash).collect()}
    assert tuple(got[1, 1].parent) == (1, 0) and tuple(got[2, 0].parent) == (1, 0) and got[1, 0].text == long and got[2, 0].text == "no"


def test_a_passage_that_most_messages_quote(spark):
    rows = [(c, t, "u", "> the very common words\nme too" if t else "the very common words") for c in range(40) for t in range(8)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 320 and all((r.turn == 0) == (r.parent is None) for r in got) and all(r.parent.turn == 0 and r.parent.conv_id == r.conv_id for r in got if r.turn)


def test_a_deep_reply_chain(spark):
    rows = [(7, 0, "u", "start 0")] + [(7, i, "u", f"> start {i - 1}\nstart {i}") for i in range(1, 40)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 39").first()
    assert len(got.path) == 40


def test_no_messages(spark):
    assert link_quotes(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# ------------------------------------------------------------------ shards


def test_append_compact_read(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    root = f"file://{tmp_path}/store"
    for i in range(5):
        shards.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == i), root, shard_rows=50)
    before = shards.entries(spark, root).count()
    version = shards.compact(spark, root, docs.schema, target_bytes=200_000)
    live = shards.entries(spark, root)
    assert version == 6 and live.count() < before and shards.versions(spark, root) == [1, 2, 3, 4, 5, 6]
    assert live.agg(F.sum("rows")).first()[0] == docs.count()
    assert shards.read(spark, root, docs.schema).exceptAll(docs).isEmpty() and docs.exceptAll(shards.read(spark, root, docs.schema)).isEmpty()
    assert shards.read(spark, root, docs.schema, version=1).count() < docs.count()
    assert shards.vacuum(spark, root, 1) > 0 and shards.read(spark, root, docs.schema).count() == docs.count()


def test_plan_keeps_like_sizes_together(spark):
    live = spark.createDataFrame([(f"s{i}", 10_000 + i, 1) for i in range(10)] + [(f"m{i}", 90_000, 1) for i in range(3)] + [("big", 10**6, 1)], shards.ENTRY)
    plan = {r.file: r for r in shards.plan_merges(live, 60_000, 4).collect()}
    assert len(plan) == 14 and plan["big"].merge is None and plan["m0"].merge is None
    assert plan["s0"].merge == plan["s5"].merge != plan["s6"].merge and plan["s6"].merge is not None


def test_of_commits_at_the_same_time_one_wins(spark, odd, tmp_path):
    import threading
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/store"
    shards.append(odd, root)
    live, gate = shards.entries(spark, root), threading.Barrier(4)
    real = shards.publish

    def held_back(*a):  # every writer has written its list before one commits
        gate.wait()
        return real(*a)

    def write(i):
        try:
            return shards.commit(spark, root, live.withColumn("rows", F.lit(100 + i).cast("long")), 1)
        except shards.Conflict:
            return None

    shards.publish = held_back
    try:
        with ThreadPoolExecutor(4) as pool:
            got = list(pool.map(write, range(4)))
    finally:
        shards.publish = real
    assert sorted(got, key=str) == [2, None, None, None]
    assert {r.rows for r in shards.entries(spark, root).collect()} == {100 + got.index(2)}
    assert len([p for p in (tmp_path / "store" / "lists").iterdir()]) == 2


def test_a_lost_race_is_a_conflict(spark, odd, tmp_path):
    root = f"file://{tmp_path}/store"
    shards.append(odd, root)
    with pytest.raises(shards.Conflict):
        shards.commit(spark, root, shards.entries(spark, root), 0)
    assert shards.read(spark, root, odd.schema).count() == len(odd_rows())


def test_odd_tables(spark, clashing, empty, tmp_path):
    root = f"file://{tmp_path}/store"
    assert shards.read(spark, root, empty.schema).count() == 0
    shards.append(empty, root)
    for _ in range(2):
        shards.append(clashing, root, shard_rows=2)
    shards.compact(spark, root, clashing.schema, target_bytes=50_000, fan_in=2)
    got = shards.read(spark, root, clashing.schema)
    assert got.count() == 2 * len(odd_rows()) and got.columns == clashing.columns


def test_originals_in_later_conversations_and_rings(spark):
    rows = [
        (1, 0, "u", "> from a later one\nmine"),
        (5, 0, "u", "from a later one"),
        (2, 0, "u", "> pong\nping"),
        (3, 0, "u", "> ping\npong"),
        (4, 0, "u", "> pong\nwatching"),
        (6, 0, "u", "> shared\nsix"),
        (6, 1, "u", "shared"),
        (7, 0, "u", "shared"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    parent = {k[0]: tuple(r.parent) if r.parent else None for k, r in got.items() if k[1] == 0}
    assert parent == {1: (5, 0), 2: None, 3: (2, 0), 4: (3, 0), 5: None, 6: (7, 0), 7: None}  # a turn behind the quotation isn't its original
    assert {k[0]: r.thread_id for k, r in got.items()} == {1: 1, 5: 1, 2: 2, 3: 2, 4: 2, 6: 6, 7: 6}
    assert [tuple(p) for p in got[4, 0].path] == [(2, 0), (3, 0), (4, 0)] and got[2, 0].n_found == 1


@pytest.mark.parametrize("seed", [9, 10])
def test_quotations_against_sql(spark, tmp_path, seed):
    """Random threads with nested, partial and foreign quotations of any conversation, announced at any level, in Spark and in DuckDB."""
    import random

    import duckdb

    from tablesync.llm import quotes

    rng = random.Random(seed)
    places = [(conv, turn) for conv in range(12) for turn in range(rng.randint(1, 7))]
    said = {p: "\n\n".join(" ".join(rng.choice(["red", "Green", "blue", "sky", "sea"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for p in places}
    rows = []
    for (conv, turn), own in said.items():
        text = own
        if rng.random() < 0.7:
            old = said[rng.choice(places)]
            part = rng.choice([old, old.split("\n\n")[0], "nobody said this", ""])
            n = rng.randint(1, 3)
            quoted = ["> " * n + x for x in part.upper().split("\n")]
            if rng.random() < 0.4:  # an announcing line and a deeper quotation behind
                quoted += ["> " * n + "Bob wrote:", *[">" * (n + 1) + " " + x for x in said[rng.choice(places)].split("\n")]]
            text = rng.choice(["Ann wrote:\n", "", "so:\n"]) + "\n".join(quoted) + "\n" + rng.choice([own, f"{own}\n> {said[rng.choice(places)]}"])
        rows.append((conv, turn, "user", text))
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(quotes.ORACLE)
    columns = sorted(rel.columns)
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=repr)
    got = quotes.op3_quotation_linking(spark, str(tmp_path))
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want
    conv, parent, found = (columns.index(c) for c in ("conv_id", "parent_conv", "n_found"))
    assert sum(r[found] for r in want) > 10 and any(r[parent] is not None and r[parent] > r[conv] for r in want)
    assert any(r[found] and r[parent] is None for r in want)  # a ring was broken
