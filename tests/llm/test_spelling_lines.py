import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablesync.llm import spelling
from tablesync.llm.lines import LineRuns, dedup_lines, line_hashes
from tablesync.llm.queries import QUERIES
from tablesync.llm.spelling import count_words, near_words, variants

from .conftest import odd_rows

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def expected_variants(n: dict[str, int]):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def expected_words(rows):
    import re

    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: c for w, c in out.items() if c >= 3}


def test_near_words_of_dense_vocabularies(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(250)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa"}
    got = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_words_too_long_for_the_trie(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(spelling, "MAX_WALK", 7)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 10))) for _ in range(200)}
    got = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_variants_follow_forms_and_break_ties(spark):
    n = {"color": 40, "colour": 20, "colouur": 9, "colouurr": 4, "colof": 19, "colod": 40, "abcde": 5, "abcdf": 5, "zzzzzzzz": 3, "x" * 200: 9, "x" * 199: 3}
    got = {tuple(r) for r in variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == expected_variants(n)
    assert {r[0]: r[2] for r in got}["colouurr"] == "color" and {r[0]: r[1] for r in got}["colof"] == "colod"


def test_words_of_odd_rows(spark, odd, clashing, empty):
    want = expected_words([(r[0], r[1]) for r in odd_rows()])
    for docs in (odd, clashing):
        assert {r.word: r.n for r in count_words(docs).collect()} == want
    assert variants(count_words(empty)).collect() == []


def test_a_run_loses_its_code_point(spark):
    rows = [(i, "Ünderstood ÉTUDES Words " * 3) for i in range(400)]
    got = {r.word: r.n for r in count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected_words(rows) and len(got) > 3
    assert got["Études"] > 1000 and got["Ünderstood"] > 1000  # A-Z alone are lower-cased


def test_registered_spelling_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    n = expected_words([tuple(r) for r in rows])
    got = QUERIES["op11_spelling"](spark, SF).select("word", "form", "root", "n", "n_near", "form_n")
    got = {tuple(r) for r in got.collect()}
    assert {(r[0], r[3]) for r in got} == set(n.items())
    by_gap = defaultdict(set)  # words that agree but for one place
    for w in n:
        for i in range(len(w) + 1):
            by_gap[w[:i] + "*" + w[i + 1 :]].add(w)
            by_gap[w[:i] + "*" + w[i:]].add(w)
    near = defaultdict(set)
    for group in by_gap.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    assert {r[0]: r[4] for r in got} == {w: len(near[w]) for w in n}
    for word, form, root, count, _, form_n in got:
        best = min(near[word], key=lambda v: (-n[v], v), default=None)
        assert form == (best if best and n[best] >= 2 * count else None) and form_n == (n[form] if form else None)
        assert (root == word) == (form is None)


def expected_lines(rows, min_points=40, min_docs=5):
    def key(line):
        return line.strip(BLANK).translate(LOWER)

    holders = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_points:
                holders[k].append(doc_id)
    least = lambda x: (x is not None, x or 0)
    keeper = {k: max(v, key=least) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        out.append((doc_id, lines, [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]))
    return out


def same(got, want):
    order = lambda rows: sorted(((r[0], list(r[1]), list(r[2])) for r in rows), key=repr)
    assert order(got) == order(want)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (5, 3)])
def test_lines_that_many_documents_repeat(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"{c} a line that is repeated in documents {'É' if i % 2 else 'é'} {i}" for i, c in enumerate("AbCdEfGh")]
    vary = [lambda x: x, lambda x: f"  {x}\t", lambda x: x.upper() if x.isascii() else x.replace("line", "LINE"), lambda x: x + "\r"]
    rows = []
    for i in range(150):
        lines = [rng.choice(vary)(rng.choice(pool[: rng.choice([2, 8])])) for _ in range(rng.randint(0, 4))] + [f"a line of this document alone, number {i}", ""][: rng.randint(0, 2)]
        rng.shuffle(lines)
        rows.append((rng.choice([i, i, i, None]), "\n".join(lines)))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches=batches, fanout=fanout)
    same(got.collect(), expected_lines(rows))


def test_lines_of_odd_rows(spark, odd, clashing, empty):
    want = expected_lines([(r[0], r[1]) for r in odd_rows()], min_points=3, min_docs=2)
    for docs in (odd, clashing):
        same(dedup_lines(docs, min_points=3, min_docs=2).collect(), want)
    assert dedup_lines(empty).collect() == []


def test_a_document_of_repeated_lines_alone(spark):
    line = "this line stands in every one of the documents here"
    rows = [(i, "\n".join([line] * 3000)) for i in range(6)]
    got = {r.doc_id: (len(r.lines), len(r.kept)) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (3000, 3000 if i == 5 else 0) for i in range(6)}


def test_runs_are_merged_by_level_and_joined_without_a_shuffle(spark):
    docs = spark.createDataFrame([(100 - i, "\n".join(f"a line that is long enough to be counted here {j % 13}" for j in range(i, i + 4))) for i in range(50)], "doc_id long, text string")
    lines = line_hashes(docs).where("first").persist()
    runs = LineRuns(spark, buckets=3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for n in range(5):
        runs.add(lines.where(f"doc_id > {80 - 10 * n} and doc_id <= {100 if not n else 90 - 10 * n}").select("doc_id", "h1", "h2"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    totals = runs.totals()
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = {(r.h1, r.h2): (r.n, r.top) for r in lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).collect()}
    assert {(r.h1, r.h2): (r.n, r.keeper) for r in totals.collect()} == want
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == old
    runs.close()
    lines.unpersist()


def test_the_digest_of_the_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, lines, kept in expected_lines(rows)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op13_line_dedup"](spark, SF).collect()}
    assert got == want
