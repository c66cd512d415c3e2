"""Registered queries and the whole pipeline against plain Python over the same tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tablesync.llm import language, quality
from tablesync.llm.queries import QUERIES
from tablesync.llm.tokens import ChunkEncoder, vocabulary_path

from .test_simhash import by_hand as fingerprint_by_hand

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def groups_by_hand(rows):
    """doc_id -> least doc_id that fingerprints within 3 bits reach."""
    of = {r["doc_id"]: fingerprint_by_hand(r["text"]) for r in rows}
    root = {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(of)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (of[a] ^ of[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return of, {i: find(i) for i in of}


def stats_by_hand(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    lines = (text or "").split("\n")
    for line in lines:
        dup += line in seen and bool(WORDS.search(line))
        seen.add(line)
    n = len(words)
    per = lambda x: x / max(1, n)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    numbers = {
        "n_words": n, "mean_word_chars": per(sum(map(len, words))), "symbols_per_word": per(symbols), "repeat_share": per(len(repeated)), "dup_line_share": dup / max(1, len(lines)),
        "upper_share": per(sum(w.encode().isupper() and len(w.encode()) > 1 for w in words)), "exclaims_per_word": per((text or "").count("!")), "distinct_share": per(len(set(words))),
        "digits_per_word": per(sum(c in "0123456789" for c in text or "")), "stops_per_word": per(sum(c in ".?" for c in text or "")),
    }
    return n, sum(map(len, words)), symbols, dup, len(repeated), numbers


def kept_by_hand(text, rules):
    n, _, _, _, repeated, numbers = stats_by_hand(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False, True
    hold = lambda rule: all(numbers[m] <= v if op == "<=" else numbers[m] >= v for m, op, v in rule.conditions)
    return not any(map(hold, rules)), False


def test_simhash(spark, docs):
    of, group = groups_by_hand(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SF).collect()}
    assert got == {i: (f"{of[i]:016x}", group[i]) for i in of} and len(set(group.values())) < len(group)


def test_quality_rules(spark, docs):
    rules = quality.fit_rules(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d["doc_id"]: (*stats_by_hand(d["text"])[:5], *kept_by_hand(d["text"], rules)) for d in docs}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept, r.base_failed) for r in QUERIES["op9_quality_rules"](spark, SF).collect()}
    assert got == want and {k[5] for k in want.values()} == {True, False}


def test_the_whole_pipeline(spark, docs):
    """Every stage's decision redone in Python on what the stage before kept; the drawn documents' ids redone from their texts."""
    read = spark.read.parquet(f"{SF}/documents.parquet")
    score = language.Scorer(language.fit(read))
    told = [d for d in docs if (s := score(d["text"]))[0] != language.UNDETERMINED and s[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    rules = quality.fit_rules(spark.createDataFrame(told, read.schema), spark.read.parquet(f"{SF}/labels.parquet"))
    good = [d for d in told if kept_by_hand(d["text"], rules)[0]]
    group = groups_by_hand(good)[1]
    single = {d["doc_id"]: d for d in good if group[d["doc_id"]] == d["doc_id"]}
    assert len(docs) >= len(told) > len(good) > len(single) > 0

    pieces = corpus_pipeline.run(spark, SF).collect()
    encoder = ChunkEncoder.of(vocabulary_path())
    ids = {i: [*encoder.tokenizer.encode(d["text"], add_special_tokens=False).ids, 0] for i, d in single.items()}
    held, sequences = Counter(), defaultdict(list)
    for p in pieces:
        assert p.doc_id in single and p.doc_tokens == len(ids[p.doc_id])
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4")
        import zlib

        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
        held.update((p.doc_id, at) for at in range(p.start, p.start + p.length))
        sequences[p.sequence_id].append(p)
    times = {i: {held[i, at] for at in range(len(ids[i]))} for i in single}
    assert all(len(n) == 1 and max(n) <= 3 for n in times.values())  # whole, and at most three times
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    words = {i: len(WORDS.findall(d["text"])) for i, d in single.items()}
    size, taken, largest = Counter(), Counter(), Counter()
    for i, d in single.items():
        size[d["source"]] += words[i]
        taken[d["source"]] += words[i] * max(times[i])
        largest[d["source"]] = max(largest[d["source"]], words[i])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, aim, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set(order)
    while open_:  # what is above three times its size stays there, and the rest is shared again
        left = sum(size.values()) - sum(aim.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            aim |= share
            break
        aim |= {s: 3 * size[s] for s in full}
        open_ -= full
    for s in order:
        assert abs(taken[s] - aim[s]) <= largest[s] / 2 + 2, s
