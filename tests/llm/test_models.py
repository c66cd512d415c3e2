import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesync.llm import language, quality, toxicity

from .conftest import odd_rows

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.predict(docs, language.fit(docs)).where(language.is_held_out(F.col("row.doc_id"))).select("row.lang", "lang_pred", "score").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_held_out_rule(spark):
    import zlib

    got = spark.range(50).select("id", language.is_held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_back_off_to_shorter_grams(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma alpha beta", "x") for i in range(20)] + [(i, "délta épsilon zeta délta", "y") for i in range(20, 40)], "doc_id long, text string, lang string")
    score = language.Scorer(language.fit(docs))
    assert [score(t)[0] for t in ("alphabet", "épsil", "délt", "gam", "ALPHA zeta beta")] == ["x", "y", "y", "x", "x"]
    assert score("12 34")[0] == score(None)[0] == score("")[0] == language.UNDETERMINED


def test_language_of_odd_tables(odd, clashing, empty):
    model = language.fit(odd, min_word_count=1, min_gram_count=1)
    got = language.predict(clashing, model).collect()
    assert len(got) == len(odd_rows())
    assert {r.row.doc_id: r.lang_pred for r in got}[5] == "und" and {r.row.doc_id: r.lang_pred for r in got}[6] == "und"
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}


def test_scores_against_counting_by_hand(spark):
    """The whole model recomputed from the training texts, and every text scored word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    options = {"min_word_count": 2, "min_gram_count": 3, "smoothing": 0.5, "backoff": 0.7}
    rows = docs.select("text", "lang", language.is_held_out(F.col("doc_id")).alias("held")).collect()
    find = re.compile(r"[^\W\d_]+").findall
    langs = sorted({r.lang for r in rows if r.lang and r.text and not r.held})
    words = {x: Counter() for x in langs}
    for r in rows:
        if r.lang and r.text and not r.held:
            words[r.lang].update(find(r.text.lower()))

    def log_frequencies(counts, least):
        known = {w for c in counts.values() for w, n in c.items() if n >= least}
        kept = {x: {w: n for w, n in c.items() if n >= least} for x, c in counts.items()}
        return {w: np.array([np.log((kept[x].get(w, 0) + 0.5) / (sum(kept[x].values()) + 0.5 * max(1, len(known)))) for x in langs]) for w in known}

    tables = {0: log_frequencies(words, 2)}
    for k in language.ORDERS:
        grams = {x: Counter() for x in langs}
        for x, c in words.items():
            for w, n in c.items():
                for i in range(len(w) + 3 - k):
                    grams[x][f" {w} "[i : i + k]] += n
        tables[k] = log_frequencies(grams, 3)

    def by_hand(text):
        found = find((text or "").lower())
        if not found:
            return "und", 0.0
        total = np.zeros(len(langs))
        for w in found:
            if w in tables[0]:
                total += tables[0][w]
                continue
            for step, k in enumerate(language.ORDERS):
                known = [tables[k][g] for i in range(len(w) + 3 - k) if (g := f" {w} "[i : i + k]) in tables[k]]
                if known:
                    total += np.mean([g - g.max() for g in known], axis=0) * 0.7**step
                    break
        share = np.exp((total - total.max()) / np.sqrt(len(found)))
        return langs[int(np.argmax(total))], share.max() / share.sum()

    got = language.predict(docs.select("text"), language.fit(docs, **options)).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = by_hand(r.row.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)


# ------------------------------------------------------------------ quality


def by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", [r[1] for r in odd_rows()] + ["a b c a b c", "x\nx\n \n \nx", "a a a a", "# | % a\n# | % a", "a b c d a b", "  nbsp   em"])
def test_base_statistics(text):
    assert quality.text_stats(text)[:5] == by_hand(text)


def test_learned_rules_find_the_planted_condition():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["b"] > 0.95)
    rules = quality.learn_rules(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() <= 0.05 * hit.sum()
    assert quality.learn_rules(x, np.zeros(900, dtype=bool)) == []
    assert quality.learn_rules({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_rules_keep_good_and_catch_bad(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs.select("doc_id", "text"), quality.fit_rules(docs, labels)).select("row.doc_id", "quality.*").join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.98 and np.mean([r.kept for r in bad]) < 0.3


def test_quality_of_odd_tables(odd, clashing, empty, labels):
    rules = quality.fit_rules(odd, labels)
    got = quality.judge(clashing, rules).collect()
    assert len(got) == len(odd_rows()) and all(r.quality.base_failed != r.quality.kept for r in got if not rules)
    assert quality.judge(empty, quality.fit_rules(empty, labels.limit(0))).count() == 0


def test_the_sql_condition_says_what_the_rule_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rule = quality.Rule((("mean_word_chars", ">=", 5.0), ("repeat_share", "<=", 0.1)))
    got = quality.judge(docs, [rule], min_words=0, max_repeat_percent=100).select("quality.*").collect()
    assert all(r.kept != (r.word_chars / max(1, r.n_words) >= 5 and r.n_repeat_words / max(1, r.n_words) <= 0.1) for r in got)


# ------------------------------------------------------------------ toxicity


def test_later_categories_use_earlier_ones():
    rng = np.random.default_rng(1)
    x = (rng.random((1200, 12)) < 0.3).astype(np.float32)
    first = (x[:, 0] + x[:, 1] > 0).astype(float)
    labels = {"first": first, "second": ((first > 0) & (x[:, 2] > 0)).astype(float), "third": 1 - first}
    w = toxicity.fit_chain(x, labels)
    chain = np.zeros((1200, 3))
    for c in range(3):
        chain[:, c] = toxicity._probability(w[c, 0] + x @ w[c, 1:13] + chain[:, :c] @ w[c, 13 : 13 + c])
    assert all(((chain[:, c] > 0.5) == (y > 0.5)).mean() > 0.97 for c, y in enumerate(labels.values()))
    assert (w[0, 13:] == 0).all() and w[1, 13] > 0 > w[2, 13]


def test_one_class_alone():
    assert toxicity.fit_logistic(np.zeros((3, 2)), np.zeros(3), 1e-3)[0] < -5


def test_toxic_documents_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = toxicity.predict(docs, toxicity.fit(docs, train, ["toxic"])).select("row.doc_id", "toxicity.toxic").withColumnRenamed("toxic", "p").join(test, "doc_id").collect()
    bad, good = [r.p > 0.4 for r in got if r.toxic], [r.p > 0.4 for r in got if not r.toxic]
    assert np.mean(bad) >= 0.8 and np.mean(good) <= 0.005


def test_probabilities_against_brute_force(spark):
    """Each document's features, listed one by one, through the chain's formula."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    names = ["low_quality", "toxic"]
    chain = toxicity.fit(docs, labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic"), names)
    assert len(chain.features) > 3
    for r in toxicity.predict(docs.select("text"), chain).collect():
        held, earlier = set(), []
        for w in re.split(r"[\W\d_]+", (r.row.text or "").lower()):
            held |= {w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)} & chain.features.keys()
        for c, name in enumerate(names):
            row = chain.weights[c]
            z = row[0] + sum(row[1 + chain.features[f]] for f in held) + sum(p * row[1 + len(chain.features) + i] for i, p in enumerate(earlier))
            earlier.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            assert r.toxicity[name] == pytest.approx(earlier[-1], abs=1e-9)


def test_toxicity_of_odd_tables(odd, clashing, empty, labels):
    chain = toxicity.fit(odd, labels, ["quality", "toxic"], min_docs=1)
    got = toxicity.predict(clashing, chain).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.toxicity.toxic <= 1 for r in got)
    assert toxicity.predict(empty, chain).count() == 0
    none = toxicity.fit(empty, labels.limit(0), ["toxic"])
    assert all(r.toxicity.toxic < 0.01 for r in toxicity.predict(odd, none).collect())
