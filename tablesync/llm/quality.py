"""Op 9: quality rules as a learned decision list.

Statistics of whole texts are computed in the workers. A bounded sample of labelled rows grows, by sequential covering, conjunctions of
thresholds that mark low quality: each rule is grown on two thirds of the rows that no earlier rule covers (the condition with the best
FOIL gain is added until the rule covers no good row), pruned on the other third (trailing conditions go while that raises the share
of low quality among what it covers), and kept only if it is right there. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, table, text_udf

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_lines", "n_upper_words", "n_exclaims", "n_distinct_words", "n_digits", "n_stops"]
#: Characters that count as symbols, and ASCII white space: fixed values.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one whole text; null has none of anything.

    n_repeat_words: positions of words that lie in a window of 3 words which the text holds twice or more, the first included.
    n_dup_lines: lines with a word that equal an earlier line.
    """
    if not text:
        return (0,) * len(STATS)
    words = text.encode().split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    repeats = 0
    if n >= 4:
        pair = ids[:-1] * len(seen) + ids[1:]
        if len(seen) >= 2_000_000:  # keep the codes of three words below 2^63
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        code = pair[:-1] * len(seen) + ids[2:]
        order = np.sort(code)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.isin(code, twice)
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            repeats = int(covered.sum())
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        known: set[str] = set()
        for line in lines:
            if line in known:
                dup += bool(line.strip(SPACES))
            else:
                known.add(line)
    spaces = sum(map(text.count, SPACES))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), dup, repeats, len(text), len(lines), upper, text.count("!"), len(seen), sum(map(text.count, "0123456789")), sum(map(text.count, ".?")))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, each row packed whole into a struct column row, with a struct column quality_stats."""
    from pyspark.sql.types import LongType, StructField, StructType

    def start():
        import pyarrow as pa

        names = list(STATS)

        def step(texts):
            values = np.array([text_stats(t) for t in texts], dtype=np.int64).reshape(-1, len(names))
            return pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(names))], names=names)

        return step

    stats = text_udf(StructType([StructField(s, LongType()) for s in STATS]), start)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), stats(F.col(f"`{text}`").cast("string")).alias("quality_stats"))


def measures(stat) -> dict[str, Column]:
    """The interpretable numbers that rules test, from the statistics; stat gives a statistic's column."""
    per_word = lambda s: stat(s) / F.greatest(stat("n_words"), F.lit(1))
    return {
        "n_words": stat("n_words").cast("double"),
        "mean_word_chars": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "repeat_share": per_word("n_repeat_words"),
        "dup_line_share": stat("n_dup_lines") / F.greatest(stat("n_lines"), F.lit(1)),
        "upper_share": per_word("n_upper_words"),
        "exclaims_per_word": per_word("n_exclaims"),
        "distinct_share": per_word("n_distinct_words"),
        "digits_per_word": per_word("n_digits"),
        "stops_per_word": per_word("n_stops"),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (measure, '<=' or '>=', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self, numbers: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, value in self.conditions:
            out = out & ((numbers[name] <= value) if op == "<=" else (numbers[name] >= value))
        return out

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, op, value in self.conditions:
            out &= (x[name] <= value) if op == "<=" else (x[name] >= value)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {v:.4g}" for n, o, v in self.conditions)


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_cover: int = 5, min_precision: float = 0.97, n_thresholds: int = 40, seed: int = 7) -> list[Rule]:
    """Ordered rules that mark bad rows. Nothing to learn from: no rules."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    fold = np.random.default_rng(seed).integers(0, 3, len(bad))
    while len(rules) < max_rules and (left & bad).sum() >= min_cover:
        grow, prune = left & (fold > 0), left & (fold == 0)
        rule, inside = Rule(()), grow.copy()
        while len(rule.conditions) < max_conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best, gain = None, 1e-9
            for name, v in x.items():
                for cut in np.unique(np.quantile(v[inside], np.linspace(0, 1, n_thresholds))):
                    for op in ("<=", ">="):
                        hit = inside & ((v <= cut) if op == "<=" else (v >= cut))
                        p, n = (hit & bad).sum(), (hit & ~bad).sum()
                        if p >= min_cover and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = (name, op, float(cut)), g
            if best is None:
                break
            rule = Rule((*rule.conditions, best))
            inside = grow & rule.covers(x)

        def worth(r: Rule) -> float:
            hit = prune & r.covers(x)
            return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

        while len(rule.conditions) > 1 and worth(Rule(rule.conditions[:-1])) >= worth(rule):
            rule = Rule(rule.conditions[:-1])
        hit = left & rule.covers(x)
        held = prune & rule.covers(x)
        if not rule.conditions or (hit & bad).sum() < min_cover or (hit & bad).sum() < min_precision * hit.sum() or (held & bad).sum() < min_precision * held.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 6000, **options) -> list[Rule]:
    """Rules from labels (doc_id, quality 0/1) on docs. At most max_labelled labelled documents are used, taken in hash order.

    Labels of unknown documents or null quality are left out; of several labels of a document the lowest counts, of several rows of a
    document one, chosen by a hash of its text.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = hash_sample(known.select(F.col("doc_id").alias("labelled_id"), "quality"), "labelled_id", max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select("labelled_id", "text", "quality")
    found = with_stats(rows.groupBy("labelled_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality")))
    numbers = measures(lambda s: F.col(f"quality_stats.{s}"))
    got = found.select("row.labelled_id", (F.col("row.quality") == 0).alias("bad"), *[c.alias(n) for n, c in numbers.items()]).toPandas()
    got = got.sort_values("labelled_id")  # folds fall by place: reruns learn the same
    return learn_rules({n: got[n].to_numpy(dtype=float) for n in numbers}, got["bad"].to_numpy(dtype=bool), **options)


def judge(docs: DataFrame, rules: list[Rule], *, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with a struct column quality: the statistics, base_failed, verdict and kept.

    Null text has no words and so fails the base. verdict names what decided: 'base', 'rule 1' ..., or 'keep'.
    """
    stat = lambda s: F.col(f"quality_stats.{s}")
    failed = (stat("n_words") < min_words) | (100 * stat("n_repeat_words") > max_repeat_percent * stat("n_words"))
    numbers = measures(stat)
    verdict = F.when(failed, "base")
    for i, rule in enumerate(rules, 1):
        verdict = verdict.when(rule.column(numbers), f"rule {i}")
    scored = with_stats(docs).withColumn("verdict", verdict.otherwise("keep")).withColumn("failed", failed)
    quality = F.struct(*[stat(s).alias(s) for s in STATS], F.col("failed").alias("base_failed"), "verdict", (F.col("verdict") == "keep").alias("kept"))
    return scored.select("row", quality.alias("quality"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", *[f"quality.{s}" for s in STATS[:5]], "quality.base_failed", "quality.kept", "quality.verdict")
