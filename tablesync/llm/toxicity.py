"""Op 1: toxicity by a classifier chain.

Each category has a linear model (logistic regression) on which words and word beginnings a text holds. The categories stand in a chain: a
later model also gets the probabilities of the earlier categories. For training these come from models that have not seen the row (out of
fold), so that the later models learn from probabilities as unsure as those they will meet. Training runs on a bounded sample of labelled
rows; the features are those of the sample that tell most about a category.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, table, text_udf

#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Words that a worker remembers before it starts anew.
MAX_WORDS = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word itself and its proper beginnings, marked with *."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_LETTERS.findall((text or "").lower())) for f in word_features(w)}


@dataclass(frozen=True)
class Chain:
    categories: list[str]
    features: dict[str, int]
    #: One row a category: bias, weights of the features, weights of the earlier categories' probabilities (0 for the rest).
    weights: np.ndarray


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 300) -> np.ndarray:
    """Bias and weights by accelerated gradient descent on the mean loss plus ridge / 2 * |weights|^2. One class alone: its log odds."""
    if len(y) == 0 or y.min() == y.max():
        out = np.zeros(x.shape[1] + 1)
        out[0] = -6.0 if len(y) == 0 or y[0] == 0 else 6.0
        return out
    x1 = np.hstack([np.ones((len(x), 1)), x]).astype(np.float32)  # one kind of number throughout: mixed products would copy x at each step
    y = y.astype(np.float32)
    v = np.full(x1.shape[1], 1 / np.sqrt(x1.shape[1]), dtype=np.float32)
    for _ in range(12):  # the largest eigenvalue bounds the curvature
        v = x1.T @ (x1 @ v)
        top = np.linalg.norm(v)
        v /= top
    step = np.float32(1.0 / (0.25 * top / len(y) + ridge))
    w = look = np.zeros(x1.shape[1], dtype=np.float32)
    decay = np.full(x1.shape[1], ridge, dtype=np.float32)
    decay[0] = 0.0
    for t in range(steps):
        slope = x1.T @ (1 / (1 + np.exp(-np.clip(x1 @ look, -30, 30))) - y) / np.float32(len(y)) + decay * look
        new = look - step * slope
        look, w = new + np.float32(t / (t + 3)) * (new - w), new
    return w


def fit_chain(x: np.ndarray, labels: dict[str, np.ndarray], *, folds: int = 4, ridge: float = 5e-5, seed: int = 5) -> np.ndarray:
    """Weights of a chain over the categories in the order of labels; x is rows by features."""
    fold = np.random.default_rng(seed).integers(0, folds, len(x))
    out = np.zeros((len(labels), 1 + x.shape[1] + len(labels)))
    earlier = np.zeros((len(x), 0), dtype=x.dtype)
    for k, y in enumerate(labels.values()):
        z = np.hstack([x, earlier])
        w = fit_logistic(z, y, ridge)
        out[k, : len(w)] = w
        unseen = np.zeros(len(x))
        for f in range(folds) if k + 1 < len(labels) else ():
            part = fit_logistic(z[fold != f], y[fold != f], ridge)
            unseen[fold == f] = part[0] + z[fold == f] @ part[1:]
        earlier = np.hstack([earlier, _probability(unseen)[:, None].astype(x.dtype)])
    return out


def _probability(log_odds):
    return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], *, max_labelled: int = 8000, max_features: int = 1500, min_docs: int = 4, min_evidence: float = 25.0, **options) -> Chain:
    """A chain from labels (doc_id and a 0/1 column for each category) on docs (doc_id, text).

    The sample is at most max_labelled labelled documents in hash order; rows with a null label are left out, of several labels of a
    document the highest counts. Features are words or beginnings in min_docs documents or more, whose count in a category is so far from
    expected that (count - expected)^2 / expected is at least min_evidence; rarer ones would only add noise to long texts. The max_features
    with the most evidence stay. No labelled rows: every probability is near 0.
    """
    known = labels.where("doc_id is not null").dropna(subset=categories).groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    sample = hash_sample(known.select(F.col("doc_id").alias("labelled_id"), F.struct(*categories).alias("y")), "labelled_id", max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).groupBy("labelled_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))

    def listed(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("labelled_id"), pa.array([sorted(text_features(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string())), part.column("y")], names=["labelled_id", "features", "y"])

    schema = f"labelled_id {docs.schema['doc_id'].dataType.simpleString()}, features array<string>, y struct<{','.join(f'{c}:int' for c in categories)}>"
    held = rows.mapInArrow(listed, schema).persist()
    sums = held.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"y.{c}"), F.lit(0)).alias(c) for c in categories]).first()
    counts = held.select(F.explode("features").alias("f"), "y").groupBy("f").agg(F.count("*").alias("n"), *[F.sum(f"y.{c}").alias(c) for c in categories]).where(F.col("n") >= min_docs)

    def told(c: str):
        expected = F.col("n") * F.lit(sums[c] / max(1, sums["n"]))
        return F.abs(F.col(c) - expected) * F.abs(F.col(c) - expected) / F.greatest(expected, F.lit(1e-9))

    best = counts.withColumn("told", F.greatest(*[told(c) for c in categories], F.lit(0.0))).where(F.col("told") >= min_evidence).orderBy(F.desc("told"), "f").limit(max_features)
    features = {r.f: i for i, r in enumerate(best.select("f").collect())}
    wanted = F.array(*[F.lit(f) for f in features]) if features else F.array().cast("array<string>")
    got = held.select(F.array_intersect("features", wanted).alias("f"), "y").collect()
    held.unpersist()
    x = np.zeros((len(got), len(features)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, [features[f] for f in r.f]] = 1
    y = {c: np.array([r.y[c] for r in got], dtype=float) for c in categories}
    return Chain(list(categories), features, fit_chain(x, y, **options))


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs, each row packed whole into a struct column row, with a struct column toxicity: a probability for each category.

    Null and empty texts hold no feature and get what the biases say.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded: max_features weights a category
    from pyspark.sql.types import DoubleType, StructField, StructType

    def start():
        import pyarrow as pa

        model = shared.value
        n, k = len(model.features), len(model.categories)
        of: dict[str, tuple[int, ...]] = {}

        def step(texts):
            odds = np.zeros((len(texts), k))
            for i, text in enumerate(texts):
                words = set(_LETTERS.findall(text.lower())) if text else ()
                if len(of) > MAX_WORDS:
                    of.clear()
                held: set[int] = set()
                for w in words:
                    own = of.get(w)
                    if own is None:
                        own = of[w] = tuple(model.features[f] for f in word_features(w) if f in model.features)
                    if own:
                        held.update(own)
                odds[i] = model.weights[:, 0] + model.weights[:, 1 : n + 1][:, sorted(held)].sum(axis=1)
            found = np.zeros((len(texts), k))
            for c in range(k):
                found[:, c] = _probability(odds[:, c] + found[:, :c] @ model.weights[c, n + 1 : n + 1 + c])
            return pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(k)], names=model.categories)

        return step

    told = text_udf(StructType([StructField(c, DoubleType()) for c in chain.categories]), start)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), told(F.col("text").cast("string")).alias("toxicity"))


def op1_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.4) -> DataFrame:
    """Every document with the probabilities of the chain low_quality -> toxic, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), "toxic")
    out = predict(docs, fit(docs, labels, ["low_quality", "toxic"]))
    return out.select("row.doc_id", F.col("toxicity.low_quality").alias("p_low_quality"), F.col("toxicity.toxic").alias("score"), (F.col("toxicity.toxic") >= threshold).alias("toxic"))
