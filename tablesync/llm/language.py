"""Op 8: language identification by words first, with back-off to shorter and shorter character n-grams.

For each language the model has log frequencies of words and of character n-grams (n = 4 to 1, words padded with spaces). A known word
scores by its log frequency in every language. For an unseen word the longest n of which an n-gram is known decides: its known n-grams of
that length score, averaged and weakened by a factor for each step down. The sums over a text give the language and, as a softmax, its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_udf, written

ORDERS = (4, 3, 2, 1)
#: Unseen words that a worker remembers before it starts anew.
MAX_UNSEEN = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: word or n-gram (n-grams carry their order as a prefix, as in "3:abc") -> row
    rows: dict[str, int]
    #: Row r has the entries from stops[r] to stops[r + 1]: a language and what its log frequency is above that of an unseen piece.
    stops: np.ndarray
    language: np.ndarray
    above: np.ndarray
    #: Log frequency of an unseen piece by order (0 for words, and n) and language.
    unseen: np.ndarray
    backoff: float

    def scores(self, row: int, order: int) -> np.ndarray:
        """Log frequency of a piece in every language."""
        out = self.unseen[order].copy()
        at = slice(self.stops[row], self.stops[row + 1])
        out[self.language[at]] += self.above[at]
        return out

    def total(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the log frequencies of words, whose rows may repeat."""
        sizes = self.stops[rows + 1] - self.stops[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.stops[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return len(rows) * self.unseen[0] + np.bincount(self.language[at], weights=self.above[at], minlength=len(self.languages))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5. A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, *, max_docs_per_language: int = 1000, max_docs: int = 200_000, max_entries: int = 1_000_000, min_word_count: int = 2, min_gram_count: int = 3, max_words: int = 60_000, max_grams: int = 60_000, smoothing: float = 0.5, backoff: float = 0.7) -> Model:
    """Learn from docs (doc_id, text, lang) that aren't held out and have a lang.

    The training rows are at most max_docs_per_language of each language, in hash order of doc_id, and fewer where that would be more than max_docs
    in all (one at least); their ids are broadcast, so that no text is shuffled. The model has one entry for each piece and language:
    the most frequent max_words words and max_grams n-grams of each language, fewer where that would be more than max_entries in all.
    Rows that repeat a doc_id and lang are sampled alike. No rows: a model without languages, which answers 'und'.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    # a hash threshold for each language leaves about 1.5 times the bound, so few rows meet in the task that ranks a language
    sizes = labelled.groupBy(F.col("lang").alias("s_lang")).agg(F.count("*").alias("docs"))
    sizes = written(sizes, "languages")
    each = max(1, min(max_docs_per_language, max_docs // max(1, sizes.count())))
    near = labelled.select("doc_id", "lang").join(sizes, F.col("lang") == F.col("s_lang"))
    near = near.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 40)) < F.lit(1.5 * each * (1 << 40)) / F.col("docs"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    train = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), F.expr("doc_id = chosen_id and lang = chosen_lang"))
    words = train.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    words = words.groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def grams(k: int) -> Column:
        last = F.length(padded) - k + 1
        spots = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        return F.when(last >= 1, F.transform(spots, lambda i: F.concat(F.lit(f"{k}:"), padded.substr(i, F.lit(k)))))

    pieces = words.select("lang", "n", F.explode(F.flatten(F.array_compact(F.array(*[grams(k) for k in ORDERS])))).alias("piece"))
    counts = pieces.groupBy("lang", "piece").agg(F.sum("n").alias("n"))

    def top(df: DataFrame, name: str, least: int, most: int) -> list:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))
        return df.where(F.col("n") >= least).withColumn("rank", rank).where(F.col("rank") <= most).select("lang", F.col(name).alias("piece"), "n").collect()

    n_languages = max(1, words.agg(F.count_distinct("lang")).first()[0])
    bound = lambda most: max(1, min(most, max_entries // (2 * n_languages)))
    found = [top(words, "word", min_word_count, bound(max_words)), top(counts, "piece", min_gram_count, bound(max_grams))]
    languages = sorted({r.lang for part in found for r in part})
    words.unpersist()
    column = {x: i for i, x in enumerate(languages)}
    rows: dict[str, int] = {}
    for part in found:
        for r in part:
            rows.setdefault(r.piece, len(rows))
    row = np.array([rows[r.piece] for part in found for r in part], dtype=np.int64)
    language = np.array([column[r.lang] for part in found for r in part], dtype=np.int64)
    n = np.array([r.n for part in found for r in part], dtype=np.float64)
    kind = np.array([int(p[0]) if p[1:2] == ":" else 0 for p in rows], dtype=np.int64) if rows else np.zeros(0, dtype=np.int64)
    unseen = np.zeros((max(ORDERS) + 1, len(languages)))
    for k in (0, *ORDERS):
        mine = kind[row] == k
        unseen[k] = np.log(smoothing) - np.log(np.bincount(language[mine], weights=n[mine], minlength=len(languages)) + smoothing * max(1, int((kind == k).sum())))
    order = np.argsort(row, kind="stable")
    stops = np.searchsorted(row[order], np.arange(len(rows) + 1))
    return Model(languages, rows, stops, language[order], np.log((n[order] + smoothing) / smoothing), unseen, backoff)


class Scorer:
    """Scores texts; remembers unseen words, up to MAX_UNSEEN (fewer with many languages), as rows of one matrix."""

    def __init__(self, model: Model):
        self.model = model
        self.unseen: dict[str, int] = {}
        self.grams: dict[str, np.ndarray | None] = {}
        self.rows = np.zeros((1024, len(model.languages)))
        self.most = min(MAX_UNSEEN, 4_000_000 // max(1, len(model.languages)))

    def _gram(self, gram: str, order: int) -> np.ndarray | None:
        """Log frequencies of an n-gram below that of its best language, remembered; None if it is unknown."""
        if len(self.grams) > self.most:
            self.grams.clear()
        row = self.model.rows.get(gram)
        if row is not None:
            score = self.model.scores(row, order)
            row = score - score.max()
        self.grams[gram] = row
        return row

    def _back_off(self, word: str) -> np.ndarray:
        padded, grams = f" {word} ", self.grams
        for step, k in enumerate(ORDERS):
            known = []
            for i in range(len(padded) - k + 1):
                gram = f"{k}:{padded[i : i + k]}"
                found = grams[gram] if gram in grams else self._gram(gram, k)
                if found is not None:
                    known.append(found)
            if known:
                return sum(known) * (self.model.backoff**step / len(known))
        return np.zeros(len(self.model.languages))

    def _place(self, word: str) -> int:
        place = self.unseen.get(word)
        if place is None:
            place = self.unseen[word] = len(self.unseen)
            if place == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[place] = self._back_off(word)
        return place

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.model.languages or not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0
        places = list(map(self.model.rows.get, words))
        total = self.model.total(np.array([p for p in places if p is not None], dtype=np.int64))
        if len(self.unseen) > self.most:
            self.unseen.clear()
        unseen = [self._place(w) for w, p in zip(words, places) if p is None]
        if unseen:
            total = total + self.rows[unseen].sum(axis=0)
        share = np.exp((total - total.max()) / np.sqrt(len(words)))
        best = int(np.argmax(total))
        return self.model.languages[best], float(share[best] / share.sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs, each row packed whole into a struct column row, with lang_pred and score. 'und' and 0 for null texts or texts without a letter.

    A row's result hangs on its text alone, so rows that repeat agree; columns may have any names. No rows: no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by max_entries
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    def start():
        import pyarrow as pa

        scorer = Scorer(shared.value)

        def step(texts):
            found = [scorer(t) for t in texts]
            return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["lang_pred", "score"])

        return step

    told = text_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]), start)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), told(F.col("text").cast("string")).alias("told"))
    return packed.select("row", "told.lang_pred", "told.score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("row.doc_id", is_held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
