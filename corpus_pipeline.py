"""The corpus pipeline: language ID, quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next stage's docs. All
but the last return the columns of documents; columns beside these, whatever their names, are handed on too. Rows that repeat a document
are rows of their own but for near-dedup, which keeps one of them. A stage without rows returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm import language, mixing, packing, quality, simhash
from tablesync.llm.common import table, written

#: A text goes if its language can't be told: no letters, or no language with half of the score.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with at least half of the score. Null texts and texts without a letter go; null lang, source and
    doc_id don't count against a document."""
    found = language.predict(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules (50 words at least, half of them at most in repeated windows) nor the learned list rejects.
    Null and empty texts fail the base."""
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where("quality.kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that fingerprints within 3 bits tie together (op 2's own measure). Texts without
    words are one group; of a group with null doc_ids alone one row stays."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix draws them, shard after shard in the mix's order. Texts without words, null ones included, hold
    nothing that could be drawn and go; a null source is a source of its own."""
    size = "mix_size"
    while size in docs.columns:
        size += "_"
    drawn = mixing.drawn_documents(mixing.mix(mixing.with_size(docs, size=size), size=size))
    return drawn.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens, in the order of the rows; a null or empty text is its end id alone."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learned models decide in the first stages: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
