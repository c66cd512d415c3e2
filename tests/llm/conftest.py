import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ["row", "fp", "size", "mix_size", "quality", "quality_stats", "verdict", "node", "root", "block", "spot", "draw", "draws", "toxicity", "score", "lang_pred", "labelled_id", "chosen_id", "shard", "ids", "file", "merge"]


def odd_rows():
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It runs.\nAgain it runs.", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog. It runs.\nAgain it runs.", "en", "a", 10),
        (2, "", "en", "a", 0),
        (3, None, "en", "b", None),
        (None, "no id at all", None, None, 12),
        (None, None, None, None, None),
        (4, long, "en", None, len(long)),
        (5, "   \n\t ", "fr", "b", 6),
        (6, "1234 5678 !!!", "fr", "b", 13),
        (7, "é ü ñ   doppelt  <|endoftext|> \U0001F600", "de", "c", 5),
        (8, "same text of two documents with a few words more", "en", "c", 5),
        (9, "same text of two documents with a few words more", "en", "d", 5),
        (-3, "negative id", "en", "d", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1), (8, 1, None), (99, 0, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
