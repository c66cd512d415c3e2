"""Op 11: spelling variants of words, found by walking a relational trie level by level.

The trie is a table of edges (parent, ch, child); a node is the text that leads to it. A state (word, pos, node, edits) says that the first
pos code points of word, with edits changes, spell node. A level joins the states of one depth with the edges of that depth: without an
edit so far a state goes on, or lets another edge replace the code point, or skips it; after its edit it goes on exactly. States at the end
of their word whose node is a word as well are neighbours.

One edit leaves one half of a word as it is. So a word starts in the middle of its own path, once in the trie of all words and once in that
of the reversed words, and few edges leave a node where an edit may still come. A replacement is taken upwards in code-point order alone and
an insertion isn't taken at all, for the other word of the pair finds it; pairs are mirrored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

#: Words of more code points don't walk the trie, which has a level for each: they are compared with those that share a half (see _long_pairs).
MAX_WALK = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """text with A-Z alone lower-cased; the built-in function serves where it changes nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def count_words(docs: DataFrame, *, min_points: int = 5, min_count: int = 3, spoil: int = 97) -> DataFrame:
    """(word, n) of the runs of letters in docs (doc_id, text), A-Z lower-cased, that have min_points code points and occur min_count times.

    Where spoil divides the crc32 of <doc_id>:<run>, the run loses a code point, which the crc32 chooses as well. A null text has no runs, a
    null doc_id counts as the empty text; rows that repeat a document count again. No rows: no words.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{min_points},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % spoil == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_points).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _oriented(text: str) -> Column:
    """A word of the forward (>) or the reversed (<) trie as itself."""
    rest = F.col(text).substr(F.lit(2), F.length(text))
    return F.when(F.startswith(F.col(text), F.lit(">")), rest).otherwise(F.reverse(rest))


def _walked_pairs(words: DataFrame) -> DataFrame:
    """(a, b): words of at most MAX_WALK code points that differ by one edit, each pair once or more, in one direction or both."""
    spark = words.sparkSession
    root = scratch(spark, "trie")
    both = words.where(F.length("word") <= MAX_WALK).select(F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("w"))
    size = F.length("w") - 1
    half = F.floor(size / 2).cast("int")
    starts = both.select("w", F.when(F.startswith("w", F.lit(">")), half).otherwise(size - half).alias("start"))
    starts.write.partitionBy("start").parquet(f"{root}/starts")
    stored = spark.read.schema("w string, start int").parquet(f"{root}/starts")
    bounds = stored.agg(F.min("start"), F.max(size)).first()
    if bounds[0] is None:
        return spark.createDataFrame([], "a string, b string")
    first, depth = bounds
    steps = both.select("w", F.explode(F.sequence(F.lit(first), size - 1)).alias("depth"))
    edges = steps.select("depth", F.col("w").substr(F.lit(1), F.col("depth") + 1).alias("parent"), F.col("w").substr(F.col("depth") + 2, F.lit(1)).alias("ch")).distinct()
    edges.write.partitionBy("depth").parquet(f"{root}/edges")
    edges = spark.read.schema("parent string, ch string, depth int").parquet(f"{root}/edges")
    letter = lambda ahead: F.col("w").substr(F.col("pos") + 2 + ahead, F.lit(1))  # noqa: E731  of w, behind its > or <
    state = lambda pos, node, edits: F.struct(pos.cast("int").alias("pos"), node.alias("node"), F.lit(edits).alias("edits"))
    child, same = F.concat("node", "ch"), F.col("ch") == letter(0)
    level = "w string, pos int, node string, edits int"
    for d in range(first, depth):
        here = stored.where(F.col("start") == d).select("w", F.lit(d).alias("pos"), F.col("w").substr(1, d + 1).alias("node"), F.lit(0).alias("edits"))
        if d > first:
            here = here.unionByName(spark.read.schema(level).parquet(f"{root}/levels/level={d - 1}").where(F.col("pos") < size))
        met = here.join(edges.where(F.col("depth") == d).drop("depth"), (F.col("node") == F.col("parent")) & ((F.col("edits") == 0) | same))
        untouched = F.col("edits") == 0
        after = F.array_compact(
            F.array(
                F.when(same, F.when(untouched, state(F.col("pos") + 1, child, 0)).otherwise(state(F.col("pos") + 1, child, 1))),
                F.when(untouched & (F.col("ch") > letter(0)), state(F.col("pos") + 1, child, 1)),  # replaced
                F.when(untouched & (F.col("ch") == letter(1)), state(F.col("pos") + 2, child, 1)),  # skipped, and gone on
                F.when(untouched & same & (F.col("pos") + 1 == size), state(F.col("pos") + 1, F.col("node"), 1)),  # the last one skipped
            )
        )
        met.select("w", F.explode(after).alias("s")).select("w", "s.*").write.parquet(f"{root}/levels/level={d}")
    ends = spark.read.schema(level).parquet(*[f"{root}/levels/level={d}" for d in range(first, depth)]).where((F.col("edits") == 1) & (F.col("pos") == size))
    ends = ends.select(_oriented("w").alias("a"), _oriented("node").alias("b"))
    return ends.join(words.select(F.col("word").alias("b_word")), F.col("b") == F.col("b_word"), "left_semi")


def _long_pairs(words: DataFrame) -> DataFrame:
    """(a, b) as in _walked_pairs, where a has more than MAX_WALK code points: both share a half of a, and the edit distance decides."""
    size = F.length("word")

    def halves(of: Column) -> list[Column]:
        h = F.floor(of / 2).cast("int")
        part = lambda side, n, text: F.struct(of.alias("of"), F.lit(side).alias("side"), F.xxhash64(text).alias("key"))
        return [part("front", h, F.col("word").substr(F.lit(1), h)), part("back", of - h, F.col("word").substr(size - (of - h) + 1, of - h))]

    asked = words.where(size > MAX_WALK).select(F.col("word").alias("a"), F.explode(F.array(*halves(size))).alias("k"))
    stored = words.where(size >= MAX_WALK).select(F.col("word").alias("b"), F.explode(F.array(*halves(size), *halves(size + 1))).alias("k"))
    met = asked.select("a", "k.*").join(stored.select("b", F.col("k.of").alias("b_of"), F.col("k.side").alias("b_side"), F.col("k.key").alias("b_key")), F.expr("of = b_of and side = b_side and key = b_key"))
    return met.where((F.length("a") != F.length("b")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words (word, distinct) that one inserted, deleted or replaced code point makes equal, in both directions."""
    pairs = _walked_pairs(words).unionByName(_long_pairs(words))
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form) followed to the last, by pointer doubling. Forms must not go round."""
    state = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = state.select(F.col("word").alias("of"), F.col("root").alias("above"))
        moved = written(state.join(above, F.col("root") == F.col("of"), "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "forms")
        state = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return state


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n; word distinct and not null).

    form is the near word of largest n (ties: the smallest) if that n is ratio (at least 2) times the word's or more, else null; root follows
    forms to the last. n rises with each form, so forms never go round. No words: no rows.
    """
    words = written(words.select("word", "n"), "words")
    counts = words.select(F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    near = near_words(words).join(counts, F.col("near") == F.col("near_word"))
    best = near.groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best"))
    met = words.join(best, F.col("word") == F.col("of"), "left")
    enough = -F.col("best.minus_n") >= ratio * F.col("n")
    formed = written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus_n")).alias("form_n")), "formed")
    roots = _roots(formed.where("form is not null")).select(F.col("word").alias("of"), "root")
    out = formed.join(roots, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return variants(count_words(table(spark, sf_dir, "documents")))
