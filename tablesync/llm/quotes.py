"""Op 3: quotation linking for chat and mail threads, with DataFrame and SQL functions only.

A line's quote level is the number of > before it. Lines that announce a deeper quotation belong to no text. The others of level 0 are the
message's own text, with a blank line where a quotation stood. Runs of lines of one deeper level are quoted passages. A passage, and each of its paragraphs, is normalised (case and white space) and
hashed, and meets the messages whose own text, or a paragraph of it, has that hash. The links make reply trees, whose paths order each
conversation with replies behind what they answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_classes, table, written
from .graph import components

_PREFIX = r"^((?:[ \t]*>)+)"
#: Ends of a line that announces a quotation: fixed values.
ANNOUNCES = r"(?i)\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"


def _lines(text: Column) -> Column:
    """Array of (level, body) of the lines of a text."""
    def line(raw: Column) -> Column:
        level = F.regexp_count(F.regexp_extract(raw, _PREFIX, 1), F.lit(">"))
        return F.struct(level.alias("level"), F.regexp_replace(raw, _PREFIX + r"[ \t]?", "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)


def _announces(lines: Column, x: Column, i: Column) -> Column:
    """Whether x, the line at i, announces the deeper quotation on the next line."""
    deeper_next = F.coalesce(F.get(lines, i + 1)["level"] > x["level"], F.lit(False))
    return F.coalesce(F.rlike(x["body"], F.lit(ANNOUNCES)), F.lit(False)) & deeper_next


def own_text(lines: Column) -> Column:
    """The lines of level 0 that announce no quotation, a blank line for each quotation, and no blank lines at both ends.

    So what stands before and behind an inline quotation are paragraphs of their own, as those who quote one of them see it.
    """
    def own(x: Column, i: Column) -> Column:
        first_quoted = (x["level"] > 0) & F.coalesce(F.get(lines, i - 1)["level"] == 0, F.lit(True))
        return F.when((x["level"] == 0) & ~_announces(lines, x, i), x["body"]).when(first_quoted, "")

    joined = F.array_join(F.transform(lines, own), "\n")  # drops nulls
    return F.regexp_replace(joined, r"^\s*\n|\s+$", "")


def passage_hashes(text: Column) -> Column:
    """Distinct MD5 hashes of a normalised text and of its paragraphs; empty ones have none."""
    plain = lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    all_ = F.transform(F.array_append(F.split(text, r"\n[ \t]*\n"), text), plain)
    return F.array_distinct(F.transform(F.filter(all_, lambda t: t != ""), F.md5))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row for each row of messages (conv_id, turn, role, text; others are left out).

    text: the message without quotations. thread_id: the least conv_id among conversations that quotations tie together. parent: (conv_id,
    turn) of the message it answers, by its least deep quotation that is found: in its own conversation the first earlier turn with the
    passage (the latest such, if several passages are found), otherwise the first message with it in another conversation, one of smaller
    conv_id before one of larger. Where answers go round in a ring, the message of least (conv_id, turn) on it answers none.
    path: (conv_id, turn) from the root down to the message; sorting a thread by path puts replies behind what they answer. n_quoted,
    n_found: passages in the message and how many of them were found.

    A path holds a step for each message above, so a thread of n replies to replies has n^2 / 2 steps in its paths.
    A message without a found quotation is a root. Null text is empty. Messages with a null conv_id or turn link to nothing. Rows that
    repeat (conv_id, turn) share a parent. No rows: no rows.
    """
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("raw"))
    held = written(base.withColumn("lines", _lines(F.col("raw"))).select("conv_id", "turn", "role", own_text(F.col("lines")).alias("text"), F.when(F.exists("lines", lambda x: x["level"] > 0), F.col("lines")).alias("lines")), "messages")

    # passages: runs of lines of one level; a window holds the lines of one message
    quoting = held.where("lines is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.xxhash64("lines").alias("copy"), "lines").distinct()
    told = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), _announces(F.col("lines"), x, i).alias("announces")))
    lines = quoting.select("conv_id", "turn", "copy", F.posexplode(told).alias("pos", "line")).where("not line.announces").select("conv_id", "turn", "copy", "pos", "line.level", "line.body")
    message = ["conv_id", "turn", "copy"]
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*message, "level").orderBy("pos"))
    runs = lines.withColumn("run", run).where("level > 0").groupBy(*message, "level", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n").alias("passage"))
    passages = runs.where(F.trim("passage") != "")
    asked = written(passages.select(*message, "level", "run", F.explode(passage_hashes(F.col("passage"))).alias("hash")), "passages")

    # originals of the passages that are quoted at all: the first turn in each conversation, and the first conversation
    wanted = asked.select(F.col("hash").alias("wanted")).distinct()
    texts = held.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(passage_hashes(F.col("text"))).alias("hash"))
    first = texts.join(wanted, F.col("hash") == F.col("wanted"), "left_semi").groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    first = written(first, "originals")
    inside = first.select(F.col("hash").alias("i_hash"), F.col("conv_id").alias("i_conv"), F.col("turn").alias("i_turn"))
    # the first two conversations with it: one of them isn't the one that asks. Partial top-n keeps a common passage's messages apart
    two = first.withColumn("r", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("r <= 2")
    anywhere = two.groupBy(F.col("hash").alias("g_hash")).agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn"))).alias("g"))
    met = asked.join(inside, (F.col("hash") == F.col("i_hash")) & (F.col("conv_id") == F.col("i_conv")) & (F.col("i_turn") < F.col("turn")), "left")
    times = asked.groupBy(F.col("hash").alias("n_hash")).agg(F.count("*").alias("n_asked"))
    anywhere = anywhere.join(times, F.col("g_hash") == F.col("n_hash")).select(F.col("g_hash").alias("of_hash"), "g", "n_asked")
    met = join_classes(met, anywhere, "hash", "n_asked", asked.count(), "left").withColumn("g", F.get(F.filter("g", lambda x: x["conv_id"] != F.col("conv_id")), F.lit(0)))
    found = met.withColumn("at", F.when(F.col("i_turn").isNotNull(), F.struct(F.col("conv_id"), F.col("i_turn").alias("turn"))).otherwise(F.col("g")))
    elsewhere = F.when(F.col("i_turn").isNotNull(), 0).when(F.col("at.conv_id") < F.col("conv_id"), 1).otherwise(2)
    rank = F.when(F.col("at").isNotNull(), F.struct("level", elsewhere.alias("elsewhere"), (-F.col("at.turn")).alias("back"), F.col("at.conv_id").alias("p_conv"), F.col("at.turn").alias("p_turn")))
    per_run = found.groupBy("conv_id", "turn", "copy", "level", "run").agg(F.min(rank).alias("best"))
    links = per_run.groupBy("conv_id", "turn").agg(F.min("best").alias("best"), F.count("*").alias("n_quoted"), F.count("best").alias("n_found"))
    links = written(links.select("conv_id", "turn", F.col("best.p_conv").alias("p_conv"), F.col("best.p_turn").alias("p_turn"), "n_quoted", "n_found"), "links")

    if not links.where("p_conv > conv_id").isEmpty():  # others go back in time or to smaller conversations, never round
        heads = _ring_heads(links.where("p_conv is not null"))
        headed = links.join(heads, (F.col("conv_id") == F.col("h_conv")) & (F.col("turn") == F.col("h_turn")), "left")
        stays = lambda c: F.when(F.col("h_conv").isNull(), F.col(c)).alias(c)
        links = written(headed.select("conv_id", "turn", stays("p_conv"), stays("p_turn"), "n_quoted", "n_found"), "links")
    answers = links.where("p_conv is not null")
    tied = components(answers.where("p_conv <> conv_id").select(F.least("p_conv", "conv_id").alias("a"), F.greatest("p_conv", "conv_id").alias("b")).distinct())
    paths = _paths(answers)
    tied = tied.withColumnRenamed("node", "t_conv")
    links = links.join(paths, (F.col("conv_id") == F.col("m_conv")) & (F.col("turn") == F.col("m_turn")), "left").select(F.col("conv_id").alias("l_conv"), F.col("turn").alias("l_turn"), "p_conv", "p_turn", "n_quoted", "n_found", "path")
    out = held.join(links, (F.col("conv_id") == F.col("l_conv")) & (F.col("turn") == F.col("l_turn")), "left").join(tied, F.col("conv_id") == F.col("t_conv"), "left")
    zero = F.lit(0).cast("long")
    path = F.coalesce("path", F.array(F.struct("conv_id", "turn")))
    return out.select("conv_id", "turn", "role", "text", F.coalesce("root", "conv_id").alias("thread_id"), F.when(F.col("p_conv").isNotNull(), F.struct(F.col("p_conv").alias("conv_id"), F.col("p_turn").alias("turn"))).alias("parent"), path.alias("path"), F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_found", zero).alias("n_found"))


def _ring_heads(answers: DataFrame) -> DataFrame:
    """(h_conv, h_turn): of each ring of answers the message of least (conv_id, turn).

    Pointer doubling: a round joins where each message has got with where that one has got. Messages that reach a root drop out; once a round
    drops none, only rings and what leads into them are left, and as many steps as there are of these go all round.
    """
    low = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    state = written(answers.select("conv_id", "turn", "p_conv", "p_turn", low.alias("low")), "rings")
    n, before, steps = state.count(), None, 1
    while n and (n != before or steps < n):
        above = state.select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("p_conv").alias("n_conv"), F.col("p_turn").alias("n_turn"), F.col("low").alias("a_low"))
        met = state.join(above, (F.col("p_conv") == F.col("a_conv")) & (F.col("p_turn") == F.col("a_turn")))
        state = written(met.select("conv_id", "turn", F.col("n_conv").alias("p_conv"), F.col("n_turn").alias("p_turn"), F.least("low", "a_low").alias("low")), "rings")
        n, before, steps = state.count(), n, steps * 2
    around = state.select(F.col("p_conv").alias("r_conv"), F.col("p_turn").alias("r_turn")).distinct()
    return state.where((F.col("low.c") == F.col("conv_id")) & (F.col("low.t") == F.col("turn"))).join(around, (F.col("conv_id") == F.col("r_conv")) & (F.col("turn") == F.col("r_turn")), "left_semi").select(F.col("conv_id").alias("h_conv"), F.col("turn").alias("h_turn"))


def _paths(answers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(m_conv, m_turn, path) of messages with a parent, by pointer doubling: rounds grow with the logarithm of the depth."""
    me, up = F.struct("conv_id", "turn"), F.struct(F.col("p_conv").alias("conv_id"), F.col("p_turn").alias("turn"))
    state = written(answers.select(F.col("conv_id").alias("m_conv"), F.col("turn").alias("m_turn"), F.array(me).alias("path"), up.alias("up")), "paths")
    for _ in range(max_rounds):
        if state.where("up is not null").isEmpty():
            return state.drop("up")
        above = state.select(F.struct(F.col("m_conv").alias("conv_id"), F.col("m_turn").alias("turn")).alias("of"), F.col("path").alias("head"), F.col("up").alias("next"))
        joined = state.join(above, F.col("up") == F.col("of"), "left")
        path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.coalesce("head", F.array("up")), "path"))
        state = written(joined.select("m_conv", "m_turn", path.alias("path"), F.col("next").alias("up")), "paths")
    raise RuntimeError("reply paths did not end")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations without quotations, with its thread and place."""
    out = link_quotes(table(spark, sf_dir, "conversations"))
    step = lambda p: F.concat_ws(":", p["conv_id"].cast("string"), p["turn"].cast("string"))
    return out.select("conv_id", "turn", "role", "text", "thread_id", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), (F.size("path") - 1).cast("long").alias("depth"), F.array_join(F.transform("path", step), "/").alias("reply_path"), "n_quoted", "n_found")


_NORMAL = r"lower(trim(regexp_replace(x, '\s+', ' ', 'g')))"

#: The same rows in DuckDB's SQL, where (conv_id, turn) is unique: normalised texts stand for their hashes, recursion for the doubling.
ORACLE = rf"""WITH RECURSIVE split AS (SELECT conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS a FROM conversations),
  raw AS (SELECT conv_id, turn, role, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM split),
  lines AS (SELECT conv_id, turn, role, pos, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body FROM raw),
  near AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY pos), 0) AS next_level, coalesce(lag(level) OVER (PARTITION BY conv_id, turn ORDER BY pos), 0) AS last_level FROM lines),
  ahead AS (SELECT *, next_level > level AND regexp_matches(body, '{ANNOUNCES}') AS announces FROM near),
  own AS (SELECT conv_id, turn, role, regexp_replace(coalesce(string_agg(CASE WHEN level = 0 AND NOT announces THEN body WHEN level > 0 AND last_level = 0 THEN '' END,
    chr(10) ORDER BY pos), ''), '^\s*\n|\s+$', '', 'g') AS text FROM ahead GROUP BY conv_id, turn, role),
  runs AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run FROM ahead WHERE level > 0 AND NOT announces),
  passages AS (SELECT conv_id, turn, level, run, string_agg(body, chr(10) ORDER BY pos) AS p FROM runs GROUP BY conv_id, turn, level, run),
  pieces AS (SELECT conv_id, turn, level, run, unnest(list_append(string_split_regex(p, '\n[ \t]*\n'), p)) AS x FROM passages),
  asked AS (SELECT DISTINCT conv_id, turn, level, run, {_NORMAL} AS h FROM pieces WHERE {_NORMAL} <> ''),
  own_pieces AS (SELECT conv_id, turn, unnest(list_append(string_split_regex(text, '\n[ \t]*\n'), text)) AS x FROM own),
  originals AS (SELECT {_NORMAL} AS h, conv_id, min(turn) AS turn FROM own_pieces WHERE {_NORMAL} <> '' GROUP BY 1, 2),
  two AS (SELECT h, conv_id AS g_conv, turn AS g_turn FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY conv_id) AS r FROM originals) WHERE r <= 2),
  met AS (SELECT a.*, i.turn AS i_turn, g.g_conv, g.g_turn, row_number() OVER (PARTITION BY a.conv_id, a.turn, a.level, a.run, a.h ORDER BY g.g_conv) AS nth FROM asked a
    LEFT JOIN originals i ON a.h = i.h AND a.conv_id = i.conv_id AND i.turn < a.turn LEFT JOIN two g ON a.h = g.h AND g.g_conv <> a.conv_id),
  found AS (SELECT conv_id, turn, level, run, CASE WHEN i_turn IS NOT NULL THEN 0 WHEN g_conv < conv_id THEN 1 ELSE 2 END AS elsewhere,
    CASE WHEN i_turn IS NULL THEN g_conv ELSE conv_id END AS p_conv, CASE WHEN i_turn IS NULL THEN g_turn ELSE i_turn END AS p_turn FROM met WHERE nth = 1),
  counts AS (SELECT conv_id, turn, count(DISTINCT level * 100000 + run) AS n_quoted, count(DISTINCT CASE WHEN p_conv IS NOT NULL THEN level * 100000 + run END) AS n_found FROM found GROUP BY conv_id, turn),
  answers AS (SELECT conv_id, turn, p_conv, p_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, elsewhere, p_turn DESC, p_conv) AS r FROM found WHERE p_conv IS NOT NULL) WHERE r = 1),
  above AS (SELECT conv_id, turn, p_conv, p_turn FROM answers UNION SELECT b.conv_id, b.turn, a.p_conv, a.p_turn FROM above b JOIN answers a ON b.p_conv = a.conv_id AND b.p_turn = a.turn),
  rings AS (SELECT conv_id, turn FROM above WHERE conv_id = p_conv AND turn = p_turn),
  heads AS (SELECT conv_id, turn FROM above JOIN rings USING (conv_id, turn) GROUP BY conv_id, turn HAVING row(conv_id, turn) = min(row(p_conv, p_turn))),
  parents AS (SELECT * FROM answers ANTI JOIN heads USING (conv_id, turn)),
  ties AS (SELECT DISTINCT p_conv AS a, conv_id AS b FROM parents WHERE p_conv <> conv_id UNION SELECT DISTINCT conv_id, p_conv FROM parents WHERE p_conv <> conv_id),
  reach AS (SELECT a, b FROM ties UNION SELECT r.a, t.b FROM reach r JOIN ties t ON r.b = t.a),
  threads AS (SELECT a, least(a, min(b)) AS thread_id FROM reach GROUP BY a),
  paths AS (SELECT o.conv_id, o.turn, o.conv_id || ':' || o.turn AS reply_path, 0 AS depth FROM own o LEFT JOIN parents p ON o.conv_id = p.conv_id AND o.turn = p.turn WHERE p.p_conv IS NULL
    UNION ALL SELECT c.conv_id, c.turn, p.reply_path || '/' || c.conv_id || ':' || c.turn, p.depth + 1 FROM parents c JOIN paths p ON c.p_conv = p.conv_id AND c.p_turn = p.turn)
SELECT CAST(o.conv_id AS BIGINT) AS conv_id, CAST(o.turn AS BIGINT) AS turn, o.role, o.text, CAST(coalesce(t.thread_id, o.conv_id) AS BIGINT) AS thread_id, CAST(p.p_conv AS BIGINT) AS parent_conv,
  CAST(p.p_turn AS BIGINT) AS parent_turn, CAST(w.depth AS BIGINT) AS depth, w.reply_path, coalesce(c.n_quoted, 0) AS n_quoted, coalesce(c.n_found, 0) AS n_found
FROM own o LEFT JOIN parents p ON o.conv_id = p.conv_id AND o.turn = p.turn LEFT JOIN threads t ON o.conv_id = t.a LEFT JOIN paths w ON o.conv_id = w.conv_id AND o.turn = w.turn
LEFT JOIN counts c ON o.conv_id = c.conv_id AND o.turn = c.turn"""
