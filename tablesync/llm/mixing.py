"""Op 5: mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame and SQL functions only.

1. Each source gets a target in words: its weight's share of all words, stopped at repeat_limit times its own size, the excess shared out
   again by weight.
2. A source's documents fall into blocks by a hash; its blocks lie in a permuted order and are drawn whole, pass after pass, until the
   target is met. The last block of the last pass is drawn in part, and of its documents one in part, so targets are met to the word.
3. The block draws of all sources are shared out among output shards by a binary tree: at each node half of the draws go left, and how many
   of each source is one draw from the multivariate hypergeometric distribution, sampled source after source by inversion.
4. A shard takes the next draws of each source's permuted order, as many as its leaf says, so the draws of shards are disjoint; within the
   shard documents are ordered by a hash.

All random numbers are hashes of seed, document and node, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, table, written


def with_size(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """docs with the number of words of a text as a long, 0 for null."""
    return docs.withColumn(size, n_words(F.col(f"`{text}`")))


def targets(sizes: DataFrame, weights: tuple[int, ...], repeat_limit: int) -> DataFrame:
    """sizes (source, source_size) with target: one row per source in and out, so one window over all of them is small.

    Sources by code point, null last, take the weights in turn. With sources sorted by limit / weight, those that stop at their limit
    come first; behind them all have the same words per weight, the level.
    """
    turn = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.lit(repeat_limit) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order, whole = Window.orderBy("ratio", F.asc_nulls_last("source")), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = weighed.withColumn("place", F.row_number().over(order)).withColumn("level", left / open_weight)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(whole)["level"]
    return leveled.withColumn("target", F.coalesce(F.least(F.col("limit").cast("double"), F.col("weight") * first), F.col("limit").cast("double"))).select("source", "source_size", "target")


def _hypergeometric(k: str, n: str, m: str, u: str) -> str:
    """SQL for one draw by inversion: good ones among m taken from n of which k are good; u is uniform in [0, 1).

    Walks from the mode up, then down, with the ratio of neighbouring probabilities. Beyond 12 standard deviations it stops (less than 1e-30).
    """
    sd = f"sqrt({m} * ({k} / {n}) * (1 - {k} / {n}) * ({n} - {m}) / greatest({n} - 1, 1))"
    low, high = f"greatest(0L, {m} - ({n} - {k}))", f"least({k}, {m})"
    mode = f"greatest({low}, least({high}, cast(floor(({m} + 1D) * ({k} + 1D) / ({n} + 2D)) as bigint)))"
    top, bottom = f"least({high}, {mode} + 10 + cast(12 * {sd} as bigint))", f"greatest({low}, {mode} - 10 - cast(12 * {sd} as bigint))"
    rise = f"(cast({k} - i as double) * ({m} - i) / ((i + 1D) * greatest({n} - {k} - {m} + i + 1, 1)))"
    fall = f"(cast(i as double) * ({n} - {k} - {m} + i) / (({k} - i + 1D) * ({m} - i + 1)))"
    up = f"aggregate(sequence({mode}, {top}), named_struct('w', 1D, 's', 0D), (a, i) -> named_struct('w', a.w * {rise}, 's', a.s + a.w)).s"
    down = f"aggregate(sequence({mode}, {bottom}), named_struct('w', 1D, 's', 0D), (a, i) -> named_struct('w', a.w * {fall}, 's', a.s + a.w * {fall})).s"
    t = f"({u} * ({up} + {down}))"
    found_up = f"aggregate(sequence({mode}, {top}), named_struct('w', 1D, 's', 0D, 'x', -1L), (a, i) -> named_struct('w', a.w * {rise}, 's', a.s + a.w, 'x', if(a.x < 0 and {t} < a.s + a.w, i, a.x))).x"
    found_down = f"aggregate(sequence({mode}, {bottom}), named_struct('w', 1D, 's', {up}, 'x', -1L), (a, i) -> named_struct('w', a.w * {fall}, 's', a.s + a.w * {fall}, 'x', if(a.x < 0 and {t} < a.s + a.w * {fall}, i - 1, a.x))).x"
    return f"if({n} = 0 or {m} = 0 or {k} = 0, 0L, coalesce(nullif({found_up}, -1L), nullif({found_down}, -1L), {mode}))"


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: one row with an array q of structs (source, n), n draws of a source. Result: (shard, source, n), for 2^levels shards."""
    uniform = f"(shiftrightunsigned(xxhash64({seed}, node, p.source), 11) / {float(1 << 53)!r}D)"
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "q")
    for _ in range(levels):
        draw = _hypergeometric("p.n", "c.n", "c.m", uniform)
        total = "aggregate(q, 0L, (s, p) -> s + p.n)"
        left = f"""aggregate(q, named_struct('n', {total}, 'm', cast(({total} + node % 2) div 2 as bigint), 'q', cast(array() as array<struct<source:string,n:bigint>>)),
            (c, p) -> transform(array({draw}), x -> named_struct('n', c.n - p.n, 'm', c.m - x, 'q', array_append(c.q, named_struct('source', p.source, 'n', x))))[0]).q"""
        halves = nodes.select("node", "q", F.expr(left).alias("l"))
        sides = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, l, (p, x) -> named_struct('source', p.source, 'n', p.n - x.n))").alias("q"))))
        nodes = halves.select(sides.alias("s")).select("s.node", "s.q")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.explode("q").alias("p")).select("shard", "p.source", "p.n")


def mix(sized: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), repeat_limit: int = 3, shards: int = 16, blocks: int = 1024, size: str = "size", seed: int = 17) -> DataFrame:
    """Every row of sized (doc_id, source, the size column and any others), packed into a struct column row, with what the mix takes of it.

    Adds source_size, target (its source's, in words) and draws, an array of (pass, shard, words): the document goes to that shard with so
    many of its first words; words is at most its size and no document is drawn more than repeat_limit times. shards is a power of two.
    Null size counts as 0. Null source is a source of its own. Rows that repeat doc_id and size are drawn alike. No rows: no rows.
    The per-source table is small: one row and one array entry per source.
    """
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("shards must be a power of two")
    words_of = F.coalesce(F.col(f"row.`{size}`").cast("long"), F.lit(0).cast("long"))
    spot = F.xxhash64(F.lit(seed), F.col("row.doc_id").cast("string"), words_of)
    packed = sized.select(F.struct(*[F.col(f"`{c}`") for c in sized.columns]).alias("row"))
    docs = written(packed.select("row", F.col("row.source").cast("string").alias("source"), words_of.alias("size"), spot.alias("spot"), F.pmod(F.xxhash64(F.lit(seed + 1), spot), F.lit(blocks)).cast("int").alias("block")), "mix-docs")
    by_block = written(docs.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    aims = targets(by_block.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, repeat_limit)
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(repeat_limit), F.floor(words / F.col("source_size")))).otherwise(0).cast("long")
    aims = aims.withColumn("passes", passes).withColumn("rest", words - F.col("passes") * F.col("source_size"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    aims = aims.withColumnRenamed("source", "aim_source")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    laid = by_block.join(aims, same("source", "aim_source")).drop("aim_source")
    laid = laid.withColumn("rank", F.row_number().over(order) - 1).withColumn("n_blocks", F.count("*").over(Window.partitionBy("source")))
    laid = laid.withColumn("before", F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    laid = laid.withColumn("last", F.col("before") < F.col("rest")).withColumn("budget", F.when(F.col("last") & (F.col("before") + F.col("block_size") > F.col("rest")), F.col("rest") - F.col("before")))
    laid = written(laid, "mix-laid")

    quota = laid.groupBy("source").agg((F.first("passes") * F.first("n_blocks") + F.count_if("last")).alias("n"))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a text for each source, the null one too, and unlike all others
    quotas = quota.agg(F.sort_array(F.collect_list(F.struct(named.alias("source"), "n"))).alias("q"))
    leaves = split_tree(quotas, levels, seed)
    ends = leaves.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("leaf"))
    ends = ends.select(F.col("source").alias("end_source"), F.expr("transform(leaf, (x, i) -> aggregate(slice(leaf, 1, i + 1), 0L, (s, y) -> s + y.n))").alias("ends"))

    # the documents of the block drawn in part: those before the cut go whole, those at the cut (equal rows) share what is left
    part = laid.where("budget is not null").select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "budget")
    rows = docs.join(part, same("source", "p_source") & (F.col("block") == F.col("p_block"))).groupBy("p_source", "p_block", "budget", "spot").agg(F.sum("size").alias("spot_size"), F.count("*").alias("n"))
    in_block = Window.partitionBy("p_source", "p_block").orderBy("spot")
    rows = rows.withColumn("ahead", F.coalesce(F.sum("spot_size").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cuts = rows.where("ahead < budget and ahead + spot_size >= budget").select("p_source", "p_block", F.col("spot").alias("cut"), ((F.col("budget") - F.col("ahead")) / F.col("n")).cast("long").alias("cut_words"))

    plan = laid.join(ends, named == F.col("end_source")).join(cuts, same("source", "p_source") & (F.col("block") == F.col("p_block")), "left")
    draws = F.expr("transform(sequence(0L, passes), p -> named_struct('pass', p, 'shard', size(filter(ends, e -> e <= p * n_blocks + rank)), 'last', p = passes))")
    drawn = F.expr("filter(draws, d -> not d.last or last)")
    plan = plan.withColumn("draws", draws).select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "source_size", "target", drawn.alias("plan_draws"), "budget", "cut", "cut_words")
    taken = "case when not d.last or budget is null or spot < cut then size when spot = cut then cut_words else 0L end"
    mine = F.expr(f"filter(transform(plan_draws, d -> named_struct('pass', d.pass, 'shard', d.shard, 'words', {taken})), d -> d.words > 0)")
    return docs.join(plan, same("source", "plan_source") & (F.col("block") == F.col("plan_block"))).select("row", "size", "source_size", "target", mine.alias("draws"))


def drawn_documents(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """One row per draw: row, the document whole, and draw: shard, pass, and order within the shard.

    A draw of some of a document's words, of which a source has one (or its equal rows), takes the document whole if that is half of it or
    more, else not at all. Rows are dealt by range of (shard, order) and sorted by it, so partitions in turn hold the shards in turn, each in
    its order. Borders of partitions may lie within a shard, so tasks aren't bound to the number of shards.
    """
    draws = mixed.select("row", "size", F.explode("draws").alias("d")).where(F.col("d.words") * 2 >= F.col("size"))
    order = F.xxhash64(F.lit(seed + 3), "row.doc_id", "row.text", "d.pass")
    dealt = draws.select("row", F.struct("d.shard", "d.pass", order.alias("order")).alias("draw"))
    return dealt.repartitionByRange("draw.shard", "draw.order").sortWithinPartitions("draw.shard", "draw.order")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; shards: where its draws go, pass after pass."""
    sized = with_size(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    mixed = mix(sized)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return mixed.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("shards"))
