"""Backup chains: parent links, grouping, member order, restore prefixes, compatibility.

Links are followed by pointer doubling: each round joins every open link with the link of where it ends, so the rounds grow with the
logarithm of the longest chain. Manifests are small beside the data they describe; each round's state is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def is_base():
    base = F.coalesce("base_id", F.lit(""))
    return (base == "") | (base == F.col("id"))


def _parents(manifest: DataFrame) -> DataFrame:
    """(id, up, base): up is the parent's id, null for a base and where none is given."""
    return manifest.select("id", F.when(is_base(), None).otherwise(F.nullif(F.col("parent_id"), F.lit(""))).alias("up"), is_base().alias("base"))


def resolve(manifest: DataFrame) -> DataFrame:
    """(id, status, broken_at, depth) for every dump: depth is the number of links below it, down to the base or to where the chain breaks.

    status: 'ok', 'missing parent' (broken_at names it), 'no parent' (an increment without a parent id) or 'cycle'.
    """
    rows = _parents(manifest)
    ids = rows.select(F.col("id").alias("of"), F.lit(True).alias("known"))
    start = rows.join(ids, F.col("up") == F.col("of"), "left")
    status = F.when(F.col("base"), "ok").when(F.col("up").isNull(), "no parent").when(F.col("known").isNull(), "missing parent")
    state = cut(start.select("id", F.when(status.isNull(), F.col("up")).alias("up"), status.isNull().cast("long").alias("depth"), status.alias("status"), F.when(status == "missing parent", F.col("up")).alias("broken_at")))
    still = None
    while (open_ := state.where("up is not null").count()) and open_ != still:
        still = open_
        above = state.select(F.col("id").alias("of"), F.col("up").alias("n_up"), F.col("depth").alias("n_depth"), F.col("status").alias("n_status"), F.col("broken_at").alias("n_broken"))
        joined = state.join(above, F.col("up") == F.col("of"), "left")
        moved = F.col("of").isNotNull()
        pick = lambda new, old: F.when(moved, F.col(new)).otherwise(F.col(old)).alias(old)
        state = cut(joined.select("id", pick("n_up", "up"), (F.col("depth") + F.coalesce("n_depth", F.lit(0))).alias("depth"), pick("n_status", "status"), pick("n_broken", "broken_at")))
    return state.select("id", F.coalesce("status", F.lit("cycle")).alias("status"), "broken_at", F.when(F.col("status").isNotNull(), F.col("depth")).alias("depth"))


def links(manifest: DataFrame, targets: list[str] | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """(target, link_no, id): the dumps that restore each target in order, 0 for the base. Broken targets have none.

    A round doubles how far back each target sees: what it has seen so far is joined once with the links of that length. So a chain of n
    links takes log2(n) rounds, and named targets take their own chains' rows alone beside the links. resolved: resolve(manifest).
    """
    good = (resolve(manifest) if resolved is None else resolved).where("status = 'ok'").select(F.col("id").alias("target"), "depth")
    good = cut(good.where(F.col("target").isin(*targets)) if targets is not None else good)
    seen, jump, length, still = good.select("target", F.col("target").alias("id"), F.lit(0).cast("long").alias("back")), _parents(manifest).where("up is not null").select(F.col("id").alias("of"), "up"), 1, None
    jump = cut(jump)
    while (open_ := jump.count()) and open_ != still:  # links that never end are those of cycles
        still = open_
        seen = cut(seen.unionByName(seen.join(jump, F.col("id") == F.col("of")).select("target", F.col("up").alias("id"), (F.col("back") + length).alias("back"))))
        jump = cut(jump.join(jump.select(F.col("of").alias("n_of"), F.col("up").alias("n_up")), F.col("up") == F.col("n_of")).select("of", F.col("n_up").alias("up")))
        length *= 2
    return seen.join(good.withColumnRenamed("target", "g_target"), F.col("target") == F.col("g_target")).select("target", (F.col("depth") - F.col("back")).cast("int").alias("link_no"), "id")


def up_to(links: DataFrame, last: str) -> DataFrame:
    """links cut behind the dump named last; an unknown name is an error."""
    at = links.where(F.col("id") == last).select("link_no").first()
    if at is None:
        raise ValueError(f"{last} is no part of the chain")
    return links.where(F.col("link_no") <= at[0])


def up_to_each(links: DataFrame, stops: DataFrame) -> DataFrame:
    """links with each target's cut behind a dump of its own: stops (target, last). A last that is no part of its chain is an error;
    targets without a stop are left out."""
    s = stops.select(F.col("target").alias("s_target"), "last")
    ends = s.join(links.select("target", "id", F.col("link_no").alias("end")), (F.col("s_target") == F.col("target")) & (F.col("last") == F.col("id")), "left")
    told = F.concat("last", F.lit(" is no part of the chain of "), "s_target")
    ends = ends.select("s_target", F.coalesce("end", F.raise_error(told).cast("int")).alias("end"))
    return links.join(ends, F.col("target") == F.col("s_target")).where("link_no <= end").select("target", "link_no", "id")


def group(manifest: DataFrame) -> DataFrame:
    """(root, newest, members, bytes): the root is base_id or the own id, so increments whose base is gone form a chain under its name."""
    root = F.coalesce(F.nullif(F.col("base_id"), F.lit("")), F.col("id"))
    return manifest.groupBy(root.alias("root")).agg(F.max("created").alias("newest"), F.count("*").alias("members"), F.sum("size_bytes").alias("bytes"))


def with_root(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("root", F.coalesce(F.nullif(F.col("base_id"), F.lit("")), F.col("id")))


def member_order(manifest: DataFrame) -> DataFrame:
    """(root, id, member_no): order in which a chain's dumps apply, from 1, the base first even if its time says otherwise.

    A member is placed in the first pass, over members by (created, id), in which its parent stands already: pass 0 for the base, 1 behind
    it (or without a parent in the chain), and one more than the parent's when it precedes the parent. Members on or behind a cycle
    come last; none is lost.
    """
    rows = with_root(manifest).select("root", "id", "created", F.coalesce("parent_id", F.lit("")).alias("parent_id"))
    above = rows.select(F.col("root").alias("p_root"), F.col("id").alias("p_id"), F.struct("created", "id").alias("p_key"))
    joined = rows.join(above, (F.col("root") == F.col("p_root")) & (F.col("parent_id") == F.col("p_id")) & (F.col("id") != F.col("p_id")), "left")
    base = F.col("id") == F.col("root")
    first = F.col("p_id").isNull() | (F.col("p_id") == F.col("root"))
    step = (F.struct("created", "id") < F.col("p_key")).cast("int")
    state = cut(joined.select("root", "id", "created", F.when(base, 0).when(first, 1).otherwise(step).alias("pass"), F.when(~base & ~first, F.col("p_id")).alias("up")))
    still = None
    while (open_ := state.where("up is not null").count()) and open_ != still:
        still = open_
        above = state.select(F.col("root").alias("n_root"), F.col("id").alias("of"), F.col("pass").alias("n_pass"), F.col("up").alias("n_up"))
        joined = state.join(above, (F.col("root") == F.col("n_root")) & (F.col("up") == F.col("of")), "left")
        state = cut(joined.select("root", "id", "created", (F.col("pass") + F.coalesce("n_pass", F.lit(0))).alias("pass"), F.col("n_up").alias("up")))
    passes = F.when(F.col("up").isNotNull(), F.lit(2147483647)).otherwise(F.col("pass"))
    return state.withColumn("pass", passes).select("root", "id", F.row_number().over(Window.partitionBy("root").orderBy("pass", "created", "id")).alias("member_no"))


def incompatible(manifest: DataFrame) -> DataFrame:
    """(id, base_id, reason): increments whose base has another driver or profile."""
    base = manifest.select(F.col("id").alias("b_id"), F.col("driver").alias("b_driver"), F.col("profile").alias("b_profile"))
    met = manifest.where(~is_base()).join(base, F.col("base_id") == F.col("b_id"))
    reason = F.when(F.col("driver") != F.col("b_driver"), "driver").when(F.col("profile") != F.col("b_profile"), "profile")
    return met.select("id", "base_id", reason.alias("reason")).where("reason is not null")


def delete_order(members: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(root, id, delete_no): leaves first, so a chain cut short stays restorable. members: (root, id, member_no).

    failed (id): dumps whose deletion failed; what would follow them in their chain stays.
    """
    order = Window.partitionBy("root").orderBy(F.desc("member_no"))
    out = members.withColumn("delete_no", F.row_number().over(order))
    if failed is not None:
        bad = failed.select(F.col("id").alias("f_id")).distinct()
        out = out.join(bad, F.col("id") == F.col("f_id"), "left")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("broken", F.coalesce(F.sum(F.col("f_id").isNotNull().cast("int")).over(before), F.lit(0))).where("broken = 0")
    return out.select("root", "id", "delete_no")
