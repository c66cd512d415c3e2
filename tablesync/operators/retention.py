"""Retention of whole chains: keep-last, maximum age, grandfather-father-son tiers, plans and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import bucket, younger_than
from ..model import RetentionPolicy
from ..storage import cut
from .chains import member_order, with_root

FIELDS = ["keep_last", "max_age_seconds", "gfs_daily", "gfs_weekly", "gfs_monthly"]
TIERS = {"daily": "gfs_daily", "weekly": "gfs_weekly", "monthly": "gfs_monthly"}


def chains_by_profile(manifest: DataFrame) -> DataFrame:
    """Chains with the profile of their newest dump's row (ties: the smaller profile)."""
    rooted = with_root(manifest)
    return rooted.groupBy("root").agg(F.min("profile").alias("profile"), F.max("created").alias("newest"), F.count("*").alias("members"), F.sum("size_bytes").alias("bytes"))


def keep_last(chains: DataFrame, n: int) -> DataFrame:
    """The n newest chains of one pool, ties by root: a top-n, not a window over everything."""
    return chains.orderBy(F.desc("newest"), "root").limit(n)


def max_age(chains: DataFrame, now, seconds: int) -> DataFrame:
    """Chains whose newest dump is younger than the age, strictly."""
    return chains.where(younger_than(F.col("newest"), F.lit(now).cast("timestamp_ntz"), F.lit(seconds)))


def gfs(chains: DataFrame, tier: str, n: int) -> DataFrame:
    """The newest chain of each of the n latest buckets that hold any, with the bucket. Two steps: best of each bucket, then a top-n."""
    first = chains.withColumn("bucket", bucket(F.col("newest"), tier)).groupBy("bucket").agg(F.max("newest").alias("newest"))
    best = chains.withColumn("bucket", bucket(F.col("newest"), tier)).withColumnRenamed("newest", "at")
    rows = best.join(first, (best["bucket"] == first["bucket"]) & (F.col("at") == F.col("newest"))).groupBy(first["bucket"]).agg(F.min("root").alias("root"), F.max("at").alias("newest"))
    return rows.orderBy(F.desc("newest"), "root").limit(n)


def effective_policies(profiles: DataFrame, policies: DataFrame, override: dict | None = None) -> DataFrame:
    """profile and its limits. A profile's row replaces the default row (profile null or '') whole; no row: keep everything.

    override sets single fields on top. Negative values are errors. policies is configuration: a few rows.
    """
    own = policies.where("profile is not null and profile <> ''")
    default = policies.where("profile is null or profile = ''").agg(*[F.max(f).alias(f) for f in FIELDS]).first()
    p = profiles.select("profile").distinct().join(own.select(F.col("profile").alias("p_profile"), *FIELDS), F.col("profile") == F.col("p_profile"), "left")
    value = lambda f: F.when(F.col("p_profile").isNotNull(), F.col(f)).otherwise(F.lit(default[f]))
    set_ = {k: F.lit(v) for k, v in (override or {}).items() if v is not None}
    limits = [F.coalesce(set_.get(f, value(f)), F.lit(0)).cast("long") for f in FIELDS]
    checked = [F.when(x < 0, F.raise_error(F.lit(f"{f} can't be negative")).cast("long")).otherwise(x).alias(f) for f, x in zip(FIELDS, limits)]
    return p.select("profile", *checked)


def plan(chains: DataFrame, limits: DataFrame, now) -> DataFrame:
    """chains (root, profile, newest, ...) with decision 'keep' or 'prune' under each profile's limits.

    A chain is kept if any rule that is set keeps it, and if none is set. Each rule is a top-n for each profile with a constant n, the
    largest of all profiles: tasks cut their part to n rows before a profile's rows meet, so a profile with most of the chains is no burden.
    """
    limits, chains = cut(limits), cut(chains)  # one row for each profile; and the chains, which every rule reads
    most = limits.agg(*[F.max(f).alias(f) for f in FIELDS]).first()
    met = chains.join(limits.withColumnRenamed("profile", "l_profile"), F.col("profile").eqNullSafe(F.col("l_profile")), "left")
    newest = [F.desc("newest"), "root"]
    unset = reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(0)) == 0 for f in FIELDS])
    rules = [met.where(unset), met.where((F.col("max_age_seconds") > 0) & younger_than(F.col("newest"), F.lit(now).cast("timestamp_ntz"), F.col("max_age_seconds")))]

    def first_n(rows: DataFrame, field: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("profile").orderBy(*newest))
        return rows.withColumn("place", place).where(F.col("place") <= most[field]).where(F.col("place") <= F.col(field))

    if most["keep_last"]:
        rules.append(first_n(met.where("keep_last > 0"), "keep_last"))
    for tier, field in TIERS.items():
        if most[field]:
            in_bucket = F.row_number().over(Window.partitionBy("profile", "bucket").orderBy(*newest))
            firsts = met.where(F.col(field) > 0).withColumn("bucket", bucket(F.col("newest"), tier)).withColumn("turn", in_bucket).where("turn = 1")
            rules.append(first_n(firsts, field))
    kept = reduce(DataFrame.unionByName, [r.select("root") for r in rules]).distinct().select(F.col("root").alias("k_root"))
    return _decided(chains, kept)


def _decided(chains: DataFrame, kept: DataFrame) -> DataFrame:
    return chains.join(kept, F.col("root") == F.col("k_root"), "left").withColumn("decision", F.when(F.col("k_root").isNotNull(), "keep").otherwise("prune")).drop("k_root")


def plan_one_pool(chains: DataFrame, policy: RetentionPolicy, now) -> DataFrame:
    """plan with one policy over all chains, whatever their profile: top-n queries, no window over everything."""
    if policy.keeps_all:
        return chains.withColumn("decision", F.lit("keep"))
    chains = cut(chains)
    rules = [keep_last(chains, policy.keep_last).select("root")] if policy.keep_last else []
    rules += [max_age(chains, now, policy.max_age_seconds).select("root")] if policy.max_age_seconds else []
    rules += [gfs(chains, t, getattr(policy, f)).select("root") for t, f in TIERS.items() if getattr(policy, f)]
    kept = reduce(DataFrame.unionByName, rules).distinct().select(F.col("root").alias("k_root"))
    return _decided(chains, kept)


def dumps_of_plan(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per dump of each chain: root, id, size_bytes, decision, member_no."""
    order = member_order(manifest).select(F.col("root").alias("o_root"), F.col("id").alias("o_id"), "member_no")
    rows = with_root(manifest).select("root", "id", "size_bytes").join(planned.select(F.col("root").alias("p_root"), "decision"), F.col("root") == F.col("p_root"))
    return rows.join(order, (F.col("root") == F.col("o_root")) & (F.col("id") == F.col("o_id"))).select("root", "id", "size_bytes", "decision", "member_no")


def report(planned: DataFrame) -> DataFrame:
    """decision with the number of chains, dumps and bytes."""
    return planned.groupBy("decision").agg(F.count("*").alias("chains"), F.sum("members").alias("dumps"), F.sum("bytes").alias("bytes"))
