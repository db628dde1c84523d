"""Quality and operation figures over records, entities, scores and golden rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(std: DataFrame, membership: DataFrame, scores: DataFrame, auto: float = 0.95, review: float = 0.6) -> DataFrame:
    """One row: records, entities, duplicate records and groups, largest group, pairs by band."""
    sizes = membership.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    m = sizes.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_records"), F.count_if(F.expr("n > 1")).alias("duplicate_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"))
    p = F.col("match_probability")
    b = scores.filter("is_active").agg(F.count_if(p >= auto).alias("auto_merge"), F.count_if((p >= review) & (p < auto)).alias("review"), F.count_if(p < review).alias("reject"))
    return std.agg(F.count(F.lit(1)).alias("records")).crossJoin(m).crossJoin(b)


def by_source(membership: DataFrame) -> DataFrame:
    """(source_system, records, duplicate_records, groups): of each source, records that share an entity and groups it contributes to."""
    sizes = membership.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    x = membership.join(sizes, "entity_id")
    return x.groupBy("source_system").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.expr("n > 1")).alias("duplicate_records"), F.countDistinct(F.when(F.col("n") > 1, F.col("entity_id"))).alias("groups"))


def record_quality(std: DataFrame, completeness: Mapping[str, float], now: Column, fresh_days: int = 0, stale_days: int = 365, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(record_key, completeness, validity, freshness, score). Completeness is the weighted share of filled
    columns; validity the share of flagged values that passed, null without any; freshness falls from 1 at
    ``fresh_days`` to 0 at ``stale_days``, null without a source's time. The score is the weighted mean, in
    per cent, of those that apply."""
    total = sum(completeness.values())
    if total <= 0:
        raise ValueError("the weights of completeness must add up to more than nothing")
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    one = lambda c, w: F.when(c, F.lit(float(w))).otherwise(0.0)
    filled = add(one(F.col(c).isNotNull() & (F.length(F.trim(F.col(c).cast("string"))) > 0), w) for c, w in completeness.items()) / total
    flags = [("email", "email_valid"), ("phone_e164", "phone_valid")]
    told, passed = (add(one(F.col(v).isNotNull() & x, 1) for (v, _), x in zip(flags, xs)) for xs in ([F.col(f).isNotNull() for _, f in flags], [F.col(f) for _, f in flags]))
    fresh = max(fresh_days, 0)
    stale = max(stale_days, fresh + 1)
    age = F.datediff(now, F.col("updated_at_source"))
    x = std.select(
        "record_key", filled.alias("completeness"), F.when(told > 0, passed / told).alias("validity"),
        F.when(age.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(stale)) - age) / F.lit(float(max(1, stale - fresh)))))).alias("freshness"),
    )
    w = {"completeness": 0.5, "validity": 0.3, "freshness": 0.2} | dict(weights or {})
    top = add(F.coalesce(F.col(c) * float(k), F.lit(0.0)) for c, k in w.items())
    low = add(F.when(F.col(c).isNull(), 0.0).otherwise(float(k)) for c, k in w.items())
    return x.withColumn("score", 100.0 * top / low)


def distribution(quality: DataFrame) -> DataFrame:
    """One row: how many scores, their mean and ends, how many in each of three bands, and the means of what they are made of."""
    s = F.col("score")
    return quality.agg(
        F.count(F.lit(1)).alias("scored"), F.avg(s).alias("mean_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
        F.count_if(s < 50).alias("below_50"), F.count_if((s >= 50) & (s < 80)).alias("between_50_80"), F.count_if(s >= 80).alias("at_least_80"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("completeness", "validity", "freshness")),
    )


def junk_and_stale(std: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """(n, junk, stale): rows with a contact flagged invalid, and rows whose source's time, or else that of
    ingestion, is more than ``days`` before ``now``."""
    bad = lambda v, f: F.col(v).isNotNull() & ~F.col(f)
    old = F.coalesce("updated_at_source", "ingested_at") < now.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return std.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad("email", "email_valid") | bad("phone_e164", "phone_valid")).alias("junk"), F.count_if(old).alias("stale"))


def data_quality(golden: DataFrame, std: DataFrame, membership: DataFrame, attributes: Sequence[str], now: Column, days: int = 365) -> DataFrame:
    """(completeness, junk_rate, stale_rate, duplicate_rate, dq_score, c_<attribute>...): the share of filled
    attributes of golden rows, of junk, of stale rows, and of records in entities of two or more; a rate of
    nothing is 0. The score is the mean of completeness and what is not junk, stale and duplicate."""
    share = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    c = golden.agg(*(share(F.count(a).cast("double"), F.count(F.lit(1))).alias(f"c_{a}") for a in attributes))
    j = junk_and_stale(std, now, days)
    sizes = membership.groupBy("entity_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("dup"))
    x = c.crossJoin(j).crossJoin(sizes)  # one row each
    x = x.select(
        "*", (reduce(lambda a, b: a + b, (F.col(f"c_{a}") for a in attributes)) / len(attributes)).alias("completeness"),
        share(F.col("junk").cast("double"), F.col("n")).alias("junk_rate"), share(F.col("stale").cast("double"), F.col("n")).alias("stale_rate"), share(F.col("dup").cast("double"), F.col("n")).alias("duplicate_rate"),
    )
    return x.withColumn("dq_score", F.expr("(completeness + 1 - junk_rate + 1 - stale_rate + 1 - duplicate_rate) / 4")).drop("n", "junk", "stale", "dup")


def screening(records: DataFrame, scores: DataFrame, auto: float = 0.95, review: float = 0.6) -> DataFrame:
    """(matched, review, unmatched): delivered records (record_key) by their best active score."""
    s = scores.filter("is_active")
    ends = s.select(F.col("rec_a_key").alias("record_key"), "match_probability").unionByName(s.select(F.col("rec_b_key").alias("record_key"), "match_probability"))
    best = records.select("record_key").distinct().join(ends.groupBy("record_key").agg(F.max("match_probability").alias("p")), "record_key", "left")
    return best.agg(F.count_if(F.col("p") >= auto).alias("matched"), F.count_if(F.expr(f"p >= {review} AND p < {auto}")).alias("review"), F.count_if(F.expr(f"p IS NULL OR p < {review}")).alias("unmatched"))


def duplicate_groups(membership: DataFrame, least: int = 2, after: str | None = None, k: int = 50) -> DataFrame:
    """A page of entities with at least ``least`` records, by entity id, after the one named."""
    g = membership.groupBy("entity_id").agg(F.count(F.lit(1)).alias("members"), F.min("record_key").alias("first_member")).filter(F.col("members") >= least)
    return (g.filter(F.col("entity_id") > after) if after else g).orderBy("entity_id").limit(k)


def uncertain(scores: DataFrame, threshold: float, low: float, high: float, labelled: DataFrame | None = None, k: int = 50) -> DataFrame:
    """Active pairs in a band, the nearest to the threshold first, without those labelled already."""
    s = scores.filter(F.col("is_active") & F.col("match_probability").between(low, high))
    if labelled is not None:
        s = s.join(labelled.select("rec_a_key", "rec_b_key"), ["rec_a_key", "rec_b_key"], "left_anti")
    return s.withColumn("distance", F.abs(F.col("match_probability") - threshold)).orderBy("distance", "rec_a_key", "rec_b_key", "id").limit(k)


def best_scores(scores: DataFrame) -> DataFrame:
    """The best active score of each pair, ties by the smaller id."""
    a, b = F.least("rec_a_key", "rec_b_key"), F.greatest("rec_a_key", "rec_b_key")
    w = Window.partitionBy("a", "b").orderBy(F.desc("match_probability"), "id")
    return scores.filter("is_active").select(a.alias("a"), b.alias("b"), "match_probability", "id").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
