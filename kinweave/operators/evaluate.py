"""Accuracy of links and cost of blocking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import linkage as L


def truth_space(labelled: DataFrame, total_labels: Column | float | None = None, missed_as_zero: bool = True, nearest: float | None = None) -> DataFrame:
    """Confusion counts and rates at each threshold on ``match_weight``: a pair is predicted to match from the
    threshold on. ``labelled``: match_weight, is_match, found_by_blocking.

    total_labels: all pairs there could be; those never made are negatives below every threshold.
    missed_as_zero: pairs that blocking didn't find lie below every threshold. nearest: step to which weights are rounded.
    """
    weight = F.col("match_weight") if nearest is None else F.round(F.col("match_weight") / nearest) * nearest
    at = F.when(F.col("found_by_blocking"), weight).otherwise(F.lit(-999.0)) if missed_as_zero else weight
    g = labelled.groupBy(at.alias("truth_threshold")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("is_match")).alias("pos"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("truth_threshold"), F.desc("truth_threshold")))
    whole = g.agg(F.sum("pos").alias("P"), F.sum("k").alias("labels"))
    x = g.crossJoin(F.broadcast(whole))  # one row
    total = F.col("labels") if total_labels is None else (total_labels if isinstance(total_labels, Column) else F.lit(float(total_labels)))
    d = lambda c: c.cast("double")
    neg = F.col("k") - F.col("pos")
    x = x.select("truth_threshold", d(total).alias("t"), d(F.col("P")).alias("P"), d(F.col("labels")).alias("labels"), d(F.sum("pos").over(down)).alias("TP"), d(F.sum("k").over(down)).alias("above"), d(F.sum(neg).over(up) - neg).alias("TN0"), d(F.sum("k").over(up) - F.col("k")).alias("below"))
    x = x.select("truth_threshold", "t", "P", (F.col("t") - F.col("P")).alias("N"), "TP", (F.col("above") - F.col("TP")).alias("FP"), (F.col("below") - F.col("TN0")).alias("FN"), (F.col("TN0") + F.col("t") - F.col("labels")).alias("TN"))
    e = F.expr
    share = lambda a, b: F.try_divide(e(a), e(b))
    odds = F.pow(F.lit(2.0), F.col("truth_threshold"))
    return x.filter("truth_threshold >= -998").select(
        "truth_threshold", (odds / (1 + odds)).alias("match_probability"), F.col("t").alias("total_clerical_labels"), F.col("P").alias("p"), F.col("N").alias("n"), F.col("TP").alias("tp"), F.col("TN").alias("tn"), F.col("FP").alias("fp"), F.col("FN").alias("fn"),
        share("P", "t").alias("p_rate"), share("N", "t").alias("n_rate"), share("TP", "P").alias("tp_rate"), share("TN", "N").alias("tn_rate"), share("FP", "N").alias("fp_rate"), share("FN", "P").alias("fn_rate"),
        F.coalesce(share("TP", "TP + FP"), F.lit(1.0)).alias("precision"), share("TP", "P").alias("recall"), share("TN", "N").alias("specificity"), F.coalesce(share("TN", "TN + FN"), F.lit(1.0)).alias("npv"), share("TP + TN", "P + N").alias("accuracy"),
        share("2 * TP", "2 * TP + FN + FP").alias("f1"), share("5 * TP", "5 * TP + 4 * FN + FP").alias("f2"), share("1.25D * TP", "1.25D * TP + 0.25D * FN + FP").alias("f0_5"), share("4 * TP * TN", "4 * TP * TN + (TP + TN) * (FP + FN)").alias("p4"),
        F.when(e("TN + FN = 0 OR TP + FP = 0 OR P = 0 OR N = 0"), 0.0).otherwise(e("(TP * TN - FP * FN) / sqrt((TP + FP) * P * N * (TN + FN))")).alias("phi"),
    )


def possible_pairs(n: DataFrame) -> Column:
    """Pairs that the rows of a table could make, as a one-row expression."""
    k = float(n.count())
    return F.lit(k * (k - 1) / 2)


def labelled_by_column(df: DataFrame, model: L.Model, label: str) -> DataFrame:
    """Scored pairs of the model's rules and of equal labels, with is_match and found_by_blocking."""
    rules = (*model.rules, L.Rule((label,)))
    scored = L.score(L.block(L.with_frequencies(df, model), L.Model(model.uid, rules, model.comparisons, model.prior)), model)
    return scored.withColumn("is_match", F.coalesce(F.col(f"{label}_l") == F.col(f"{label}_r"), F.lit(False))).withColumn("found_by_blocking", F.col("match_key") != str(len(model.rules)))


def labelled_by_table(df: DataFrame, model: L.Model, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scored labelled pairs (<uid>_l, <uid>_r, clerical_match_score), whichever way round they were given."""
    a, b = F.col(f"{model.uid}_l"), F.col(f"{model.uid}_r")
    pairs = labels.select(F.least(a, b).alias(f"{model.uid}_l"), F.greatest(a, b).alias(f"{model.uid}_r"), "clerical_match_score").distinct()
    l, r = L.sides(L.with_frequencies(df, model))
    return L.score(pairs.join(l, f"{model.uid}_l").join(r, f"{model.uid}_r"), model).withColumn("is_match", F.col("clerical_match_score") >= threshold)


def prediction_errors(labelled: DataFrame, threshold: float) -> DataFrame:
    """Pairs on the wrong side of the threshold with ``status`` FP or FN; a match blocking missed is an FN."""
    found = F.col("found_by_blocking") if "found_by_blocking" in labelled.columns else F.lit(True)
    said = (F.col("match_probability") >= threshold) & found
    status = F.when(said & ~F.col("is_match"), "FP").when(~said & F.col("is_match"), "FN")
    return labelled.withColumn("status", status).filter("status IS NOT NULL")


def unlinkables(df: DataFrame, model: L.Model) -> DataFrame:
    """(match_weight, prop, cum_prop): how records score against themselves, the weakest first."""
    d = L.with_frequencies(df, model)
    l, r = L.sides(d)
    own = L.score(l.join(r, F.col(f"{model.uid}_l") == F.col(f"{model.uid}_r")), model)
    g = own.groupBy(F.round("match_weight", 2).alias("match_weight")).agg(F.count(F.lit(1)).alias("c"))
    all_ = g.agg(F.sum("c").alias("t"))
    g = g.crossJoin(F.broadcast(all_)).withColumn("prop", F.col("c") / F.col("t"))
    return g.withColumn("cum_prop", F.sum("prop").over(Window.orderBy("match_weight").rowsBetween(Window.unboundedPreceding, 0))).select("match_weight", "prop", "cum_prop")


def closure_pairs(membership: DataFrame) -> DataFrame:
    """(a, b): pairs of records (record_key) of one entity."""
    m = membership.select("record_key", "entity_id").distinct()
    a, b = m.select(F.col("record_key").alias("a"), "entity_id"), m.select(F.col("record_key").alias("b"), "entity_id")
    return a.join(b, "entity_id").filter("a < b").select("a", "b").distinct()


def pairwise(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of pairs (a, b); nothing found is fully precise, nothing to find is found."""
    x = found.select("a", "b", F.lit(1).alias("f")).join(truth.select("a", "b", F.lit(1).alias("t")), ["a", "b"], "full")
    c = x.agg(F.count_if(F.expr("f = 1 AND t = 1")).alias("tp"), F.count_if(F.expr("f = 1 AND t IS NULL")).alias("fp"), F.count_if(F.expr("f IS NULL AND t = 1")).alias("fn"))
    c = c.withColumn("precision", F.expr("CASE WHEN tp + fp = 0 THEN 1D ELSE tp / (tp + fp) END")).withColumn("recall", F.expr("CASE WHEN tp + fn = 0 THEN 1D ELSE tp / (tp + fn) END"))
    return c.withColumn("f1", F.expr("CASE WHEN precision + recall = 0 THEN 0D ELSE 2 * precision * recall / (precision + recall) END"))


def block_counts(df: DataFrame, model: L.Model) -> DataFrame:
    """(match_key, pairs, cumulative): pairs each rule adds to the ones before it."""
    got = L.block(df, model).groupBy("match_key").agg(F.count(F.lit(1)).alias("n"))
    keys = df.sparkSession.createDataFrame([(str(i),) for i in range(len(model.rules))], "match_key string")
    out = keys.join(got, "match_key", "left").select("match_key", F.coalesce("n", F.lit(0)).alias("pairs"))
    return out.withColumn("cumulative", F.sum("pairs").over(Window.orderBy("match_key").rowsBetween(Window.unboundedPreceding, 0)))


def key_estimate(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(key, expected_pairs, largest_block, coverage, entropy, null_pair_loss) of a candidate blocking key:
    from block sizes alone, without making a pair."""
    d = df.select(*(F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)))
    ok = reduce(lambda a, b: a & b, (F.col(f"k{i}").isNotNull() for i in range(len(keys))))
    sizes = d.filter(ok).groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))
    s = sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.max("n").alias("top"), F.sum("n").alias("filled"), F.sum(F.expr("n * log2(n)")).alias("nlogn"))
    all_ = d.agg(F.count(F.lit(1)).alias("rows"))
    x = s.crossJoin(all_)
    return x.select(
        F.lit(name).alias("key"), F.coalesce("pairs", F.lit(0)).cast("long").alias("expected_pairs"), F.coalesce("top", F.lit(0)).alias("largest_block"), F.coalesce(F.try_divide("filled", "rows"), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.log2("filled") - F.col("nlogn") / F.col("filled"), F.lit(0.0)).alias("entropy"),
        F.coalesce(F.lit(1.0) - F.try_divide(F.expr("cast(filled AS double) * (filled - 1)"), F.expr("cast(rows AS double) * (rows - 1)")), F.lit(0.0)).alias("null_pair_loss"),
    )


def rank_keys(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Candidate keys with their rank by expected pairs, then name."""
    out = reduce(DataFrame.unionByName, (key_estimate(df, n, ks) for n, ks in candidates.items()))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("expected_pairs", "key")))


def largest_blocks(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k blocks with most comparisons between two tables."""
    c = lambda d, n: d.groupBy(*(F.expr(x).cast("string").alias(f"key_{i}") for i, x in enumerate(keys))).agg(F.count(F.lit(1)).alias(n))
    names = [f"key_{i}" for i in range(len(keys))]
    return c(left, "count_l").join(c(right, "count_r"), names).withColumn("comparisons", F.col("count_l") * F.col("count_r")).orderBy(F.desc("comparisons"), *names).limit(k)


def group_scores(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, record, attachment, is_master, group_score): a record's best link inside its cluster, the
    master (best attached, ties by key) and the cluster's mean. ``pairs``: a, b, p."""
    ends = pairs.select(F.col("a").alias("record"), F.col("b").alias("other"), "p").unionByName(pairs.select(F.col("b").alias("record"), F.col("a").alias("other"), "p"))
    c = clusters.select(F.col("node").alias("record"), "cluster")
    inside = ends.join(c, "record").join(clusters.select(F.col("node").alias("other"), F.col("cluster").alias("oc")), "other").filter("cluster = oc")
    best = inside.groupBy("cluster", "record").agg(F.max("p").alias("attachment"))
    top = best.groupBy("cluster").agg(F.min(F.struct(-F.col("attachment"), "record"))["record"].alias("m"), F.avg("attachment").alias("group_score"))
    return best.join(top, "cluster").select("cluster", "record", "attachment", (F.col("record") == F.col("m")).alias("is_master"), "group_score")
