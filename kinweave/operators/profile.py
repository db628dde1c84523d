"""Column profiles: shape, top values, completeness, digests, findings.

Columns are stacked into long form first, so all columns of a table are profiled by one
aggregation over one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that fill a field without saying anything.
PLACEHOLDER_WORDS = ["n/a", "na", "null", "none", "nil", "unknown", "unspecified", "not provided", "no data", "-", "--", "?"]
#: Pairs from which on blocking matters; what a key must remove of all pairs, and may lose to nulls, to be of use.
PAIR_BUDGET, MIN_REDUCTION, MAX_LOSS = 5_000_000, 0.99, 0.5
#: A fall of a column's fill is told if it costs this share of pairs and the column was filled that far before.
MIN_PAIR_LOSS, MIN_FILL_BEFORE = 0.10, 0.20


def stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): every value of the columns as text."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")


def json_flatten(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., field, value): each field of each JSON payload in long form; rows without a payload have none."""
    return df.filter(F.col(payload).isNotNull()).select(*keep, F.explode(F.from_json(payload, "map<string,string>")).alias("field", "value"))


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: counts, lengths, extremes, how many values read as numbers, dates or flags, entropy."""
    v = stacked(df, columns)
    counted = v.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    val, n = F.col("value"), F.col("n")
    of = lambda c: F.sum(F.when(c, n).otherwise(0)).cast("long")
    length = F.length(val)
    num = val.try_cast("double")
    filled = F.sum(F.when(val.isNotNull(), n))
    return counted.groupBy("column").agg(
        F.sum("n").alias("rows"), of(val.isNull()).alias("nulls"), of(val == "").alias("empties"), F.count("value").alias("distinct"), F.countDistinct(F.trim(F.regexp_replace(F.lower(val), r"\s+", " "))).alias("distinct_normalized"), of((n == 1) & val.isNotNull()).alias("singles"), F.max(F.when(val.isNotNull(), n)).alias("mode_count"),
        F.min("value").alias("least"), F.max("value").alias("greatest"), F.min(length).alias("shortest"), F.max(length).alias("longest"), (F.sum(length * n) / filled).alias("mean_length"),
        of(val.rlike("^[+-]?[0-9]+$")).alias("integers"), of(val.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")).alias("numbers"), of(val.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("dates"), of(F.lower(val).isin("true", "false")).alias("flags"),
        of(val != F.trim(val)).alias("untrimmed"), of(F.lower(F.trim(val)).isin(PLACEHOLDER_WORDS)).alias("placeholders"), F.min(num).alias("least_number"), F.max(num).alias("greatest_number"),
        F.coalesce(F.log2(filled.cast("double")) - F.sum(F.when(val.isNotNull(), n * F.log2(n.cast("double")))) / filled, F.lit(0.0)).alias("entropy"),
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count, total): all values with the column's non-null total."""
    c = stacked(df, columns).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return c.join(c.groupBy("column").agg(F.sum("count").alias("total")), "column").select("column", "value", "count", "total")


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(column, value, count, share, rank): the k most frequent values of each column, ties by value."""
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return frequencies(df, columns).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("column", "value", "count", (F.col("count") / F.col("total")).alias("share"), "rank")


def completeness(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """(by, column, completeness): share of non-null values."""
    keys = [F.col(by).alias("source")] if by else [F.lit("*").alias("source")]
    x = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().cast("int").alias("ok")) for c in columns))).alias("x"))
    return x.groupBy("source", "x.column").agg(F.avg("x.ok").alias("completeness"))


def digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest): a digest that doesn't depend on the order of rows: their number and the sum of their hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("s")).select("rows", F.md5(F.concat_ws(":", F.col("rows").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("0")))).alias("digest"))


def findings(shapes: DataFrame) -> DataFrame:
    """(column, code): what a column's shape gives reason to look at. P001 empty, P002 less than half
    filled, P003 one value in a fifth of the filled rows, P004 placeholders, P005 a tenth of the values differ by case and
    blanks only, P006 a type in text, P007 constant, P008 almost a key."""
    filled = F.col("rows") - F.col("nulls")
    share = lambda c: F.try_divide(F.col(c), filled)
    d = F.col("distinct")
    codes = [
        ("P001", (filled == 0)), ("P002", (filled > 0) & (filled * 2 < F.col("rows"))), ("P003", share("mode_count") >= 0.2), ("P004", share("placeholders") >= 0.01),
        ("P005", F.try_divide(d - F.col("distinct_normalized"), d) >= 0.1), ("P006", F.greatest(share("numbers"), share("dates"), share("flags")) >= 0.99), ("P007", (d == 1) & (filled > 1)), ("P008", (F.try_divide(d, filled) >= 0.99) & (d < filled)),
    ]
    return shapes.select("column", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in codes)))).alias("code"))


def key_findings(ranked: DataFrame, rows: int, budget: int = PAIR_BUDGET) -> DataFrame:
    """(column, code) over candidate keys (``evaluate.rank_keys``): P009 no key is of use, P010 the most selective
    that is. Nothing is found without candidates or where the table makes few pairs."""
    total = rows * (rows - 1) / 2
    of_use = (1 - F.col("expected_pairs") / total >= MIN_REDUCTION) & (F.col("null_pair_loss") <= MAX_LOSS) if total > budget else F.lit(False)
    k = ranked.withColumn("ok", of_use).filter(F.lit(total > budget))
    none = k.agg(F.count(F.lit(1)).alias("n"), F.max("ok").alias("any")).filter("n > 0 AND NOT any").select(F.lit("").alias("column"), F.lit("P009").alias("code"))
    best = k.filter("ok").agg(F.min(F.struct("expected_pairs", "key"))["key"].alias("column")).filter("column IS NOT NULL")
    return none.unionByName(best.select("column", F.lit("P010").alias("code")))


def drift_findings(now: DataFrame, before: DataFrame) -> DataFrame:
    """(column, code) of two profiles: P011 a fall of fill that costs pairs, P012 a column that appeared or is gone."""
    fill = lambda d, n: d.select("column", F.try_divide(F.col("rows") - F.col("nulls"), F.col("rows")).alias(n))
    x = fill(now, "now").withColumn("here", F.lit(1)).join(fill(before, "was").withColumn("there", F.lit(1)), "column", "full")
    lost = (F.col("was") >= MIN_FILL_BEFORE) & (F.col("now") < F.col("was")) & (1 - F.col("now") * F.col("now") / (F.col("was") * F.col("was")) >= MIN_PAIR_LOSS)
    code = F.when(F.col("here").isNull() | F.col("there").isNull(), "P012").when(lost, "P011")
    return x.withColumn("code", code).filter("code IS NOT NULL").select("column", "code")


def candidate_columns(shapes: DataFrame, cap: int = 25) -> DataFrame:
    """Columns fit for blocking keys: half filled, more than one value, most selective first."""
    filled = F.col("rows") - F.col("nulls")
    return shapes.filter((filled * 2 >= F.col("rows")) & (F.col("distinct") > 1)).select("column", (F.col("distinct") / filled).alias("selectivity")).orderBy(F.desc("selectivity"), "column").limit(cap)
