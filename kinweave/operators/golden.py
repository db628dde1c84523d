"""Survivorship, lineage, golden records, masters, overrides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rank = dict[str, int]


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


TIEBREAK = "tiebreak_deterministic"
#: Rules that make a value of all members' instead of choosing one.
MADE = ("combined_list", "sum")
_LAST = 2**31 - 1


def order_terms(rule: str, value: Column, rank: Rank, at: Column, frequency: Column, valid: Column | None = None) -> list[tuple[Column, Column]]:
    """(sort key, sort order) of each term of a rule. The rule decided between two members if a key differs."""
    name, _, arg = rule.partition(":")
    down, up = (lambda k: (k, k.desc_nulls_last())), (lambda k: (k, k.asc_nulls_last()))
    length = F.length(value.cast("string"))
    if name == "source_priority":
        return [up(reduce(lambda w, s: w.when(F.col("source_system") == s, rank[s]), rank, F.when(F.lit(False), 0)))]
    if name == "recency":
        return [down(at)]
    if name in ("frequency", "most_common"):
        return [down(frequency)]
    if name == "completeness":
        return [down(value.isNotNull().cast("int")), down(length)]
    if name == "validated":
        return [down(valid if valid is not None else F.lit(None).cast("boolean"))]
    if name in ("longest", "shortest"):
        return [down(length) if name == "longest" else up(length)]
    if name in ("numeric_max", "numeric_min"):
        return [down(_number(value)) if name == "numeric_max" else up(_number(value))]
    if name == "prioritized":
        vs = [v for v in arg.split("|") if v]
        return [up(reduce(lambda w, iv: w.when(value.cast("string") == iv[1], iv[0]), enumerate(vs), F.when(F.lit(False), 0)).otherwise(_LAST))]
    raise ValueError(f"unknown survivorship rule {rule!r}")


def decide(members: DataFrame, attribute: str, rules: Sequence[str], rank: Rank, value: Column | None = None, at: Column | None = None, valid: str | None = None) -> DataFrame:
    """(entity_id, attribute, record_key, value, rule): the member that supplies an attribute by the rules
    in order and, last, the record key; ``rule`` is the first that tells the winner from the second, the
    tiebreak if none does or there is no second. A rule that makes a value must stand alone; the smallest
    record key then stands for the members. ``at``: by default the source's time or else that of ingestion."""
    v = F.col(attribute) if value is None else value
    if made := [r for r in rules if r in MADE]:
        if len(rules) > 1 or value is not None:
            raise ValueError(f"{made[0]!r} makes a value of all members' and must be the only rule of one column")
        return (combined_list if made[0] == "combined_list" else total)(members, attribute).select("entity_id", F.lit(attribute).alias("attribute"), "record_key", "value", F.lit(made[0]).alias("rule"))
    at = F.coalesce("updated_at_source", "ingested_at") if at is None else at
    base = members.select("entity_id", "record_key", "source_system", at.alias("__at"), v.alias("__v"), *([F.col(valid).alias("__ok")] if valid else []))
    if any(r in ("frequency", "most_common") for r in rules):  # a window of its own, only where asked for
        base = base.withColumn("__f", F.count(F.lit(1)).over(Window.partitionBy("entity_id", "__v")))
    frequency = F.col("__f") if "__f" in base.columns else F.lit(0)
    terms = [order_terms(r, F.col("__v"), rank, F.col("__at"), frequency, F.col("__ok") if valid else None) for r in rules]
    keys = {f"__k{i}_{j}": t for i, ts in enumerate(terms) for j, t in enumerate(ts)}
    base = base.withColumns({n: k for n, (k, _) in keys.items()}) if keys else base
    w = Window.partitionBy("entity_id").orderBy(*(o for _, o in keys.values()), F.asc("record_key"))
    two = base.withColumn("__rn", F.row_number().over(w)).filter("__rn <= 2")
    pick = lambda n, c: F.max(F.when(F.col("__rn") == n, F.col(c)))
    out = two.groupBy("entity_id").agg(F.count(F.lit(1)).alias("__n"), *(pick(n, c).alias(f"{c}_{n}") for n in (1, 2) for c in ("record_key", "__v", *keys)))
    rule = F.when(F.col("__n") < 2, TIEBREAK)
    for i, r in enumerate(rules):
        differ = (~F.col(f"{k}_1").eqNullSafe(F.col(f"{k}_2")) for k in keys if k.startswith(f"__k{i}_"))
        rule = rule.when(reduce(lambda x, y: x | y, differ), r)
    return out.select("entity_id", F.lit(attribute).alias("attribute"), F.col("record_key_1").alias("record_key"), F.col("__v_1").cast("string").alias("value"), rule.otherwise(TIEBREAK).alias("rule"))


def combined_list(members: DataFrame, attribute: str) -> DataFrame:
    """(entity_id, record_key, value): sorted distinct filled values joined by '; '; null if there is none."""
    some = F.collect_set(F.when(F.col(attribute) != "", F.col(attribute)))
    return members.groupBy("entity_id").agg(F.min("record_key").alias("record_key"), F.when(F.size(some) > 0, F.array_join(F.array_sort(some), "; ")).alias("value"))


def total(members: DataFrame, attribute: str) -> DataFrame:
    """(entity_id, record_key, value): the sum of the numbers among the values."""
    return members.groupBy("entity_id").agg(F.min("record_key").alias("record_key"), F.sum(_number(F.col(attribute))).cast("string").alias("value"))


def lineage(members: DataFrame, chains: dict[str, Sequence[str]], rank: Rank, groups: dict[str, Sequence[str]] | None = None, valid: dict[str, str] | None = None) -> DataFrame:
    """(entity_id, attribute, record_key, value, rule) for all attributes. Attributes of a group are
    decided once on their joined value and come from one record."""
    out = [decide(members, a, rules, rank, valid=(valid or {}).get(a)) for a, rules in chains.items() if a not in (groups or {})]
    for g, cols in (groups or {}).items():
        joined = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
        out.append(decide(members, g, chains[g], rank, F.when(F.coalesce(*cols).isNotNull(), joined)))
    return reduce(DataFrame.unionByName, out)


def records(lines: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One golden row for each entity, a column for each attribute."""
    return lines.groupBy("entity_id").agg(*(F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in attributes))


def nested_metadata(members: DataFrame) -> DataFrame:
    """(entity_id, metadata): source -> record id -> metadata text as JSON, keys sorted."""
    inner = members.groupBy("entity_id", "source_system").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_record_id", F.coalesce("metadata", F.lit("{}")).alias("m"))))).alias("m"))
    return inner.groupBy("entity_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_system", F.to_json("m").alias("j")))))).alias("metadata"))


def overridden(golden: DataFrame, overrides: DataFrame, attribute: str) -> DataFrame:
    """Golden rows with the last override of an attribute (entity_id, value, created_at, id); a null value counts."""
    last = overrides.groupBy("entity_id").agg(F.max(F.struct("created_at", "id", "value")).alias("__o"))
    return golden.join(last, "entity_id", "left").withColumn(attribute, F.when(F.col("__o").isNotNull(), F.col("__o.value")).otherwise(F.col(attribute))).drop("__o")


#: Attributes that count for how complete a record is.
SURVIVABLE = ["given_name", "family_name", "email", "phone_e164", "addr_number", "addr_street", "addr_unit", "addr_city", "addr_region", "addr_postal", "birth_date"]


def masters(members: DataFrame, policy: str, rank: Rank, lines: DataFrame | None = None) -> DataFrame:
    """(entity_id, record_key): the master record of each entity by a policy, ties by record key.
    ``most_attributes`` counts the attributes a record supplies in ``lines``, the lineage; the others
    look at the members. Sources without a rank come last."""
    if policy == "most_attributes":
        if lines is None:
            raise ValueError("most_attributes needs the lineage")
        members = lines.filter("entity_id IS NOT NULL").groupBy("entity_id", "record_key").agg(F.count(F.lit(1)).alias("__won"))
        terms = [F.desc("__won")]
    elif policy == "source_priority":
        terms = [reduce(lambda w, s: w.when(F.col("source_system") == s, rank[s]), rank, F.when(F.lit(False), 0)).otherwise(_LAST).asc()]
    elif policy in ("most_recent", "oldest"):
        at = F.coalesce("updated_at_source", "ingested_at")
        terms = [at.desc_nulls_last() if policy == "most_recent" else at.asc_nulls_last()]
    elif policy == "most_complete":
        terms = [reduce(lambda a, b: a + b, (F.col(a).isNotNull().cast("int") for a in SURVIVABLE)).desc()]
    else:
        raise ValueError(f"unknown master policy {policy!r}")
    w = Window.partitionBy("entity_id").orderBy(*terms, F.asc_nulls_last("record_key"))
    return members.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("entity_id", "record_key")


def merge_plans(members: DataFrame, master: DataFrame) -> DataFrame:
    """(entity_id, master_key, record_key): each member to be merged into its entity's master."""
    m = master.select("entity_id", F.col("record_key").alias("master_key"))
    return members.select("entity_id", "record_key").join(m, "entity_id").filter("record_key <> master_key").select("entity_id", "master_key", "record_key")
