"""Best representative of each duplicate group (problem 6), with a latent model of the sources.

Each live record of an entity makes claims, one for each attribute with a usable value. A latent
two-sided model holds, for each attribute, how often a source states a value that is true
(sensitivity) and keeps from stating one that isn't (specificity); both and the chance that a
stated value is true are inferred by expectation-maximisation. The data enter as counts of
patterns (which sources state a value, which state another), an aggregate whose size depends on the
sources that speak of one entity and not on the number of rows. Up to MOST_PATTERNS patterns are
iterated over on the driver, more of them where they lie, by the same steps. Values are compared in one writing
(case, blanks, the country code of a phone). ``judged`` gives every value with the chance that it is true
and ``kept``: all values judged true stay, the likeliest if none is.

``survivors`` then elects one record for each attribute. TESTDATA.md fixes that order wholly
(completeness, recency, source rank, record key), and no source model can reproduce a fixed order,
so there the model's judgement is reported beside the winner and doesn't overrule the order.

Defined results: records of no entity, entities without two live members and attributes without a
usable value have no row; a null flag doesn't disqualify; repeated rows count once; ties end at the
smaller record key; empty tables give no rows; further columns are ignored.
"""

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.session import cut, reclaim

ATTRIBUTES = ["given_name", "family_name", "email", "phone_e164", "address", "birth_date"]
ADDRESS = ["addr_number", "addr_street", "addr_unit", "addr_city", "addr_region", "addr_postal"]
RANKS = {"crm": 1, "billing": 2, "webforms": 3}
#: Patterns of one run of the model that are brought to the driver, a few MB.
MOST_PATTERNS = 50_000
#: Rounds and change of a parameter after which the iterations end.
ROUNDS, TOLERANCE = 200, 1e-6
#: First guess of a value's chance to be true, of sensitivity and of specificity; and the weak prior of
#: each, as cases that agree and cases in all.
START, PRIOR = (0.6, 0.8, 0.6), ((3, 5), (4, 5), (3, 5))


def _latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the columns named, nulls first."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = F.max(F.struct(*order, *rest)).alias("x")
    return df.groupBy(key).agg(best).select(key, *(F.col(f"x.{c}").alias(c) for c in df.columns if c != key))


def members(membership: DataFrame, std: DataFrame) -> DataFrame:
    """Live records with their entity: latest assignment, latest standardized row; entities of two or more."""
    now = _latest(membership.filter("record_key IS NOT NULL").select("record_key", "assigned_at", "id", "entity_id"), "record_key", "assigned_at", "id").select("record_key", "entity_id")
    cols = ["given_name", "family_name", "email", "email_valid", "phone_e164", "phone_valid", *ADDRESS, "birth_date", "updated_at_source", "source_system"]
    live = _latest(std.filter("record_key IS NOT NULL").select("record_key", "ingested_at", "id", *cols), "record_key", "ingested_at", "id").join(now, "record_key")
    many = live.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("entity_id")
    return live.join(many, "entity_id")


def _filled(c: str) -> Column:
    return ~F.lower(F.trim(F.col(c))).isin(X.FILLER_WORDS)


def claims(live: DataFrame) -> DataFrame:
    """(entity_id, attribute, record_key, source_system, value, completeness, at): each usable value."""
    digits = F.regexp_replace("phone_e164", "[^0-9]", "")
    day = F.col("birth_date").cast("string")
    usable = {
        "given_name": _filled("given_name"),
        "family_name": _filled("family_name"),
        "email": X.email_norm(X.email_text(F.col("email"))).isNotNull() & F.coalesce(F.col("email_valid"), F.lit(True)),
        "phone_e164": X.phone_norm(X.phone_text(digits)).isNotNull() & F.coalesce(F.col("phone_valid"), F.lit(True)),
        "address": _filled("addr_street"),
        "birth_date": ~day.isin(X.DEFAULT_DATES),
    }
    one = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    value = {a: one(F.col(a)) for a in ("given_name", "family_name", "email")} | {"phone_e164": F.regexp_replace(digits, "^1(?=[0-9]{10}$)", ""), "birth_date": day, "address": one(F.concat_ws(" ", *ADDRESS))}
    longer = lambda c: (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) > 1).cast("int")
    whole = {"given_name": longer("given_name"), "family_name": longer("family_name"), "address": reduce(lambda x, y: x + y, (F.col(c).isNotNull().cast("int") for c in ADDRESS))}
    rows = F.array_compact(
        F.array(*(F.when(usable[a], F.struct(F.lit(a).alias("attribute"), value[a].alias("value"), whole.get(a, F.lit(1)).alias("completeness"))) for a in ATTRIBUTES))
    )
    at = F.coalesce("updated_at_source", "ingested_at").alias("at")
    return live.select("entity_id", "record_key", "source_system", at, F.explode(rows).alias("c")).select("entity_id", "c.attribute", "record_key", "source_system", "c.value", "c.completeness", "at")


def _stated(made: DataFrame) -> DataFrame:
    """Each value of each entity's attribute with ``seen``: the sources that speak of the attribute, in order,
    and whether they state this value."""
    said = F.array_sort(F.collect_set("source_system"))  # a set of sources, however many rows there are
    value = made.groupBy("entity_id", "attribute", "value").agg(F.count(F.lit(1)).alias("records"), said.alias("its"))
    talks = made.groupBy("entity_id", "attribute").agg(said.alias("all"))
    seen = F.transform("all", lambda s: F.struct(s.alias("source"), F.array_contains("its", s).alias("yes")))
    return value.join(talks, ["entity_id", "attribute"]).select("entity_id", "attribute", "value", "records", seen.alias("seen"))


Parameters = dict[str, tuple[float, dict[str, tuple[float, float]]]]


def _updated(sums: list[tuple[str, str | None, float, float, float, float]]) -> Parameters:
    """(chance that a value is true, sensitivity and specificity of each source) by attribute, from
    (attribute, source, true and stated, true, false and not stated, false); the source is null for the attribute itself."""
    rate = lambda kind, yes, n: (yes + PRIOR[kind][0]) / (n + PRIOR[kind][1])
    whole = {a: rate(0, t, t + f) for a, s, _, t, _, f in sums if s is None}
    return {a: (p, {s: (rate(1, ty, t), rate(2, fn, f)) for b, s, ty, t, fn, f in sums if b == a and s is not None}) for a, p in whole.items()}


def _change(old: Parameters, new: Parameters) -> float:
    each = lambda m: [x for a in sorted(m) for x in (m[a][0], *(y for s in sorted(m[a][1]) for y in m[a][1][s]))]
    return max((abs(x - y) for x, y in zip(each(old), each(new))), default=0.0)


def _first_guess(sources: dict[str, set[str]]) -> Parameters:
    return {a: (START[0], {s: START[1:] for s in of}) for a, of in sources.items()}


def chance(seen: Sequence[tuple[str, bool]], prior: float, rates: Mapping[str, tuple[float, float]]) -> float:
    """Chance that a value is true, given which of the speaking sources state it."""
    t, f = math.log(prior), math.log1p(-prior)
    for s, yes in seen:
        sens, spec = rates[s]
        t += math.log(sens if yes else 1 - sens)
        f += math.log(1 - spec if yes else spec)
    return 1 / (1 + math.exp(min(f - t, 700.0)))


def fit(patterns: Sequence[tuple[str, Sequence[tuple[str, bool]], int]]) -> Parameters:
    """The model from (attribute, seen, count) by expectation-maximisation. Its weak priors keep rates
    off 0 and 1 and the two classes from changing places."""
    sources: dict[str, set[str]] = {}
    for a, seen, _ in patterns:
        sources.setdefault(a, set()).update(s for s, _ in seen)
    model = _first_guess(sources)
    for _ in range(ROUNDS):
        sums: dict[tuple[str, str | None], list[float]] = {}
        for a, seen, n in patterns:
            t = n * chance(seen, *model[a])
            for s, yes in [(None, True), *seen]:
                x = sums.setdefault((a, s), [0.0] * 4)
                x[0] += t * yes
                x[1] += t
                x[2] += (n - t) * (not yes)
                x[3] += n - t
        new = _updated([(a, s, *x) for (a, s), x in sums.items()])
        done, model = _change(model, new) < TOLERANCE, new
        if done:
            break
    return model


def _chances(patterns: DataFrame, model: Parameters) -> DataFrame:
    """``patterns`` (attribute, seen, ...) with ``p_true``; a model is as small as the list of sources."""
    spark = patterns.sparkSession
    rows = [(a, math.log(p), math.log1p(-p), {s: [math.log(se), math.log1p(-se), math.log1p(-sp), math.log(sp)] for s, (se, sp) in rates.items()}) for a, (p, rates) in model.items()]
    table = spark.createDataFrame(rows, "attribute string, t double, f double, rates map<string,array<double>>")
    of = lambda x, yes, no: F.try_element_at("rates", x["source"])[F.when(x["yes"], yes).otherwise(no)]
    add = lambda start, yes, no: F.aggregate("seen", F.col(start), lambda acc, x: acc + of(x, yes, no))
    p = 1 / (1 + F.exp(F.least(add("f", 2, 3) - add("t", 0, 1), F.lit(700.0))))
    return patterns.join(F.broadcast(table), "attribute").withColumn("p_true", p).drop("t", "f", "rates")


def fit_where_it_lies(patterns: DataFrame) -> Parameters:
    """``fit`` for patterns (attribute, seen, n) that stay distributed; only sums by source come to the driver."""
    each = patterns.select("attribute", F.explode("seen.source").alias("source")).distinct().collect()  # as many as sources
    sources: dict[str, set[str]] = {}
    for r in each:
        sources.setdefault(r.attribute, set()).add(r.source)
    model = _first_guess(sources)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("source"), F.lit(True).alias("yes")))
    for _ in range(ROUNDS):
        t = F.col("n") * F.col("p_true")
        said = _chances(patterns, model).select("attribute", t.alias("t"), (F.col("n") - t).alias("f"), F.explode(F.concat("seen", whole)).alias("x"))
        yes = F.col("x.yes").cast("double")
        sums = said.groupBy("attribute", "x.source").agg(F.sum(F.col("t") * yes), F.sum("t"), F.sum(F.col("f") * (1 - yes)), F.sum("f")).collect()
        new = _updated([tuple(r) for r in sums])
        done, model = _change(model, new) < TOLERANCE, new
        if done:
            break
    return model


def judged(made: DataFrame, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """(entity_id, attribute, value, records, p_true, kept): every value stated, with the chance that it is
    true and whether it is kept. Claims of no source count for nothing."""
    stated = cut(_stated(made.filter("source_system IS NOT NULL")))
    patterns = cut(stated.groupBy("attribute", "seen").agg(F.count(F.lit(1)).alias("n")))
    if patterns.count() <= most_patterns:
        model = fit([(r.attribute, [(x.source, x.yes) for x in r.seen], r.n) for r in patterns.collect()])
    else:
        model = fit_where_it_lies(patterns)
    known = _chances(patterns, model).select("attribute", "seen", "p_true")
    values = cut(stated.join(known, ["attribute", "seen"]).select("entity_id", "attribute", "value", "records", "p_true"))
    reclaim(stated)
    reclaim(patterns)
    best = values.groupBy("entity_id", "attribute").agg(F.max(F.struct("p_true", "records", F.col("value").alias("v")))["v"].alias("best"))
    return values.join(best, ["entity_id", "attribute"]).select("entity_id", "attribute", "value", "records", "p_true", ((F.col("p_true") >= 0.5) | (F.col("value") == F.col("best"))).alias("kept"))


def survivors(membership: DataFrame, std: DataFrame) -> DataFrame:
    """(entity_id, attribute, record_key, value, p_true, kept): who supplies each attribute, with the model's
    chance that the value is true and whether the model keeps it."""
    made = cut(claims(members(membership, std)))
    rank = reduce(lambda w, s: w.when(F.col("source_system") == s, RANKS[s]), RANKS, F.when(F.lit(False), 0)).otherwise(len(RANKS) + 1)
    later = F.coalesce(-F.unix_micros(F.col("at").cast("timestamp")), F.lit(2**62))  # a record without any time comes last
    order = F.struct((-F.col("completeness")).alias("c"), later.alias("t"), rank.alias("r"), "record_key", "value")
    best = made.groupBy("entity_id", "attribute").agg(F.min(order).alias("x")).select("entity_id", "attribute", "x.record_key", "x.value")
    return best.join(judged(made).drop("records"), ["entity_id", "attribute", "value"], "left").select("entity_id", "attribute", "record_key", "value", "p_true", "kept")
