"""Probabilistic linkage: concatenation, blocking, comparison vectors, scores, chunks, increments.

Everything is a lazy plan. Blocking is one equi-join for each rule, so skewed keys are AQE's to
split; a pair found by several rules is credited to the first. A rule without an equi-condition
would be a cross join and is refused unless asked for by ``allow_cartesian``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.comparators import predicate


@dataclass(frozen=True)
class Level:
    """One level of a comparison: a token, or a SQL text over ``<column>_l`` and ``<column>_r``."""

    token: str
    m: float | None = None
    u: float | None = None
    tf: bool = False


@dataclass(frozen=True)
class Comparison:
    """Levels from the best down; a null level comes before them and an else level after them."""

    column: str
    levels: tuple[Level, ...]
    m_else: float | None = None
    u_else: float | None = None
    #: Columns that are compared with each other, any with any, instead of one column.
    members: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.column


@dataclass(frozen=True)
class Rule:
    """Pairs agree on all ``keys`` (columns or SQL texts of one record) and fulfil ``also`` (SQL over _l and _r)."""

    keys: tuple[str, ...]
    also: str | None = None
    explode: bool = False


@dataclass(frozen=True)
class Model:
    uid: str
    rules: tuple[Rule, ...]
    comparisons: tuple[Comparison, ...]
    prior: float = 0.0001
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({**self.extra, **{k: v for k, v in asdict(self).items() if k != "extra"}}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        """The model of a settings document; keys it doesn't know are kept and written again."""
        d = json.loads(text)
        rules = tuple(Rule(tuple(r["keys"]), r.get("also"), r.get("explode", False)) for r in d.pop("rules"))
        comparisons = tuple(Comparison(c["column"], tuple(Level(**x) for x in c["levels"]), c.get("m_else"), c.get("u_else"), tuple(c.get("members", ()))) for c in d.pop("comparisons"))
        return Model(d.pop("uid"), rules, comparisons, d.pop("prior", 0.0001), d)


def concat(frames: dict[str, DataFrame]) -> DataFrame:
    """Inputs stacked in the first one's column order, each with its name as ``source_dataset`` unless it has one."""
    first = next(iter(frames.values())).columns
    parts = [df.select(*first, *([] if "source_dataset" in first else [F.lit(n).alias("source_dataset")])) for n, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns)) for s in "lr")  # type: ignore[return-value]


def _keyed(df: DataFrame, rule: Rule) -> DataFrame:
    """``df`` with the rule's keys as __k0, __k1...; rows with a null key can't match and go before the shuffle."""
    out = df.withColumns({f"__k{i}": F.expr(k) for i, k in enumerate(rule.keys)})
    if rule.explode:
        for i, k in enumerate(rule.keys):
            if dict(out.dtypes)[f"__k{i}"].startswith("array"):
                out = out.withColumn(f"__k{i}", F.explode(F.array_distinct(f"__k{i}")))
    return reduce(lambda d, i: d.filter(F.col(f"__k{i}").isNotNull()), range(len(rule.keys)), out)


def _rule_pairs(left: DataFrame, right: DataFrame, rule: Rule, allow_cartesian: bool = False) -> DataFrame:
    if not rule.keys and not allow_cartesian:
        raise ValueError("a rule without keys is a cross join; say allow_cartesian")
    l, r = _keyed(left, rule), _keyed(right, rule)  # noqa: E741
    l = l.select(*(F.col(c).alias(f"{c}_l") for c in l.columns))  # noqa: E741
    r = r.select(*(F.col(c).alias(f"{c}_r") for c in r.columns))
    on = reduce(lambda a, b: a & b, (F.col(f"__k{i}_l") == F.col(f"__k{i}_r") for i in range(len(rule.keys))), F.lit(True))
    out = l.join(r, on) if rule.keys else l.crossJoin(r)
    out = out.filter(rule.also) if rule.also else out
    return out.drop(*(f"__k{i}_{s}" for i in range(len(rule.keys)) for s in "lr"))


def _agrees(rule: Rule, columns: Sequence[str]) -> Column:
    """Whether a pair meets a rule; null counts as no."""
    import re

    names = sorted(columns, key=len, reverse=True)
    on = lambda e, s: re.sub(r"(?<![\w'])(" + "|".join(map(re.escape, names)) + r")(?![\w'(])", rf"\1_{s}", e)
    parts = []
    for k in rule.keys:
        a, b = F.expr(on(k, "l")), F.expr(on(k, "r"))
        parts.append(F.arrays_overlap(a, b) if rule.explode else a == b)
    if rule.also:
        parts.append(F.expr(rule.also))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def block(df: DataFrame, model: Model, link: str = "dedupe", right: DataFrame | None = None, allow_cartesian: bool = False) -> DataFrame:
    """Candidate pairs with the columns of both sides and ``match_key``, the number of the first rule met.

    link: dedupe and link_and_dedupe take any two records, link_only two of different
    ``source_dataset``. With ``right`` the pairs go across two tables, without an order of ids.
    """
    uid, parts = model.uid, []
    for i, rule in enumerate(model.rules):
        p = _rule_pairs(df, df if right is None else right, rule, allow_cartesian)
        if right is None:
            p = p.filter(F.col(f"{uid}_l") < F.col(f"{uid}_r"))
        if link == "link_only":
            p = p.filter("source_dataset_l <> source_dataset_r")
        for before in model.rules[:i]:
            if not before.explode:
                p = p.filter(~_agrees(before, df.columns))
        if rule.explode:
            p = p.dropDuplicates([f"{uid}_l", f"{uid}_r"])
        parts.append(p.withColumn("match_key", F.lit(str(i))))
    out = reduce(DataFrame.unionByName, parts)
    if any(r.explode for r in model.rules[:-1]):  # an exploding rule can't be told from a pair alone
        first = out.groupBy(f"{uid}_l", f"{uid}_r").agg(F.min("match_key").alias("match_key"))
        out = out.join(first, [f"{uid}_l", f"{uid}_r", "match_key"], "left_semi")
    return out


def any_of(df: DataFrame, uid: str, columns: Sequence[str]) -> DataFrame:
    """Pairs of which any of the columns of one equals any of the columns of the other: values are
    exploded and joined on equality, not compared by a condition with OR."""
    v = df.select(F.col(uid).alias("u"), F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias("v"))
    a, b = v.select(F.col("u").alias(f"{uid}_l"), "v"), v.select(F.col("u").alias(f"{uid}_r"), "v")
    return a.join(b, "v").filter(F.col(f"{uid}_l") < F.col(f"{uid}_r")).select(f"{uid}_l", f"{uid}_r").distinct()


def term_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(column, tf_column): share of each value among the non-null ones."""
    total = df.agg(F.count(column).alias("__n"))
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c")).crossJoin(F.broadcast(total)).select(column, (F.col("__c") / F.col("__n")).alias(f"tf_{column}"))


def with_frequencies(df: DataFrame, model: Model, frozen: dict[str, DataFrame] | None = None) -> DataFrame:
    """``df`` with tf_<column> for each comparison that adjusts for it; frozen tables keep old scores comparable."""
    for c in model.comparisons:
        if any(x.tf for x in c.levels):
            df = df.join((frozen or {}).get(c.column) if frozen and c.column in frozen else term_frequencies(df, c.column), c.column, "left")
    return df


def gamma(c: Comparison) -> Column:
    """Number of the level a pair falls into: -1 with a null, n for the best of n levels, 0 for none. Of a
    comparison with members a side is null if all of them are. A first level blank:both or blank:either
    stands before the null level."""
    left, right = ([F.col(f"{m}_{s}") for m in c.members or (c.column,)] for s in "lr")
    na, nb = (reduce(lambda x, y: x & y, (v.isNull() for v in side)) for side in (left, right))
    out = None
    for i, x in enumerate(c.levels):
        n = len(c.levels) - i
        if x.token.startswith("blank:"):
            out = F.when(na & nb if x.token == "blank:both" else na | nb, n)
            continue
        if i == 0 or c.levels[i - 1].token.startswith("blank:"):
            out = F.when(na | nb, -1) if out is None else out.when(na | nb, -1)
        test = F.expr(x.token) if "_l" in x.token else reduce(lambda p, q: p | q, (F.coalesce(predicate(x.token)(a, b), F.lit(False)) if c.members else predicate(x.token)(a, b) for a in left for b in right))
        out = out.when(test, n)
    return (F.when(na | nb, -1) if out is None else out).otherwise(0)


def vectors(pairs: DataFrame, model: Model) -> DataFrame:
    """Pairs with gamma_<column> for each comparison."""
    return pairs.withColumns({f"gamma_{c.column}": gamma(c) for c in model.comparisons})


def defaults(n: int) -> tuple[list[float], list[float]]:
    """(m, u) of n levels and the else level before training, the best level first."""
    if n == 1:
        return [0.95, 0.05], _from_weights([0.95, 0.05], [10.0, -5.0])
    rest = [0.05 / n] * n
    m = [0.95, *rest]
    steps = [10.0] + [3.0 - 8.0 * i / (n - 1) for i in range(n)] if n > 1 else [10.0, -5.0]
    return m, _from_weights(m, steps)


def _from_weights(m: Sequence[float], weights: Sequence[float]) -> list[float]:
    return [x / 2.0**w for x, w in zip(m, weights)]


def bits(m: float, u: float) -> float:
    return math.log2(max(m, 1e-300) / max(u, 1e-300))


def _mu(c: Comparison) -> list[tuple[float, float]]:
    dm, du = defaults(len(c.levels))
    got = [(x.m, x.u) for x in c.levels] + [(c.m_else, c.u_else)]
    return [(m if m is not None else d, u if u is not None else e) for (m, u), d, e in zip(got, dm, du)]


def weight(c: Comparison) -> Column:
    """Bits of a comparison's level; a null weighs nothing."""
    out = F.when(F.col(f"gamma_{c.column}") == -1, 0.0)
    for i, (m, u) in enumerate(_mu(c)):
        out = out.when(F.col(f"gamma_{c.column}") == len(c.levels) - i, bits(m, u))
    return out.otherwise(0.0)


def tf_weight(c: Comparison, least_u: float = 1e-9) -> Column:
    """Correction for the frequency of the values at levels that ask for it: log2 of the level's u
    against the larger of the two sides' frequencies."""
    tl, tr = F.col(f"tf_{c.column}_l"), F.col(f"tf_{c.column}_r")
    top = F.greatest(F.coalesce(tl, tr), F.coalesce(tr, tl), F.lit(least_u))
    out = None
    exact = next((u for x, (_, u) in zip(c.levels, _mu(c)) if x.token == "exact"), None)
    for i, (x, (_, u)) in enumerate(zip(c.levels, _mu(c))):
        if x.tf:
            hit = (F.col(f"gamma_{c.column}") == len(c.levels) - i) & top.isNotNull() & (tl.isNotNull() | tr.isNotNull())
            value = math.log2(exact if exact is not None else u) - F.log2(top)
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(0.0) if out is None else out.otherwise(0.0)


def score(pairs: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    """Pairs with gamma, mw_<column>, mw_tf_adj_<column>, match_weight and match_probability; with a
    threshold on the probability only those that reach it."""
    out = vectors(pairs, model)
    out = out.withColumns({f"mw_{c.column}": weight(c) for c in model.comparisons})
    adjusted = [c for c in model.comparisons if any(x.tf for x in c.levels)]
    out = out.withColumns({f"mw_tf_adj_{c.column}": tf_weight(c) for c in adjusted}) if adjusted else out
    parts = [F.col(f"mw_{c.column}") for c in model.comparisons] + [F.col(f"mw_tf_adj_{c.column}") for c in adjusted]
    out = out.withColumn("match_weight", reduce(lambda a, b: a + b, parts, F.lit(math.log2(model.prior / (1 - model.prior)))))
    w = F.col("match_weight")
    out = out.withColumn("match_probability", F.when(w >= 0, 1 / (1 + F.pow(F.lit(2.0), -w))).otherwise(F.pow(F.lit(2.0), w) / (1 + F.pow(F.lit(2.0), w))))
    if threshold is not None and threshold > 0:
        out = out.filter(w >= math.log2(threshold / (1 - threshold)) if threshold < 1 else F.lit(False))
    return out


def predict(df: DataFrame, model: Model, threshold: float | None = None, link: str = "dedupe") -> DataFrame:
    return score(block(with_frequencies(df, model), model, link), model, threshold)


def predict_chunked(df: DataFrame, model: Model, chunks: int, threshold: float | None = None) -> DataFrame:
    """``predict`` in passes over hash chunks of the right side; their union is the whole."""
    pairs = block(with_frequencies(df, model), model)
    parts = [pairs.filter(F.pmod(F.xxhash64(f"{model.uid}_r"), F.lit(chunks)) == i) for i in range(chunks)]
    return score(reduce(DataFrame.unionByName, parts), model, threshold)


def predict_to_store(df: DataFrame, model: Model, chunks: int, store, table: str, threshold: float | None = None) -> int:
    """``predict`` in passes over hash chunks of the right side, each appended to a table of the store, so no more
    than a pass is in flight; the table as a whole equals ``predict``. Gives the last version's number."""
    pairs = block(with_frequencies(df, model), model)
    version = 0
    for i in range(chunks):
        part = score(pairs.filter(F.pmod(F.xxhash64(f"{model.uid}_r"), F.lit(chunks)) == i), model, threshold)
        version = store.write(table, part, "append" if i else "replace")
    return version


def predict_between(old: DataFrame, new: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    """Pairs of an existing and a new record, with the frequencies of the existing ones."""
    frozen = {c.column: term_frequencies(old, c.column) for c in model.comparisons if any(x.tf for x in c.levels)}
    l, r = (with_frequencies(d, model, frozen) for d in (old, new))  # noqa: E741
    return score(block(l, model, right=r), model, threshold)


def compile_weights(bits_each: Sequence[float]) -> list[tuple[float, float]]:
    """(m, u) of declared bits, anchored at 0.9."""
    return [(0.9, 0.9 / 2**b) if b >= 0 else (0.9 * 2**b, 0.9) for b in bits_each]


def evidence(model: Model) -> Column:
    """Gammas, weights and total of a scored pair as JSON."""
    cols = [F.struct(*(F.col(f"gamma_{c.column}").alias(c.column) for c in model.comparisons)).alias("gamma"), F.struct(*(F.round(f"mw_{c.column}", 6).alias(c.column) for c in model.comparisons)).alias("weight"), F.round("match_weight", 6).alias("total")]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def band(p: Column, auto: float = 0.95, review: float = 0.6) -> Column:
    return F.when(p >= auto, "auto_merge").when(p >= review, "review").otherwise("reject")
