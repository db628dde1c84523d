"""Training of a linkage model: prior, u from random pairs, EM on agreement patterns, m from labels.

Spark counts; the driver only ever sees counts of agreement patterns, whose number depends on the
model and not on the data.
"""

from __future__ import annotations

import statistics
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import linkage as L


def total_comparisons(df: DataFrame, link: str = "dedupe") -> DataFrame:
    """(total): pairs that could be compared; for link_only only those of different sources."""
    if link != "link_only":
        n = F.count(F.lit(1))
        return df.agg((n * (n - 1) / 2).cast("long").alias("total"))
    each = df.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("total"))


def prior(df: DataFrame, rules: Sequence[L.Rule], uid: str, recall: float) -> DataFrame:
    """(pairs, prior): chance that two records match, from the pairs deterministic rules find and their recall."""
    model = L.Model(uid, tuple(rules), ())
    found = L.block(df, model).agg(F.count(F.lit(1)).alias("pairs"))
    both = found.crossJoin(total_comparisons(df))
    share = F.col("pairs") / F.lit(float(recall)) / F.col("total")
    return both.select("pairs", F.when(share > 1, F.raise_error(F.lit("more pairs than the recall allows"))).otherwise(share).cast("double").alias("prior"))


def sampled(df: DataFrame, uid: str, proportion: float, seed: int = 0) -> DataFrame:
    """A sample by hash of the id: the same records whatever the partitioning."""
    if proportion >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(uid), F.lit(seed)), F.lit(1_000_000_000)) < round(proportion * 1e9))


def estimate_u(df: DataFrame, model: L.Model, max_pairs: float = 1e6, seed: int = 0) -> DataFrame:
    """(comparison, gamma, n, u): shares of each level among pairs of a sample of records, which almost
    all are no matches. The sample is bounded by max_pairs, so its pairing is too; below that it is everything."""
    n = df.count()
    size = (1 + (1 + 8 * max_pairs) ** 0.5) / 2
    part = sampled(df, model.uid, size / n if n else 1, seed)
    pairs = L.block(part, L.Model(model.uid, (L.Rule(()),), model.comparisons), allow_cartesian=True)
    return level_shares(L.vectors(pairs, model), model, "u")


def level_shares(vectors: DataFrame, model: L.Model, name: str) -> DataFrame:
    """(comparison, gamma, n, share): of each comparison the share of each level among its non-null pairs."""
    each = F.explode(F.array(*(F.struct(F.lit(c.column).alias("comparison"), F.col(f"gamma_{c.column}").alias("gamma")) for c in model.comparisons)))
    long = patterns(vectors, model).select(each.alias("x"), "n").select("x.*", "n").filter("gamma >= 0").groupBy("comparison", "gamma").agg(F.sum("n").alias("n"))
    total = long.groupBy("comparison").agg(F.sum("n").alias("t"))
    return long.join(total, "comparison").select("comparison", "gamma", "n", (F.col("n") / F.col("t")).alias(name))


def patterns(vectors: DataFrame, model: L.Model) -> DataFrame:
    """Agreement patterns with their number of pairs."""
    return vectors.groupBy(*(f"gamma_{c.column}" for c in model.comparisons)).agg(F.count(F.lit(1)).alias("n"))


def em(counts: np.ndarray, n: np.ndarray, model: L.Model, rounds: int = 25, tolerance: float = 1e-4, fix_u: dict[str, list[float]] | None = None) -> dict:
    """Expectation-maximisation on agreement patterns (rows of gammas with their counts).

    Gives the prior and, for each comparison, m and u by level, the else level first.
    """
    lam = model.prior
    mu = {c.column: [list(x) for x in zip(*reversed(L._mu(c)))] for c in model.comparisons}
    for k, u in (fix_u or {}).items():
        mu[k][1] = list(u)
    history = []
    for _ in range(rounds):
        lm, lu = np.full(len(n), np.log(lam)), np.full(len(n), np.log1p(-lam))
        for i, c in enumerate(model.comparisons):
            g, seen = counts[:, i], counts[:, i] >= 0
            m, u = (np.log(np.maximum(x, 1e-300)) for x in mu[c.column])
            lm += np.where(seen, m[np.maximum(g, 0)], 0)
            lu += np.where(seen, u[np.maximum(g, 0)], 0)
        p = 1 / (1 + np.exp(lu - lm))
        new_lam, change = float((p * n).sum() / n.sum()), abs(float((p * n).sum() / n.sum()) - lam)
        for i, c in enumerate(model.comparisons):
            for side, w in ((0, p * n), (1, (1 - p) * n)):
                if side and c.column in (fix_u or {}):
                    continue
                tot = np.array([w[counts[:, i] == g].sum() for g in range(len(c.levels) + 1)])
                if tot.sum() > 0:
                    new = tot / tot.sum()
                    change = max(change, float(np.abs(new - mu[c.column][side]).max()))
                    mu[c.column][side] = list(new)
        lam = new_lam
        history.append(change)
        if change < tolerance:
            break
    return {"prior": lam, "levels": mu, "rounds": len(history)}


def starting_prior(model: L.Model, columns: Sequence[str]) -> float:
    """The prior among pairs that a rule on ``columns`` blocks: multiplied by the Bayes factor of each exact
    level those columns cover."""
    left, odds = list(columns), model.prior / (1 - model.prior)
    for c in model.comparisons:
        exact = next((i for i, x in enumerate(c.levels) if x.token == "exact"), None)
        if exact is not None and not c.members and c.column in left:
            left.remove(c.column)
            m, u = L._mu(c)[exact]
            odds *= m / u
    return odds / (1 + odds)


def em_session(df: DataFrame, model: L.Model, rule: L.Rule, rounds: int = 25, fix_u: bool = True) -> dict:
    """EM over the pairs one rule blocks, from the prior among such pairs; comparisons on the rule's own
    columns are left out, and u stays as it is unless asked for otherwise."""
    import re

    used = [w for k in (*rule.keys, rule.also or "") for w in re.findall(r"\w+", k)]
    rest = tuple(c for c in model.comparisons if not {c.column, *c.members} & set(used))
    part = L.Model(model.uid, (rule,), rest, starting_prior(model, used))
    rows = patterns(L.vectors(L.block(df, part), part), part).collect()
    g = np.array([[r[f"gamma_{c.column}"] for c in part.comparisons] for r in rows], dtype=int).reshape(len(rows), len(part.comparisons))
    known = {c.column: [u for _, u in reversed(L._mu(c))] for c in rest} if fix_u else None
    return em(g, np.array([r.n for r in rows], dtype=float), part, rounds, fix_u=known)


def with_u(model: L.Model, shares: Sequence) -> L.Model:
    """``model`` with u from rows (comparison, gamma, u); a level no pair fell into keeps what it has."""
    got = {(r["comparison"], r["gamma"]): r["u"] for r in shares}
    out = []
    for c in model.comparisons:
        n = len(c.levels)
        levels = tuple(L.Level(x.token, x.m, got.get((c.column, n - i), x.u), x.tf) for i, x in enumerate(c.levels))
        out.append(L.Comparison(c.column, levels, c.m_else, got.get((c.column, 0), c.u_else), c.members))
    return L.Model(model.uid, model.rules, tuple(out), model.prior, model.extra)


def train(df: DataFrame, model: L.Model, sure_rules: Sequence[L.Rule], recall: float, em_rules: Sequence[L.Rule], u_pairs: float = 1e6, labels: DataFrame | None = None) -> tuple[L.Model, list[dict]]:
    """The trained model and its EM sessions: prior from rules that are sure to find matches and their recall,
    u from random pairs, m by EM over each rule's pairs, combined by the median. With ``labels``
    (<uid>_l, <uid>_r), pairs known to match, m comes from these where they tell it."""
    found = prior(df, sure_rules, model.uid, recall).first()["prior"]
    model = L.Model(model.uid, model.rules, model.comparisons, min(max(found, 1e-12), 1 - 1e-12), model.extra)
    model = with_u(model, estimate_u(df, model, u_pairs).collect())  # levels of the model, not rows
    sessions = [em_session(df, model, r) for r in em_rules]
    model = trained(model, combined(sessions))
    if labels is not None:
        told = {(r["comparison"], r["gamma"]): r["m"] for r in m_from_pairs(df, model, labels).collect()}
        out = []
        for c in model.comparisons:
            n = len(c.levels)
            levels = tuple(L.Level(x.token, told.get((c.column, n - i), x.m), x.u, x.tf) for i, x in enumerate(c.levels))
            out.append(L.Comparison(c.column, levels, told.get((c.column, 0), c.m_else), c.u_else, c.members))
        model = L.Model(model.uid, model.rules, tuple(out), model.prior, model.extra)
    return model, sessions


def full_agreement_bits(model: L.Model) -> float:
    """Evidence of a pair that agrees at the best level of every comparison, the prior left aside."""
    return sum(L.bits(*L._mu(c)[0]) for c in model.comparisons)


def m_from_column(df: DataFrame, model: L.Model, label: str) -> DataFrame:
    """(comparison, gamma, n, m): level shares among pairs with the same label."""
    pairs = L.block(df, L.Model(model.uid, (L.Rule((label,)),), model.comparisons))
    return level_shares(L.vectors(pairs, model), model, "m")


def m_from_pairs(df: DataFrame, model: L.Model, labels: DataFrame) -> DataFrame:
    """(comparison, gamma, n, m): level shares among labelled pairs (columns <uid>_l, <uid>_r)."""
    l, r = L.sides(df)
    pairs = labels.select(f"{model.uid}_l", f"{model.uid}_r").join(l, f"{model.uid}_l").join(r, f"{model.uid}_r")
    return level_shares(L.vectors(pairs, model), model, "m")


def combined(sessions: Sequence[dict]) -> dict[str, list[tuple[float, float]]]:
    """Median over sessions of each level's m and u; a comparison no session saw is absent."""
    names = {k for s in sessions for k in s["levels"]}
    out = {}
    for k in names:
        got = [s["levels"][k] for s in sessions if k in s["levels"]]
        out[k] = [(statistics.median(x[0][i] for x in got), statistics.median(x[1][i] for x in got)) for i in range(len(got[0][0]))]
    return out


def trained(model: L.Model, levels: dict[str, list[tuple[float, float]]], lam: float | None = None) -> L.Model:
    """``model`` with estimates put in, the else level first in each list."""
    out = []
    for c in model.comparisons:
        if c.column not in levels:
            out.append(c)
            continue
        (em_, eu), *rest = levels[c.column]
        new = tuple(L.Level(x.token, m, u, x.tf) for x, (m, u) in zip(c.levels, reversed(rest)))
        out.append(L.Comparison(c.column, new, em_, eu, c.members))
    return L.Model(model.uid, model.rules, tuple(out), model.prior if lam is None else lam, model.extra)


def report(spark, model: L.Model) -> DataFrame:
    """(comparison, gamma, m, u, bits, is_default): the model's levels as a table."""
    rows = []
    for c in model.comparisons:
        known = [x.m is not None and x.u is not None for x in c.levels] + [c.m_else is not None]
        for i, ((m, u), k) in enumerate(zip(L._mu(c), known)):
            rows.append((c.column, len(c.levels) - i, float(m), float(u), L.bits(m, u), not k))
    return spark.createDataFrame(rows, "comparison string, gamma int, m double, u double, bits double, is_default boolean")
