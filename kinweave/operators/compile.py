"""From a declared comparison configuration to a model: weights, levels, cross-field groups; what SQL conditions say.

Conditions are read by Spark's own parser, so whatever Spark can run can be read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from kinweave.operators import linkage as L

#: Bits of evidence of full agreement on everything, and the share of a field's bits that its disagreement costs.
FULL_BITS, AGAINST = 60.0, 0.2
#: The side of m and u that is held when the other follows from a weight.
BASE = 0.9
#: Tokens that read fixed columns of a record and so can't compare any member of a group with any other.
NOT_IN_GROUPS = ("variant_match", "address_components")
BLANKS = ("never", "both", "either")


@dataclass(frozen=True)
class Field:
    """A declared comparison: of one column, or of a group's ``attributes``, any with any."""

    levels: tuple[str, ...]
    weight: float | None = None
    tf: bool = False
    blank: str = "never"
    attributes: tuple[str, ...] = ()


def probabilities(bits: float) -> tuple[float, float]:
    """(m, u) of a level worth so many bits: m is held for evidence that speaks for a match, u for evidence against one."""
    other = min(max(BASE * 2.0 ** -abs(bits), 1e-300), 0.999_999_999)
    return (BASE, other) if bits >= 0 else (other, BASE)


def weights(fields: Mapping[str, Field]) -> dict[str, float]:
    """Weight of each field in per cent: equal shares, or as declared if all are and they make 100."""
    said = {n: f.weight for n, f in fields.items() if f.weight is not None}
    if not said:
        return {n: 100.0 / len(fields) for n in fields}
    if bad := [n for n, w in said.items() if not 0 <= w <= 100]:
        raise ValueError(f"weights of {bad} are not between 0 and 100")
    if len(said) != len(fields) or abs(sum(said.values()) - 100) > 0.001:
        raise ValueError(f"weights must be given for all fields and make 100, not {sum(said.values())}")
    return said


def comparison(name: str, f: Field, weight: float, full_bits: float = FULL_BITS, against: float = AGAINST) -> L.Comparison:
    """Level i of n is worth the share (n - i) / n of the field's bits, so a looser level is worth less;
    disagreement costs a part of them. Where blanks agree, they are a level of their own before all others."""
    if not f.levels:
        raise ValueError(f"{name} has no levels")
    if f.blank not in BLANKS:
        raise ValueError(f"unknown blank policy {f.blank!r}")
    if f.attributes:
        if f.tf:
            raise ValueError(f"{name}: a group has no term frequencies")
        if len(f.attributes) < 2:
            raise ValueError(f"{name}: a group needs two attributes")
        if bad := [t for t in f.levels if t in NOT_IN_GROUPS]:
            raise ValueError(f"{name}: {bad} can't compare the members of a group")
    n, bits = len(f.levels), full_bits * weight / 100
    levels = [L.Level(t, *probabilities(bits * (n - i) / n), tf=f.tf and i == 0) for i, t in enumerate(f.levels)]
    if f.blank != "never":
        levels.insert(0, L.Level(f"blank:{f.blank}", *probabilities(weight / (n + 1))))
    return L.Comparison(name, tuple(levels), *probabilities(-bits * against), f.attributes)


def compiled(uid: str, rules: Sequence[L.Rule], fields: Mapping[str, Field], prior: float = 0.0001, full_bits: float = FULL_BITS, against: float = AGAINST) -> L.Model:
    """The model of declared fields. A group adds a rule after those declared, so that values which agree across
    its columns make a pair; the rule is an equality on the members' values, not an OR of all against all."""
    share = weights(fields)
    made = tuple(comparison(n, f, share[n], full_bits, against) for n, f in fields.items())
    more = tuple(L.Rule((f"array_compact(array({', '.join(f.attributes)}))",), explode=True) for f in fields.values() if f.attributes)
    return L.Model(uid, (*rules, *more), made, prior)


# What conditions say --------------------------------------------------------------------------------
def _parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parseExpression(sql)


def _kind(e) -> str:
    return e.getClass().getSimpleName()


def _children(e) -> list:
    c = e.children()
    return [c.apply(i) for i in range(c.size())]


def _conjuncts(e) -> Iterator:
    if _kind(e) == "And":
        for c in _children(e):
            yield from _conjuncts(c)
    else:
        yield e


def _parts(e) -> list[str] | None:
    """Parts of a column's name, or None if it isn't a bare column."""
    if _kind(e) != "UnresolvedAttribute":
        return None
    p = e.nameParts()
    return [p.apply(i) for i in range(p.size())]


def _equalities(spark: SparkSession, sql: str) -> list[tuple[list[str], list[str]]] | None:
    """Both sides of each conjunct; None unless all are equalities of two columns."""
    out = []
    for e in _conjuncts(_parsed(spark, sql)):
        sides = [_parts(c) for c in _children(e)] if _kind(e) == "EqualTo" else []
        if len(sides) != 2 or None in sides:
            return None
        out.append(tuple(sides))
    return out


def columns_used(spark: SparkSession, sql: str) -> list[str]:
    """Columns a condition reads, in order, without their _l or _r; names that a lambda binds are not columns."""
    found: list[str] = []

    def walk(e, bound: frozenset[str]) -> None:
        if _kind(e) == "LambdaFunction":
            a = e.arguments()
            names = {_name(a.apply(i)) for i in range(a.size())}
            walk(e.function(), bound | names)
            return
        p = _parts(e)
        if p is None and _kind(e) == "UnresolvedNamedLambdaVariable":
            return
        if p is not None and p[0] not in bound:
            name = p[-1]
            name = name[:-2] if len(name) > 2 and name[-2:] in ("_l", "_r") else name
            if name not in found:
                found.append(name)
        for c in _children(e):
            walk(c, bound)

    def _name(v) -> str:
        p = v.nameParts()
        return p.apply(0)

    walk(_parsed(spark, sql), frozenset())
    return found


def exact_columns(spark: SparkSession, sql: str) -> list[str] | None:
    """Columns of a level that is nothing but c_l = c_r for each; None otherwise."""
    pairs = _equalities(spark, sql.lower()) if sql.strip().upper() != "ELSE" else None
    out: list[str] = []
    for a, b in pairs or ():
        if len(a) != 1 or len(b) != 1 or len(a[0]) < 2 or a[0][:-2] != b[0][:-2]:
            return None
        out += [a[0][:-2]] if a[0][:-2] not in out else []
    return out if pairs else None


def equi_columns(spark: SparkSession, sql: str) -> list[str] | None:
    """Columns of a rule that is nothing but l.c = r.c for each; None otherwise."""
    pairs = _equalities(spark, sql)
    out: list[str] = []
    for a, b in pairs or ():
        if a[-1] != b[-1]:
            return None
        out += [a[-1]] if a[-1] not in out else []
    return out if pairs else None


def rule(spark: SparkSession, sql: str) -> L.Rule:
    """A rule over l. and r.: its equalities of the same expression on either side as keys, the rest as a filter."""
    keys, also = [], []
    for e in _conjuncts(_parsed(spark, sql)):
        text = e.sql()
        sides = [c.sql() for c in _children(e)] if _kind(e) == "EqualTo" else []
        bare = [s.replace("`", "").replace("l.", "", 1) if s.replace("`", "").startswith("l.") else s.replace("`", "").replace("r.", "", 1) for s in sides]
        cols = [[_parts(c) for c in _children(e)]] if sides else []
        if cols and None not in cols[0] and bare[0] == bare[1]:
            keys.append(bare[0])
        else:
            import re

            also.append(re.sub(r"`?\b([lr])`?\.`?(\w+)`?", r"\2_\1", text))
    return L.Rule(tuple(keys), " AND ".join(f"({x})" for x in also) or None)
