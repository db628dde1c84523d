"""Tables and models that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import linkage as L
from kinweave.operators import standardize as S
from kinweave.session import table

RANK = {"crm": 1, "billing": 2, "webforms": 3}


def std(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "int_std_records").filter("record_key IS NOT NULL"), ["record_key"], [F.desc_nulls_last("ingested_at"), F.desc("id")])


def membership(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "entity_membership").filter("record_key IS NOT NULL"), ["record_key"], [F.desc_nulls_last("assigned_at"), F.desc("id")])


def members(spark: SparkSession, d: str) -> DataFrame:
    return std(spark, d).join(membership(spark, d).select("record_key", "entity_id"), "record_key")


PEOPLE = ["record_key", "source_system", "given_name", "family_name", "birth_date", "email", "phone_e164"]
RULES = (L.Rule(("family_name", "birth_date")), L.Rule(("email",)), L.Rule(("phone_e164",)))
COMPARISONS = (
    L.Comparison("given_name", (L.Level("exact", 0.8, 0.01, tf=True), L.Level("first_n:3", 0.1, 0.02)), 0.1, 0.97),
    L.Comparison("family_name", (L.Level("exact", 0.85, 0.004), L.Level("first_n:3", 0.08, 0.02)), 0.07, 0.976),
    L.Comparison("birth_date", (L.Level("exact", 0.9, 0.001), L.Level("dob_same_year_month", 0.04, 0.002)), 0.06, 0.997),
    L.Comparison("email", (L.Level("exact", 0.75, 0.0005), L.Level("username_exact", 0.05, 0.001)), 0.2, 0.9985),
)
PERSON = L.Model("record_key", RULES, COMPARISONS, 0.001)
PLAIN = L.Model("record_key", RULES, tuple(L.Comparison(c.column, tuple(L.Level(x.token, x.m, x.u) for x in c.levels), c.m_else, c.u_else) for c in COMPARISONS), 0.001)


def people(spark: SparkSession, d: str) -> DataFrame:
    return std(spark, d).select(*PEOPLE)


# The same in SQL -------------------------------------------------------------------------------
RULE_SQL = ["l.family_name = r.family_name AND l.birth_date = r.birth_date", "l.email = r.email", "l.phone_e164 = r.phone_e164"]
LEVEL_SQL = {
    "given_name": ["l.given_name = r.given_name", "substr(l.given_name, 1, 3) = substr(r.given_name, 1, 3)"],
    "family_name": ["l.family_name = r.family_name", "substr(l.family_name, 1, 3) = substr(r.family_name, 1, 3)"],
    "birth_date": ["l.birth_date = r.birth_date", "date_trunc('month', l.birth_date) = date_trunc('month', r.birth_date)"],
    "email": ["l.email = r.email", "split_part(l.email, '@', 1) = split_part(r.email, '@', 1)"],
}


def gamma_sql(c: str) -> str:
    a, b = LEVEL_SQL[c]
    return f"CASE WHEN l.{c} IS NULL OR r.{c} IS NULL THEN -1 WHEN {a} THEN 2 WHEN {b} THEN 1 ELSE 0 END"


def pairs_sql(left: str = "std", right: str = "std", extra: str = "l.record_key < r.record_key", rules: list[str] = RULE_SQL) -> str:
    """Common table ``pairs``: ids, match_key and gammas."""
    g = ", ".join(f"{gamma_sql(c)} AS gamma_{c}" for c in LEVEL_SQL)
    parts = []
    for i, r in enumerate(rules):
        no = "".join(f" AND NOT coalesce({b}, false)" for b in rules[:i])
        parts.append(f"SELECT l.record_key AS record_key_l, r.record_key AS record_key_r, '{i}' AS match_key, l.given_name AS given_l, r.given_name AS given_r, {g} FROM {left} l JOIN {right} r ON {r} WHERE {extra}{no}")
    return "pairs AS (" + " UNION ALL ".join(parts) + ")"


def weights_sql(tf: bool = False) -> str:
    """Common table ``scored``: ``pairs`` with match_weight and match_probability."""
    import math

    cases = []
    for c in COMPARISONS:
        (m2, u2), (m1, u1), (m0, u0) = L._mu(c)
        cases.append(f"CASE gamma_{c.column} WHEN 2 THEN {L.bits(m2, u2)!r}::DOUBLE WHEN 1 THEN {L.bits(m1, u1)!r}::DOUBLE WHEN 0 THEN {L.bits(m0, u0)!r}::DOUBLE ELSE 0::DOUBLE END")
    w = " + ".join([f"{math.log2(0.001 / 0.999)!r}::DOUBLE", *cases])
    if tf:
        u = L._mu(COMPARISONS[0])[0][1]
        w += f" + CASE WHEN gamma_given_name = 2 AND coalesce(tl.tf, tr.tf) IS NOT NULL THEN {math.log2(u)!r}::DOUBLE - log2(greatest(coalesce(tl.tf, tr.tf), coalesce(tr.tf, tl.tf), 1e-9)) ELSE 0 END"
        src = "pairs LEFT JOIN tf tl ON tl.given_name = given_l LEFT JOIN tf tr ON tr.given_name = given_r"
        head = "tf AS (SELECT given_name, count(*) / (SELECT count(given_name) FROM std) AS tf FROM std WHERE given_name IS NOT NULL GROUP BY 1), "
    else:
        src, head = "pairs", ""
    return head + f"w AS (SELECT pairs.*, {w} AS mw FROM {src}), scored AS (SELECT *, round(mw, 6) AS match_weight, round(1 / (1 + pow(2, -mw)), 6) AS match_probability FROM w)"
