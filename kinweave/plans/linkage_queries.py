"""Blocking, comparison, scoring and training over the standardized records."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kinweave.operators import comparators as K
from kinweave.operators import evaluate as E
from kinweave.operators import graph as G
from kinweave.operators import compile as M
from kinweave.operators import linkage as L
from kinweave.operators import quality as Q
from kinweave.operators import training as T
from kinweave.plans import common as C
from kinweave.plans.registry import STD, query
from kinweave.session import table

r6 = lambda c: F.round(c, 6)
IDS = ["record_key_l", "record_key_r"]


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, 'customer' AS source_dataset FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier")
def concat_union(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nationkey", "c_acctbal AS acctbal")
    b = table(spark, d, "supplier").selectExpr("s_acctbal AS acctbal", "s_suppkey AS id", "s_name AS name", "s_nationkey AS nationkey")
    return L.concat({"customer": a, "supplier": b})


@query(f"WITH {STD} SELECT given_name, round(count(*) / (SELECT count(given_name) FROM std), 9) AS tf_given_name FROM std WHERE given_name IS NOT NULL GROUP BY 1")
def tf_table(spark, d):
    return L.term_frequencies(C.people(spark, d), "given_name").withColumn("tf_given_name", F.round("tf_given_name", 9))


_TF = " UNION ALL ".join(f"SELECT 'm1' AS model_version, '{c}' AS column_name, {c} AS value, round(count(*) / (SELECT count({c}) FROM std), 9) AS tf_value FROM std WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("given_name", "family_name"))


@query(f"WITH {STD} {_TF}")
def tf_export(spark, d):
    """Frozen frequencies of several columns in long form."""
    df = C.people(spark, d)
    each = [L.term_frequencies(df, c).select(F.lit("m1").alias("model_version"), F.lit(c).alias("column_name"), F.col(c).alias("value"), F.round(f"tf_{c}", 9).alias("tf_value")) for c in ("given_name", "family_name")]
    return each[0].unionByName(each[1])


def _block(spark, d, rules, link="dedupe"):
    df = C.people(spark, d).withColumn("source_dataset", F.col("source_system"))
    return L.block(df, L.Model("record_key", rules, ()), link).select(*IDS, "match_key")


@query(f"WITH {STD}, {C.pairs_sql(rules=C.RULE_SQL[:1])} SELECT record_key_l, record_key_r, match_key FROM pairs")
def block_single(spark, d):
    return _block(spark, d, C.RULES[:1])


@query(f"WITH {STD}, {C.pairs_sql()} SELECT record_key_l, record_key_r, match_key FROM pairs")
def block_multi(spark, d):
    return _block(spark, d, C.RULES)


@query(f"WITH {STD}, {C.pairs_sql(extra='l.record_key < r.record_key AND l.source_system <> r.source_system')} SELECT record_key_l, record_key_r, match_key FROM pairs")
def block_link_only(spark, d):
    return _block(spark, d, C.RULES, "link_only")


@query(f"WITH {STD}, v AS (SELECT record_key, birth_date, unnest(name_variants) AS v FROM std) SELECT DISTINCT l.record_key AS record_key_l, r.record_key AS record_key_r, '0' AS match_key FROM v l JOIN v r ON l.v = r.v AND l.birth_date = r.birth_date WHERE l.record_key < r.record_key")
def block_explode(spark, d):
    df = C.std(spark, d).select("record_key", "birth_date", "name_variants")
    return L.block(df, L.Model("record_key", (L.Rule(("name_variants", "birth_date"), explode=True),), ())).select(*IDS, "match_key")


@query(f"WITH {STD} SELECT l.record_key AS record_key_l, r.record_key AS record_key_r, '0' AS match_key FROM std l JOIN std r ON l.email = r.email WHERE l.source_system = 'crm' AND r.source_system = 'billing'")
def block_cross(spark, d):
    df = C.people(spark, d)
    return L.block(df.filter("source_system = 'crm'"), L.Model("record_key", (L.Rule(("email",)),), ()), right=df.filter("source_system = 'billing'")).select(*IDS, "match_key")


@query(f"WITH {STD} SELECT l.record_key AS record_key_l, r.record_key AS record_key_r FROM std l JOIN std r ON l.phone_e164 = r.phone_e164 WHERE l.record_key < r.record_key AND coalesce(l.given_name = r.given_name, false) AND NOT coalesce(l.email = r.email, false)")
def block_constraints(spark, d):
    """Required agreement and exclusion put on a rule."""
    also = "coalesce(given_name_l = given_name_r, false) AND NOT coalesce(email_l = email_r, false)"
    return _block(spark, d, (L.Rule(("phone_e164",), also),)).drop("match_key")


_ANY = f"WITH {STD}, v AS (SELECT record_key, email AS v FROM std WHERE email IS NOT NULL UNION SELECT record_key, phone_e164 FROM std WHERE phone_e164 IS NOT NULL)"


@query(_ANY + " SELECT DISTINCT l.record_key AS record_key_l, r.record_key AS record_key_r FROM v l JOIN v r USING (v) WHERE l.record_key < r.record_key")
def block_group_any(spark, d):
    return L.any_of(C.people(spark, d), "record_key", ["email", "phone_e164"])


@query(f"WITH {STD}, {C.pairs_sql()} SELECT k AS match_key, count(match_key) AS pairs, sum(count(match_key)) OVER (ORDER BY k)::BIGINT AS cumulative FROM (VALUES ('0'), ('1'), ('2')) t(k) LEFT JOIN pairs ON match_key = k GROUP BY k")
def block_counts(spark, d):
    return E.block_counts(C.people(spark, d), L.Model("record_key", C.RULES, ()))


_KEYS = {"birth": ["birth_date"], "email": ["email"], "family_birth": ["family_name", "birth_date"], "phone": ["phone_e164"]}


def _key_sql(n, cols):
    ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"""SELECT '{n}' AS key, coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS expected_pairs, coalesce(max(n), 0) AS largest_block, round(sum(n) / (SELECT count(*) FROM std), 6) AS coverage,
        round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, round(1 - (sum(n)::DOUBLE * (sum(n) - 1)) / ((SELECT count(*) FROM std)::DOUBLE * ((SELECT count(*) FROM std) - 1)), 6) AS null_pair_loss
        FROM (SELECT count(*) AS n FROM std WHERE {ok} GROUP BY {", ".join(cols)})"""


@query(f"WITH {STD} SELECT *, row_number() OVER (ORDER BY expected_pairs, key)::INT AS rank FROM (" + " UNION ALL ".join(_key_sql(n, c) for n, c in _KEYS.items()) + ")")
def candidate_keys(spark, d):
    out = E.rank_keys(C.people(spark, d), _KEYS)
    return out.select("key", "expected_pairs", "largest_block", *(r6(c).alias(c) for c in ("coverage", "entropy", "null_pair_loss")), "rank")


@query(f"WITH {STD}, l AS (SELECT birth_date::VARCHAR AS key_0, count(*) AS count_l FROM std WHERE birth_date IS NOT NULL GROUP BY 1) SELECT key_0, count_l, count_l AS count_r, count_l * count_l AS comparisons FROM l ORDER BY comparisons DESC, key_0 LIMIT 10")
def largest_blocks(spark, d):
    df = C.people(spark, d).filter("birth_date IS NOT NULL")
    return E.largest_blocks(df, df, ["birth_date"], 10)


_G = ", ".join(f"gamma_{c}" for c in C.LEVEL_SQL)


@query(f"WITH {STD}, {C.pairs_sql()} SELECT record_key_l, record_key_r, match_key, {_G} FROM pairs")
def comparison_vectors(spark, d):
    df = C.people(spark, d)
    return L.vectors(L.block(df, C.PLAIN), C.PLAIN).select(*IDS, "match_key", *(f"gamma_{c}" for c in C.LEVEL_SQL))


_SCORES = "SELECT record_key_l, record_key_r, match_key, match_weight, match_probability FROM scored"


def _out(df):
    return df.select(*IDS, "match_key", r6("match_weight").alias("match_weight"), r6("match_probability").alias("match_probability"))


@query(f"WITH {STD}, {C.pairs_sql()}, {C.weights_sql()} {_SCORES}")
def predict(spark, d):
    return _out(L.predict(C.people(spark, d), C.PLAIN))


@query(f"WITH {STD}, {C.pairs_sql()}, {C.weights_sql(tf=True)} {_SCORES} WHERE mw >= log2(0.95 / 0.05)")
def predict_tf(spark, d):
    """Scores with adjustment for frequent given names, from a probability of 0.95 on."""
    return _out(L.predict(C.people(spark, d), C.PERSON, 0.95))


@query(f"WITH {STD}, {C.pairs_sql()}, {C.weights_sql()} {_SCORES}")
def predict_chunked(spark, d):
    return _out(L.predict_chunked(C.people(spark, d), C.PLAIN, 4))


_OLD, _NEW = "source_system = 'crm'", "source_system <> 'crm'"


@query(f"WITH {STD}, old AS (SELECT * FROM std WHERE {_OLD}), new AS (SELECT * FROM std WHERE {_NEW}), {C.pairs_sql('old', 'new', 'true')}, {C.weights_sql()} {_SCORES}")
def predict_between(spark, d):
    df = C.people(spark, d)
    return _out(L.predict_between(df.filter(_OLD), df.filter(_NEW), C.PLAIN))


@query(f"WITH {STD}, new AS (SELECT * FROM std WHERE {_NEW}), {C.pairs_sql('new', 'new')}, {C.weights_sql()} {_SCORES}")
def predict_within(spark, d):
    return _out(L.predict(C.people(spark, d).filter(_NEW), C.PLAIN))


_SQ = "SELECT a.s_suppkey AS a, b.n_nationkey AS b, CASE WHEN a.s_nationkey = b.n_nationkey THEN 1 ELSE 0 END AS gamma_key FROM supplier a CROSS JOIN nation b"


@query(_SQ)
def score_pairs(spark, d):
    """All pairs of two given sets; the nations' 25 rows are the bounded side."""
    a = table(spark, d, "supplier").selectExpr("s_suppkey AS uid", "s_nationkey AS key")
    b = table(spark, d, "nation").selectExpr("cast(n_nationkey AS bigint) AS uid", "n_nationkey AS key")
    m = L.Model("uid", (L.Rule(()),), (L.Comparison("key", (L.Level("exact"),)),))
    return L.vectors(L.block(a, m, right=b, allow_cartesian=True), m).selectExpr("uid_l AS a", "cast(uid_r AS int) AS b", "gamma_key")


@query(f"WITH {STD} SELECT l.record_key AS record_key_l, r.record_key AS record_key_r, l.given_name AS given_name_l, r.given_name AS given_name_r FROM std l JOIN std r ON l.email = r.email AND l.birth_date = r.birth_date WHERE l.record_key < r.record_key")
def deterministic_link(spark, d):
    return L.block(C.people(spark, d), L.Model("record_key", (L.Rule(("email", "birth_date")),), ())).select(*IDS, "given_name_l", "given_name_r")


@query(f"WITH {STD}, {C.pairs_sql()}, {C.weights_sql()} SELECT CASE WHEN match_probability >= 0.95 THEN 'auto_merge' WHEN match_probability >= 0.6 THEN 'review' ELSE 'reject' END AS band, count(*) AS pairs, min(floor(100 * match_probability))::BIGINT AS least_confidence FROM scored GROUP BY 1")
def banding(spark, d):
    df = _out(L.predict(C.people(spark, d), C.PLAIN)).withColumn("band", L.band(F.col("match_probability")))
    return df.groupBy("band").agg(F.count(F.lit(1)).alias("pairs"), F.min(F.floor(100 * F.col("match_probability"))).alias("least_confidence"))


@query()
def evidence_json(spark, d):
    return L.predict(C.people(spark, d), C.PLAIN).select(*IDS, L.evidence(C.PLAIN).alias("evidence"))


_PAIR = f"WITH {STD}, p AS (SELECT l.*, r.record_key AS k2, r.given_name AS g2, r.family_name AS f2, r.email AS e2, r.birth_date AS b2, r.addr_number AS n2, r.addr_street AS s2, r.addr_postal AS z2, r.name_variants AS v2, r.updated_at_source AS u2, r.addr_city AS c2 FROM std l JOIN std r ON l.phone_e164 = r.phone_e164 WHERE l.record_key < r.record_key)"
_CMP = {
    "exact": ("exact", "given_name", "given_name = g2"),
    "variant_match": ("variant_match", "name_variants", "list_has_any(name_variants, v2)"),
    "username_exact": ("username_exact", "email", "split_part(email, '@', 1) = split_part(e2, '@', 1)"),
    "domain_exact": ("domain_exact", "email", "split_part(email, '@', 2) = split_part(e2, '@', 2)"),
    "dob_same_year_month": ("dob_same_year_month", "birth_date", "date_trunc('month', birth_date) = date_trunc('month', b2)"),
    "jaro_winkler": ("jaro_winkler:0.9", "family_name", "jaro_winkler_similarity(family_name, f2) >= 0.9"),
    "levenshtein": ("levenshtein:2", "addr_postal", "levenshtein(addr_postal, z2) <= 2"),
    "first_n": ("first_n:3", "family_name", "substr(family_name, 1, 3) = substr(f2, 1, 3)"),
    "date_within_days": ("date_within_days:400", "birth_date", "abs(date_diff('day', birth_date, b2)) <= 400"),
    "date_transposed": ("date_transposed", "birth_date", "year(birth_date) = year(b2) AND month(birth_date) = day(b2) AND day(birth_date) = month(b2) AND birth_date <> b2"),
    "numeric_within": ("numeric_within:100", "addr_number", "abs(try_cast(addr_number AS DOUBLE) - try_cast(n2 AS DOUBLE)) <= 100"),
    "numeric_within_pct": ("numeric_within_pct:20", "addr_number", "abs(try_cast(addr_number AS DOUBLE) - try_cast(n2 AS DOUBLE)) <= 0.2::DOUBLE * greatest(abs(try_cast(addr_number AS DOUBLE)), abs(try_cast(n2 AS DOUBLE)))"),
    "contains": ("contains", "given_name", "given_name <> '' AND g2 <> '' AND (contains(given_name, g2) OR contains(g2, given_name))"),
    "datetime_within_hours": ("datetime_within_hours:48", "updated_at_source", "abs(epoch(updated_at_source)::BIGINT - epoch(u2)::BIGINT) <= 172800"),
}


def _cmp(token, column):
    def run(spark, d):
        df = C.std(spark, d).select("record_key", "phone_e164", column) if column != "phone_e164" else C.people(spark, d)
        p = L.block(df, L.Model("record_key", (L.Rule(("phone_e164",)),), ()))
        return p.select(*IDS, K.predicate(token)(F.col(f"{column}_l"), F.col(f"{column}_r")).alias("agrees"))

    return run


for _n, (_token, _column, _sql) in _CMP.items():
    query(f"{_PAIR} SELECT record_key AS record_key_l, k2 AS record_key_r, ({_sql}) AS agrees FROM p", f"cmp_{_n}")(_cmp(_token, _column))


@query(f"{_PAIR} SELECT record_key AS record_key_l, k2 AS record_key_r, (addr_number = n2 AND addr_street = s2 AND addr_postal = z2) AS agrees FROM p")
def cmp_address_components(spark, d):
    p = L.block(C.std(spark, d).select("record_key", "phone_e164", "addr_number", "addr_street", "addr_postal"), L.Model("record_key", (L.Rule(("phone_e164",)),), ()))
    two = lambda c: (F.col(f"{c}_l"), F.col(f"{c}_r"))
    return p.select(*IDS, K.address_components(two("addr_number"), two("addr_street"), two("addr_postal")).alias("agrees"))


_HAV = "2 * 6371.0088 * asin(sqrt(pow(sin((radians(y2) - radians(y1)) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin((radians(x2) - radians(x1)) / 2), 2)))"


@query(f"WITH n AS (SELECT n_nationkey AS k, n_nationkey * 3.5 - 40 AS y, n_nationkey * 7.25 - 90 AS x FROM nation) SELECT a, b, {_HAV} <= 2000 AS agrees FROM (SELECT l.k AS a, r.k AS b, l.y AS y1, l.x AS x1, r.y AS y2, r.x AS x2 FROM n l JOIN n r ON l.k < r.k)")
def cmp_geo_within_km(spark, d):
    n = table(spark, d, "nation").selectExpr("n_nationkey AS k", "concat(cast(n_nationkey * 3.5D - 40 AS string), ',', cast(n_nationkey * 7.25D - 90 AS string)) AS at")
    p = L.block(n, L.Model("k", (L.Rule(()),), ()), allow_cartesian=True)
    return p.select(F.col("k_l").alias("a"), F.col("k_r").alias("b"), K.predicate("geo_within_km:2000")(F.col("at_l"), F.col("at_r")).alias("agrees"))


@query(f"{_PAIR} SELECT record_key AS record_key_l, k2 AS record_key_r, false AS never, (given_name IS NULL OR given_name = '') AND (g2 IS NULL OR g2 = '') AS both, (given_name IS NULL OR given_name = '') OR (g2 IS NULL OR g2 = '') AS either FROM p")
def null_policies(spark, d):
    p = L.block(C.people(spark, d), L.Model("record_key", (L.Rule(("phone_e164",)),), ()))
    return p.select(*IDS, *(K.blank_match(x, F.col("given_name_l"), F.col("given_name_r")).alias(x) for x in ("never", "both", "either")))


_BEST = "best AS (SELECT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b, match_probability, id FROM match_scores WHERE is_active QUALIFY row_number() OVER (PARTITION BY least(rec_a_key, rec_b_key), greatest(rec_a_key, rec_b_key) ORDER BY match_probability DESC, id) = 1)"


@query(f"WITH {_BEST} SELECT a, b, match_probability, id FROM best")
def best_score_per_pair(spark, d):
    return Q.best_scores(table(spark, d, "match_scores"))


@query("SELECT n_nationkey AS child, n_regionkey + 100 AS ancestor, 1 AS hops FROM nation UNION ALL SELECT r_regionkey + 100, 1000, 1 FROM region UNION ALL SELECT n_nationkey, 1000, 2 FROM nation")
def hierarchy_closure(spark, d):
    """Nations under regions under the world."""
    links = table(spark, d, "nation").selectExpr("n_nationkey AS child", "n_regionkey + 100 AS parent").unionByName(table(spark, d, "region").selectExpr("r_regionkey + 100 AS child", "1000 AS parent"))
    return G.closure(links)


@query("SELECT s_suppkey AS a, n_nationkey::BIGINT AS b FROM supplier JOIN nation ON s_suppkey % 25 = n_regionkey WHERE s_nationkey <> n_nationkey")
def block_hierarchy_excluded(spark, d):
    """Supplier-nation pairs without those in which the supplier belongs to the nation."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    pairs = s.join(n, F.col("s_suppkey") % 25 == F.col("n_regionkey")).selectExpr("s_suppkey AS a", "cast(n_nationkey AS bigint) AS b")
    return G.without_relatives(pairs, s.selectExpr("s_suppkey AS child", "cast(s_nationkey AS bigint) AS ancestor", "1 AS hops"))


@query(f"WITH {STD} SELECT l.record_key AS record_key_l, r.record_key AS record_key_r FROM std l JOIN std r ON l.phone_e164 = r.phone_e164 WHERE l.record_key < r.record_key AND NOT EXISTS (SELECT 1 FROM match_scores m WHERE m.is_active AND least(rec_a_key, rec_b_key) = l.record_key AND greatest(rec_a_key, rec_b_key) = r.record_key)")
def cascade_antijoin(spark, d):
    """Pairs of a later rule set that no earlier one scored."""
    later = _block(spark, d, (L.Rule(("phone_e164",)),)).drop("match_key")
    done = table(spark, d, "match_scores").filter("is_active").select(F.least("rec_a_key", "rec_b_key").alias("record_key_l"), F.greatest("rec_a_key", "rec_b_key").alias("record_key_r"))
    return later.join(done, IDS, "left_anti")


@query(f"WITH {STD}, mem AS (SELECT record_key, entity_id FROM entity_membership QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY assigned_at DESC NULLS LAST, id DESC) = 1), x AS (SELECT std.*, entity_id FROM std JOIN mem USING (record_key)) SELECT l.entity_id, l.record_key AS record_key_l, r.record_key AS record_key_r FROM x l JOIN x r ON l.entity_id = r.entity_id WHERE l.record_key < r.record_key AND l.birth_date <> r.birth_date")
def constraint_violations(spark, d):
    """Pairs inside one entity whose birth dates differ."""
    x = C.members(spark, d).select("record_key", "entity_id", "birth_date")
    return L.block(x, L.Model("record_key", (L.Rule(("entity_id",), "birth_date_l <> birth_date_r"),), ())).select(F.col("entity_id_l").alias("entity_id"), *IDS)


@query(f"WITH {STD}, n AS (SELECT source_system, count(*) AS n FROM std GROUP BY 1) SELECT (((SELECT sum(n) FROM n) ** 2 - (SELECT sum(n * n) FROM n)) / 2)::BIGINT AS total")
def total_comparisons(spark, d):
    return T.total_comparisons(C.people(spark, d).withColumn("source_dataset", F.col("source_system")), "link_only")


@query(f"WITH {STD}, p AS (SELECT count(*) AS pairs FROM std l JOIN std r ON l.email = r.email AND l.birth_date = r.birth_date WHERE l.record_key < r.record_key), t AS (SELECT count(*) * (count(*) - 1) / 2 AS total FROM std) SELECT pairs, round(pairs / 0.7 / total, 9) AS prior FROM p, t")
def prior(spark, d):
    return T.prior(C.people(spark, d), [L.Rule(("email", "birth_date"))], "record_key", 0.7).withColumn("prior", F.round("prior", 9))


_SUP = L.Model("s_suppkey", (L.Rule(("s_nationkey",)),), (L.Comparison("s_nationkey", (L.Level("exact"),)), L.Comparison("s_acctbal", (L.Level("numeric_within:100"), L.Level("numeric_within:1000")))))


@query("""WITH p AS (SELECT CASE WHEN l.s_nationkey = r.s_nationkey THEN 1 ELSE 0 END AS g1, CASE WHEN abs(l.s_acctbal - r.s_acctbal) <= 100 THEN 2 WHEN abs(l.s_acctbal - r.s_acctbal) <= 1000 THEN 1 ELSE 0 END AS g2 FROM supplier l JOIN supplier r ON l.s_suppkey < r.s_suppkey)
    SELECT 's_nationkey' AS comparison, g1 AS gamma, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS u FROM p GROUP BY g1 UNION ALL SELECT 's_acctbal', g2, count(*), round(count(*) / (SELECT count(*) FROM p), 6) FROM p GROUP BY g2""")
def u_full(spark, d):
    """u from all pairs of suppliers, however many there are; the pairs grow with their square."""
    return T.estimate_u(table(spark, d, "supplier"), _SUP, float("inf")).withColumn("u", r6("u"))


@query()
def u_sampled(spark, d):
    """u from the pairs of a sample of suppliers, about 1e7 pairs at most."""
    return T.estimate_u(table(spark, d, "supplier"), _SUP, 1e7).withColumn("u", r6("u"))


@query(f"WITH {STD}, {C.pairs_sql()} SELECT {_G}, count(*) AS n FROM pairs GROUP BY ALL")
def agreement_patterns(spark, d):
    df = C.people(spark, d)
    return T.patterns(L.vectors(L.block(df, C.PLAIN), C.PLAIN), C.PLAIN)


_LAB = f"WITH {STD}, mem AS (SELECT record_key, entity_id FROM entity_membership QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY assigned_at DESC NULLS LAST, id DESC) = 1), x AS (SELECT std.*, entity_id FROM std JOIN mem USING (record_key)), p AS (SELECT {', '.join(f'{C.gamma_sql(c)} AS gamma_{c}' for c in C.LEVEL_SQL)} FROM x l JOIN x r ON l.entity_id = r.entity_id WHERE l.record_key < r.record_key)"


@query(_LAB + " " + " UNION ALL ".join(f"SELECT '{c}' AS comparison, gamma_{c} AS gamma, count(*) AS n, round(count(*) / (SELECT count(*) FROM p WHERE gamma_{c} >= 0), 6) AS m FROM p WHERE gamma_{c} >= 0 GROUP BY gamma_{c}" for c in C.LEVEL_SQL))
def m_from_labels(spark, d):
    return T.m_from_column(C.members(spark, d).select(*C.PEOPLE, "entity_id"), C.PLAIN, "entity_id").withColumn("m", r6("m"))


@query()
def em_session(spark, d):
    """Expectation-maximisation on the pairs of one rule, as a table of the trained model."""
    got = T.em_session(C.people(spark, d), C.PLAIN, L.Rule(("email",)))
    m = T.trained(C.PLAIN, {k: list(zip(*v)) for k, v in got["levels"].items()}, got["prior"])
    return T.report(spark, m).withColumn("prior", F.lit(float(got["prior"])))


# A model compiled from declared fields: a group of contacts, blanks of the given name as agreement
_FIELDS = {"given_name": M.Field(("exact", "first_n:3"), 40.0, blank="both"), "contact": M.Field(("exact",), 35.0, attributes=("email", "phone_e164")), "birth_date": M.Field(("exact",), 25.0)}
_DECLARED = M.compiled("record_key", [L.Rule(("family_name", "birth_date"))], _FIELDS, 0.001)
_ANY = "(" + " OR ".join(f"coalesce(l.{a} = r.{b}, false)" for a in ("email", "phone_e164") for b in ("email", "phone_e164")) + ")"
_SURE = "l.family_name = r.family_name AND l.birth_date = r.birth_date"


def _bits_sql(c: L.Comparison) -> str:
    mu = L._mu(c)
    return f"CASE gamma_{c.column} WHEN -1 THEN 0::DOUBLE " + " ".join(f"WHEN {len(c.levels) - i} THEN {L.bits(m, u)!r}::DOUBLE" for i, (m, u) in enumerate(mu)) + " END"


_PAIRS = f"""p AS (SELECT l.record_key AS record_key_l, r.record_key AS record_key_r, CASE WHEN l.given_name IS NULL AND r.given_name IS NULL THEN 3 WHEN l.given_name IS NULL OR r.given_name IS NULL THEN -1 WHEN l.given_name = r.given_name THEN 2 WHEN substr(l.given_name, 1, 3) = substr(r.given_name, 1, 3) THEN 1 ELSE 0 END AS gamma_given_name,
    CASE WHEN (l.email IS NULL AND l.phone_e164 IS NULL) OR (r.email IS NULL AND r.phone_e164 IS NULL) THEN -1 WHEN {_ANY} THEN 1 ELSE 0 END AS gamma_contact, CASE WHEN l.birth_date IS NULL OR r.birth_date IS NULL THEN -1 WHEN l.birth_date = r.birth_date THEN 1 ELSE 0 END AS gamma_birth_date
    FROM std l JOIN std r ON l.record_key < r.record_key AND (({_SURE}) OR {_ANY}))"""


@query(f"WITH {STD}, {_PAIRS}, w AS (SELECT *, {math.log2(0.001 / 0.999)!r}::DOUBLE + " + " + ".join(_bits_sql(c) for c in _DECLARED.comparisons) + " AS mw FROM p) SELECT record_key_l, record_key_r, gamma_given_name, gamma_contact, round(mw, 6) AS match_weight FROM w")
def predict_compiled(spark, d):
    """Scores of a model compiled from declared weights, with a cross-field group that also makes pairs."""
    x = L.predict(C.people(spark, d), _DECLARED)
    return x.select(*IDS, "gamma_given_name", "gamma_contact", r6("match_weight").alias("match_weight"))


_BARE = L.Model("record_key", (L.Rule(("email",)),), tuple(L.Comparison(c.column, tuple(L.Level(x.token) for x in c.levels)) for c in C.COMPARISONS[:3]), 0.001)


@query(f"WITH {STD}, {C.pairs_sql(rules=['l.email = r.email'])}, w AS (SELECT *, {math.log2(0.001 / 0.999)!r}::DOUBLE + " + " + ".join(_bits_sql(c) for c in _BARE.comparisons) + " AS mw FROM pairs) SELECT record_key_l, record_key_r, round(mw, 6) AS match_weight FROM w")
def predict_defaults(spark, d):
    """Scores of a model nobody has trained."""
    return L.predict(C.people(spark, d), _BARE).select(*IDS, r6("match_weight").alias("match_weight"))


@query(_LAB.replace("l.entity_id = r.entity_id WHERE l.record_key < r.record_key", "l.entity_id = r.entity_id AND l.email = r.email WHERE l.record_key < r.record_key") + " " + " UNION ALL ".join(f"SELECT '{c}' AS comparison, gamma_{c} AS gamma, count(*) AS n, round(count(*) / (SELECT count(*) FROM p WHERE gamma_{c} >= 0), 6) AS m FROM p WHERE gamma_{c} >= 0 GROUP BY gamma_{c}" for c in C.LEVEL_SQL))
def m_from_pair_labels(spark, d):
    """m from labelled pairs: here records of one entity with the same mailbox."""
    x = C.members(spark, d)
    pairs = L.block(x.select("record_key", "entity_id", "email"), L.Model("record_key", (L.Rule(("entity_id", "email")),), ())).select(*IDS)
    return T.m_from_pairs(x.select(*C.PEOPLE), C.PLAIN, pairs).withColumn("m", r6("m"))


@query(f"WITH {STD}, lab AS (SELECT DISTINCT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b FROM match_scores WHERE is_active AND rec_a_key <> rec_b_key), pairs AS (SELECT l.record_key AS record_key_l, r.record_key AS record_key_r, '0' AS match_key, {', '.join(f'{C.gamma_sql(c)} AS gamma_{c}' for c in C.LEVEL_SQL)} FROM lab JOIN std l ON l.record_key = a JOIN std r ON r.record_key = b), {C.weights_sql()} SELECT record_key_l, record_key_r, match_weight FROM scored")
def labelled_pairs_scored(spark, d):
    """A table of labelled pairs scored by the model, whichever way round they were given."""
    lab = table(spark, d, "match_scores").filter("is_active AND rec_a_key <> rec_b_key").select(F.col("rec_b_key").alias("record_key_l"), F.col("rec_a_key").alias("record_key_r"), F.lit(1.0).alias("clerical_match_score"))
    return E.labelled_by_table(C.people(spark, d), C.PLAIN, lab).select(*IDS, r6("match_weight").alias("match_weight"))


@query()
def train_model(spark, d):
    """The trained model's levels: prior from sure rules, u from random pairs, m by two EM sessions."""
    model, _ = T.train(C.people(spark, d), C.PLAIN, [L.Rule(("email", "birth_date"))], 0.7, [L.Rule(("email",)), L.Rule(("family_name", "birth_date"))], 1e5)
    return T.report(spark, model).withColumn("prior", F.lit(float(model.prior))).withColumn("full_agreement", F.lit(T.full_agreement_bits(model)))


@query("SELECT s_suppkey AS id, s_name AS name, 'one' AS source_dataset FROM supplier")
def concat_single(spark, d):
    return L.concat({"one": table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")})


@query()
def run_all(spark, d):
    """Deliveries to golden records in one plan."""
    from kinweave.plans import pipeline

    return pipeline.run_all(table(spark, d, "raw_records_golden"), C.PLAIN, C.RANK, ["completeness", "recency", "source_priority"])


_REST = "source_system <> 'crm'"


@query(f"WITH {STD}, mem AS (SELECT record_key, entity_id FROM entity_membership QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY assigned_at DESC NULLS LAST, id DESC) = 1), old AS (SELECT * FROM std WHERE {_REST}), new AS (SELECT * FROM std WHERE source_system = 'crm'), {C.pairs_sql('old', 'new', 'true')}, {C.weights_sql()} SELECT record_key_r AS probe, record_key_l AS record_key, entity_id, floor(100 * mp)::BIGINT AS confidence, CASE WHEN mp >= 0.95 THEN 'auto_merge' WHEN mp >= 0.6 THEN 'review' ELSE 'reject' END AS band FROM (SELECT *, 1 / (1 + pow(2, -mw)) AS mp FROM scored) LEFT JOIN mem ON mem.record_key = record_key_l WHERE mp >= 0.6")
def resolve_records(spark, d):
    """Which entities the records of one source may be, given those of the others."""
    from kinweave.plans import pipeline

    df = C.people(spark, d)
    return pipeline.resolve_one(df.filter("source_system = 'crm'"), df.filter(_REST), C.membership(spark, d), C.PLAIN)


@query(f"WITH {STD}, {C.pairs_sql()}, {C.weights_sql()}, a AS (SELECT record_key_l AS a, record_key_r AS b, 0 AS member FROM scored WHERE match_key = '1' OR (match_key = '0' AND gamma_email = 2)), x AS (SELECT l.record_key AS a, r.record_key AS b FROM std l JOIN std r ON l.phone_e164 = r.phone_e164 WHERE l.record_key < r.record_key) SELECT a, b, member FROM a UNION ALL SELECT a, b, 1 FROM x WHERE (a, b) NOT IN (SELECT (a, b) FROM a)")
def ensemble_cascade(spark, d):
    """Two models in a cascade: pairs by e-mail, then pairs by phone that the first didn't take."""
    from kinweave.plans import pipeline

    first, second = (L.Model("record_key", (L.Rule((k,)),), C.PLAIN.comparisons, C.PLAIN.prior) for k in ("email", "phone_e164"))
    return pipeline.ensemble(C.people(spark, d), [(first, 0.0), (second, 0.0)]).select("a", "b", "member")
