"""Read paths, accounts, estimates, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import evaluate as E
from kinweave.operators import golden as N
from kinweave.operators import graph as G
from kinweave.operators import linkage as L
from kinweave.operators import reads as V
from kinweave.operators import standardize as S
from kinweave.plans import common as C
from kinweave.plans import entity_queries as Y
from kinweave.plans import record_queries as X
from kinweave.plans.registry import MEMBERS, STD, query
from kinweave.session import cut, table
from kinweave.sources.readers import register_table


@query(f"WITH {MEMBERS}, k AS (SELECT DISTINCT rec_a_key AS record_key FROM match_scores) SELECT record_key, entity_id FROM k LEFT JOIN mem USING (record_key)")
def entity_of_records(spark, d):
    return V.entity_of(C.membership(spark, d), table(spark, d, "match_scores").select(F.col("rec_a_key").alias("record_key")))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND event_id > 100 ORDER BY event_id LIMIT 40")
def events_page(spark, d):
    """A page of one type of events behind the last seen."""
    _, after = V.decode_cursor(V.encode_cursor(1, [100]))
    return V.page(table(spark, d, "events").filter("event_type = 'click'"), ["event_id"], after, 40).select("event_id", "event_type", "value")


@query("SELECT rec_a_key, rec_b_key, id, match_probability FROM match_scores WHERE match_probability >= 0.6 AND match_probability < 0.95 AND (rec_a_key > 'c' OR (rec_a_key = 'c' AND rec_b_key > 'd') OR (rec_a_key = 'c' AND rec_b_key = 'd' AND id > 'e')) ORDER BY rec_a_key, rec_b_key, id LIMIT 30")
def reviews_page(spark, d):
    s = table(spark, d, "match_scores").filter("match_probability >= 0.6 AND match_probability < 0.95")
    return V.page(s, ["rec_a_key", "rec_b_key", "id"], ["c", "d", "e"], 30).select("rec_a_key", "rec_b_key", "id", "match_probability")


@query(f"WITH {STD} SELECT record_key, given_name FROM std WHERE given_name ILIKE '%an%' OR email ILIKE '%!_a%' ESCAPE '!'")
def contains_search(spark, d):
    return C.std(spark, d).filter(V.contains(F.col("given_name"), "AN") | V.contains(F.col("email"), "_a")).select("record_key", "given_name")


@query("SELECT subject, source_system, id, row_count FROM profile_runs WHERE subject IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject, source_system ORDER BY captured_at DESC NULLS LAST, id DESC NULLS LAST) = 1")
def profile_latest(spark, d):
    """The last profile run of each subject and source."""
    runs = table(spark, d, "profile_runs").filter("subject IS NOT NULL").distinct()
    return V.latest_run(runs, ["subject", "source_system"]).select("subject", "source_system", "id", "row_count")


@query(f"WITH {STD}, {MEMBERS} SELECT 'records' AS check, count(*) AS n FROM std UNION ALL SELECT 'invalid e-mails', count(*) FILTER (WHERE NOT email_valid) FROM std UNION ALL SELECT 'members without a record', count(*) FROM mem WHERE record_key NOT IN (SELECT record_key FROM std) UNION ALL SELECT 'active scores', count(*) FILTER (WHERE is_active) FROM match_scores")
def health_report(spark, d):
    std, mem = C.std(spark, d), C.membership(spark, d)
    lost = mem.join(std.select("record_key"), "record_key", "left_anti")
    return V.health({"records": (std, None), "invalid e-mails": (std, ~F.col("email_valid")), "members without a record": (lost, None), "active scores": (table(spark, d, "match_scores"), F.col("is_active"))})


@query("SELECT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b, row_number() OVER (ORDER BY least(rec_a_key, rec_b_key), greatest(rec_a_key, rec_b_key)) - 1 AS edge_id FROM (SELECT DISTINCT least(rec_a_key, rec_b_key) AS rec_a_key, greatest(rec_a_key, rec_b_key) AS rec_b_key FROM match_scores)")
def edge_numbers(spark, d):
    e = table(spark, d, "match_scores").select(F.least("rec_a_key", "rec_b_key").alias("a"), F.greatest("rec_a_key", "rec_b_key").alias("b")).distinct()
    return V.edge_ids(e).select("a", "b", "edge_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def registered_table(spark, d):
    """A relation under a name, read by SQL."""
    register_table(table(spark, d, "nation"), "kinweave_nation")
    return spark.sql("SELECT n_nationkey, n_name FROM kinweave_nation WHERE n_regionkey = 1")


@query(f"WITH {STD}, " + ", ".join(f"b{i} AS (SELECT count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in r.keys)}) AS filled FROM std)" for i, r in enumerate(C.RULES)) + ", k AS (" + " UNION ALL ".join(f"SELECT '{i}' AS match_key, coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS pairs_alone, coalesce(max(n), 0) AS largest_block FROM (SELECT count(*) AS n FROM std WHERE {' AND '.join(f'{c} IS NOT NULL' for c in r.keys)} GROUP BY {', '.join(r.keys)})" for i, r in enumerate(C.RULES)) + f"), {C.pairs_sql()}, g AS (SELECT match_key, count(*) AS pairs FROM pairs GROUP BY 1) SELECT k.match_key, pairs_alone, largest_block, coalesce(pairs, 0) AS pairs FROM k LEFT JOIN g USING (match_key)")
def blocking_estimate(spark, d):
    """What each rule costs: its pairs and largest block alone, and the pairs it adds to the rules before it."""
    df = C.people(spark, d)
    alone = E.rank_keys(df, {str(i): list(r.keys) for i, r in enumerate(C.RULES)}).select(F.col("key").alias("match_key"), F.col("expected_pairs").alias("pairs_alone"), "largest_block")
    return alone.join(E.block_counts(df, C.PLAIN).select("match_key", "pairs"), "match_key")


@query(f"WITH {STD}, {C.pairs_sql()}, {C.weights_sql()} SELECT record_key_l, record_key_r, match_weight FROM scored")
def predict_to_store(spark, d):
    """Scores written to a table chunk by chunk, each an append of its own."""
    s = X._store(spark)
    L.predict_to_store(C.people(spark, d), C.PLAIN, 3, s, "scores")
    return s.read("scores").select("record_key_l", "record_key_r", F.round("match_weight", 6).alias("match_weight"))


# Accounts: suppliers and customers as two sources of organisations
_ACCOUNTS = "acc AS (SELECT 'supplier' AS source_system, s_suppkey::VARCHAR AS id, s_name AS name, 'https://www.' || s_name || '.example/' AS site FROM supplier UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name, 'https://www.' || c_name || '.example/' FROM customer)"
_ACC_STD = f"{_ACCOUNTS}, std AS (SELECT source_system || ':' || id AS record_key, source_system, n AS company_name, norm AS company_name_norm, dom AS domain_norm FROM (SELECT *, {X._ns(X._lt('name'))} AS n, {X._CO_NORM.replace('(n)', '(name)')} AS norm, {X._ns('nullif(' + X._DOMAIN.format(X._lt('site')) + chr(44) + chr(39) * 2 + ')')} AS dom FROM acc))"


def _accounts(spark, d):
    a = table(spark, d, "supplier").selectExpr("'supplier' AS source_system", "cast(s_suppkey AS string) AS id", "s_name AS name", "concat('https://www.', s_name, '.example/') AS site")
    b = table(spark, d, "customer").selectExpr("'customer' AS source_system", "cast(c_custkey AS string) AS id", "c_name AS name", "concat('https://www.', c_name, '.example/') AS site")
    return S.account(a.unionByName(b), "id", {"company_name": "name", "domain": "site"})


@query(f"WITH {_ACC_STD} SELECT record_key, source_system, company_name, company_name_norm, domain_norm FROM std")
def account_std(spark, d):
    return _accounts(spark, d).select("record_key", "source_system", "company_name", "company_name_norm", "domain_norm")


@query(f"WITH {_ACC_STD}, x AS (SELECT *, regexp_extract(company_name_norm, '[1-9][0-9]*$') AS entity_id FROM std), r AS (SELECT *, CASE source_system WHEN 'supplier' THEN 1 WHEN 'customer' THEN 2 END AS rank FROM x) {Y._decision_sql('company_name', ['completeness', 'source_priority'])}")
def account_lineage(spark, d):
    """Survivors of accounts: here those of one number are one organisation."""
    x = cut(_accounts(spark, d).withColumn("entity_id", F.regexp_extract("company_name_norm", "[1-9][0-9]*$", 0)))
    return N.lineage(x, {"company_name": ["completeness", "source_priority"]}, {"supplier": 1, "customer": 2})


@query(f"WITH RECURSIVE {Y._E.format(t=0.97)}, {Y._REACH}, {STD}, x AS (SELECT std.*, coalesce(cluster, record_key) AS entity_id FROM std LEFT JOIN cl ON node = record_key), r AS (SELECT *, CASE source_system WHEN 'crm' THEN 1 WHEN 'billing' THEN 2 WHEN 'webforms' THEN 3 END AS rank FROM x) {Y._decision_sql('email', Y._CHAIN)}")
def correction_pass(spark, d):
    """Stored scores grouped again at another threshold and assembled anew, without scoring anything."""
    cl = G.components(Y._edges(spark, d, 0.97), nodes=C.std(spark, d).select("record_key")).select(F.col("node").alias("record_key"), F.col("cluster").alias("entity_id"))
    members = cut(C.std(spark, d).join(cl, "record_key"))
    return N.lineage(members, {"email": Y._CHAIN}, C.RANK)
