"""Graphs, identity, golden records, quality, evaluation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import evaluate as E
from kinweave.operators import golden as N
from kinweave.operators import graph as G
from kinweave.operators import identity as I
from kinweave.operators import linkage as L
from kinweave.operators import profile as P
from kinweave.operators import quality as Q
from kinweave.plans import common as C
from kinweave.plans.registry import MEMBERS, STD, query
from kinweave.session import cut, table

r6 = lambda c: F.round(c, 6)

# Graph of matched pairs -------------------------------------------------------------------------
_E = "e AS (SELECT DISTINCT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b FROM match_scores WHERE is_active AND match_probability >= {t} AND rec_a_key <> rec_b_key), ends AS (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e)"
_REACH = "reach AS (SELECT DISTINCT v AS root, v FROM ends UNION SELECT r.root, n.w FROM reach r JOIN ends n ON n.v = r.v WHERE r.root < n.w), cl AS (SELECT v AS node, min(root) AS cluster FROM reach GROUP BY v)"


def _edges(spark, d, t=0.99):
    s = table(spark, d, "match_scores").filter(F.col("is_active") & (F.col("match_probability") >= t) & (F.col("rec_a_key") != F.col("rec_b_key")))
    return s.groupBy(F.least("rec_a_key", "rec_b_key").alias("a"), F.greatest("rec_a_key", "rec_b_key").alias("b")).agg(F.max("match_probability").alias("p"))


@query(f"WITH RECURSIVE {_E.format(t=0.99)}, {_REACH} SELECT node, cluster FROM cl")
def components(spark, d):
    return G.components(_edges(spark, d))


@query(f"WITH RECURSIVE {_E.format(t=0.97)}, {_REACH} SELECT node, cluster FROM cl")
def components_incremental(spark, d):
    """Clusters of the strong links, then the weaker ones added: equal to clustering all at once."""
    e = cut(_edges(spark, d, 0.97))
    return G.components_incremental(cut(G.components(e.filter("p >= 0.995"))), e.filter("p < 0.995").select("a", "b"))


@query(f"WITH RECURSIVE {_E.format(t=0.99)}, {_REACH}, deg AS (SELECT v, count(*) AS degree FROM ends GROUP BY v), s AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1) SELECT node, cluster, degree, round(degree / (n - 1), 6) AS centrality FROM cl JOIN deg ON v = node JOIN s USING (cluster)")
def node_metrics(spark, d):
    e = cut(_edges(spark, d))
    return G.node_metrics(e, cut(G.components(e))).withColumn("centrality", r6("centrality"))


@query(f"""WITH RECURSIVE {_E.format(t=0.99)}, {_REACH}, deg AS (SELECT v, count(*) AS g FROM ends GROUP BY v), m AS (SELECT cluster, count(*) AS n, sum(g) AS d, max(g) AS top FROM cl JOIN deg ON v = node GROUP BY 1)
    SELECT cluster, n AS n_nodes, (d // 2)::BIGINT AS n_edges, round(d / (n * (n - 1)), 6) AS density, CASE WHEN n > 2 THEN round((n * top - d) / ((n - 1) * (n - 2)), 6) END AS centralisation FROM m""")
def cluster_metrics(spark, d):
    e = cut(_edges(spark, d))
    return G.cluster_metrics(e, cut(G.components(e))).withColumn("density", r6("density")).withColumn("centralisation", r6("centralisation"))


@query()
def bridges(spark, d):
    e = cut(_edges(spark, d))
    return G.bridges(e, cut(G.components(e)))


@query()
def threshold_summary(spark, d):
    e = cut(_edges(spark, d, 0.9))
    nodes = e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct()
    return G.threshold_summary(e, nodes, [0.9, 0.95, 0.99])


def _sided(spark, d):
    src = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return cut(_edges(spark, d, 0.95).withColumn("sa", src("a")).withColumn("sb", src("b")))


@query()
def single_best_links(spark, d):
    return G.single_best_links(_sided(spark, d), sources=["crm"])


_SIDED = "e AS (SELECT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b, max(match_probability) AS p FROM match_scores WHERE is_active AND match_probability >= 0.95 AND rec_a_key <> rec_b_key GROUP BY 1, 2)"
_NEAR = "n AS (SELECT a AS node_id, b AS neighbour, split_part(a, ':', 1) AS source_dataset_l, split_part(b, ':', 1) AS source_dataset_r, p AS match_probability FROM e UNION ALL SELECT b, a, split_part(b, ':', 1), split_part(a, ':', 1), p FROM e)"


@query(f"""WITH {_SIDED}, {_NEAR}, l AS (SELECT node_id, source_dataset_l, source_dataset_r, match_probability, CASE WHEN count(DISTINCT neighbour) > 1 AND source_dataset_r IN ('crm', 'webforms') THEN 1 ELSE 0 END AS tie_l FROM n GROUP BY node_id, source_dataset_l, source_dataset_r, match_probability),
    r AS (SELECT neighbour, source_dataset_l, source_dataset_r, match_probability, CASE WHEN count(DISTINCT node_id) > 1 AND source_dataset_l IN ('crm', 'webforms') THEN 1 ELSE 0 END AS tie_r FROM n GROUP BY neighbour, source_dataset_l, source_dataset_r, match_probability)
    SELECT n.node_id AS a, n.neighbour AS b, n.match_probability AS p FROM n JOIN l USING (node_id, source_dataset_l, source_dataset_r, match_probability) JOIN r ON n.neighbour = r.neighbour AND n.source_dataset_l = r.source_dataset_l AND n.source_dataset_r = r.source_dataset_r AND n.match_probability = r.match_probability WHERE tie_l = 0 AND tie_r = 0 AND n.node_id < n.neighbour""")
def drop_ties(spark, d):
    return G.drop_ties(_sided(spark, d), ["crm", "webforms"]).select("a", "b", "p")


@query(f"WITH RECURSIVE {_E.format(t=0.99)}, {_REACH}, {STD} SELECT record_key, coalesce(cluster, record_key) AS cluster FROM std LEFT JOIN cl ON node = record_key")
def attach_clusters(spark, d):
    cl = G.components(_edges(spark, d))
    s = C.std(spark, d).select("record_key")
    return s.join(cl.withColumnRenamed("node", "record_key"), "record_key", "left").select("record_key", F.coalesce("cluster", "record_key").alias("cluster"))


_EP = "ep AS (SELECT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b, max(match_probability) AS p FROM match_scores WHERE is_active AND match_probability >= 0.99 AND rec_a_key <> rec_b_key GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_E.format(t=0.99)}, {_REACH}, {_EP}, x AS (SELECT a AS record, p FROM ep UNION ALL SELECT b, p FROM ep), best AS (SELECT cluster, record, max(p) AS attachment FROM x JOIN cl ON node = record GROUP BY 1, 2)
    SELECT cluster, record, attachment, row_number() OVER (PARTITION BY cluster ORDER BY attachment DESC, record) = 1 AS is_master, round(avg(attachment) OVER (PARTITION BY cluster), 6) AS group_score FROM best""")
def group_confidence(spark, d):
    e = cut(_edges(spark, d))
    return E.group_scores(e, cut(G.components(e))).withColumn("group_score", r6("group_score"))


# Identity ---------------------------------------------------------------------------------------
def _assertions(spark, d):
    """Always: scored 0.999 and more; never: pairs withdrawn or scored low."""
    s = table(spark, d, "match_scores").filter("rec_a_key <> rec_b_key").select(F.least("rec_a_key", "rec_b_key").alias("a"), F.greatest("rec_a_key", "rec_b_key").alias("b"), "match_probability")
    always = s.filter("match_probability >= 0.999").select("a", "b", F.lit("always").alias("kind"))
    return always.unionByName(s.filter("match_probability < 0.5").select("a", "b", F.lit("never").alias("kind"))).distinct()


@query("""WITH RECURSIVE s AS (SELECT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b, match_probability AS p FROM match_scores WHERE rec_a_key <> rec_b_key), e AS (SELECT DISTINCT a, b FROM s WHERE p >= 0.999), ends AS (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e),
    """ + _REACH + " SELECT DISTINCT a, b FROM s JOIN cl x ON x.node = a JOIN cl y ON y.node = b WHERE p < 0.5 AND x.cluster = y.cluster")
def contradictions(spark, d):
    return I.contradictions(_assertions(spark, d))


@query()
def never_cuts(spark, d):
    e = _edges(spark, d, 0.95).withColumn("protected", F.col("p") >= 0.9999)
    nevers = table(spark, d, "match_scores").filter("rec_a_key <> rec_b_key AND match_probability < 0.3").select(F.col("rec_a_key").alias("a"), F.col("rec_b_key").alias("b"))
    return I.never_cuts(cut(e), nevers)


_OLDNEW = f"WITH RECURSIVE {MEMBERS}, {_E.format(t=0.99)}, {_REACH}, old AS (SELECT record_key, entity_id FROM mem), new AS (SELECT node AS record_key, cluster AS grp FROM cl)"
_SHARED = "sh AS (SELECT entity_id, grp, count(*) AS n FROM old JOIN new USING (record_key) GROUP BY 1, 2), offer AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, grp) = 1), kept AS (SELECT * FROM offer QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, entity_id) = 1), plan AS (SELECT g.grp, coalesce(entity_id, sha256('entity:' || least_key)) AS entity_id, entity_id IS NULL AS minted FROM (SELECT grp, min(record_key) AS least_key FROM new GROUP BY 1) g LEFT JOIN kept USING (grp))"


def _old_new(spark, d):
    new = cut(G.components(_edges(spark, d)).select(F.col("node").alias("record_key"), F.col("cluster").alias("group")))
    return C.membership(spark, d).select("record_key", "entity_id"), new


@query(f'{_OLDNEW}, {_SHARED} SELECT grp AS "group", entity_id, minted FROM plan')
def reconcile_plan(spark, d):
    return I.reconcile(*_old_new(spark, d))


@query(f"{_OLDNEW}, {_SHARED} SELECT entity_id, grp AS \"group\", n FROM sh")
def reconcile_overlap(spark, d):
    old, new = _old_new(spark, d)
    return old.join(new, "record_key").groupBy("entity_id", "group").agg(F.count(F.lit(1)).alias("n"))


_EVENTS = f"""{_OLDNEW}, {_SHARED}, now AS (SELECT record_key, entity_id FROM new JOIN plan USING (grp)), mv AS (SELECT record_key, old.entity_id AS b, now.entity_id AS a FROM old FULL JOIN now USING (record_key)),
    be AS (SELECT DISTINCT entity_id AS x FROM old), ne AS (SELECT DISTINCT entity_id AS x FROM now), gone AS (SELECT x FROM be ANTI JOIN ne USING (x)), merged AS (SELECT DISTINCT b AS x FROM mv WHERE a IS NOT NULL AND b IN (SELECT x FROM gone))
    SELECT 'created' AS event_type, x AS entity_id, NULL::VARCHAR AS record_key FROM ne ANTI JOIN be USING (x) UNION ALL SELECT 'merged', x, NULL FROM merged UNION ALL SELECT 'retired', x, NULL FROM gone ANTI JOIN merged USING (x)
    UNION ALL SELECT 'split', b, NULL FROM (SELECT DISTINCT b FROM mv WHERE a <> b AND b IN (SELECT x FROM ne)) UNION ALL SELECT 'member_added', a, record_key FROM mv WHERE a IS NOT NULL AND a IS DISTINCT FROM b UNION ALL SELECT 'member_removed', b, record_key FROM mv WHERE b IS NOT NULL AND a IS DISTINCT FROM b"""
_HEAD, _, _TAIL = _EVENTS.partition("SELECT 'created'")


@query(_EVENTS)
def reconcile_events(spark, d):
    old, new = _old_new(spark, d)
    plan = cut(I.reconcile(old, new))
    return I.events(old, new.join(plan, "group").select("record_key", "entity_id"))


@query(f"WITH {MEMBERS} SELECT DISTINCT entity_id FROM (SELECT entity_id FROM golden_lineage UNION ALL SELECT entity_id FROM entity_membership UNION ALL SELECT 'never a member') WHERE entity_id NOT IN (SELECT entity_id FROM mem WHERE entity_id IS NOT NULL)")
def orphaned_entities(spark, d):
    """Entities that are known, from lineage or an earlier assignment, and have no member now."""
    known = table(spark, d, "golden_lineage").select("entity_id").unionByName(table(spark, d, "entity_membership").select("entity_id")).unionByName(spark.createDataFrame([("never a member",)], "entity_id string"))
    return known.filter("entity_id IS NOT NULL").distinct().join(C.membership(spark, d).select("entity_id"), "entity_id", "left_anti")


@query("WITH RECURSIVE r AS (SELECT o_orderkey AS entity_id, o_orderkey // 2 AS merged_into FROM orders WHERE o_orderkey > 0), w AS (SELECT entity_id, merged_into AS t FROM r UNION SELECT w.entity_id, r.merged_into FROM w JOIN r ON r.entity_id = w.t) SELECT entity_id, min(t) AS target FROM w GROUP BY 1")
def redirects_resolved(spark, d):
    return I.resolved(table(spark, d, "orders").filter("o_orderkey > 0").selectExpr("o_orderkey AS entity_id", "o_orderkey div 2 AS merged_into"))


@query("SELECT record_key, max_by(entity_id, (assigned_at, id)) AS entity_id FROM entity_membership WHERE record_key IS NOT NULL GROUP BY 1")
def membership_merge(spark, d):
    """Assignments of billing merged into the others', the later one of a key kept."""
    m = C.membership(spark, d).select("record_key", "entity_id", "source_system")
    return I.merge(m.filter("source_system <> 'billing'"), m.filter("source_system = 'billing'"), ["record_key"]).select("record_key", "entity_id")


# Golden records ---------------------------------------------------------------------------------
_X = f"WITH {STD}, {MEMBERS}, x AS (SELECT std.*, mem.entity_id FROM std JOIN mem USING (record_key)), r AS (SELECT *, CASE source_system WHEN 'crm' THEN 1 WHEN 'billing' THEN 2 WHEN 'webforms' THEN 3 ELSE 4 END AS rank"
_ON = {"numeric_max": "addr_number", "numeric_min": "addr_number", "validated": "email", "prioritized:xc|xa": "addr_region"}


def _terms_sql(rule: str) -> list[tuple[str, str]]:
    """The terms of a rule as the contract writes them."""
    return {
        "source_priority": [("rank", "ASC NULLS LAST")], "recency": [("coalesce(updated_at_source, ingested_at)", "DESC NULLS LAST")], "frequency": [("count(*) OVER (PARTITION BY entity_id, value)", "DESC")],
        "most_common": [("count(*) OVER (PARTITION BY entity_id, value)", "DESC")], "completeness": [("(value IS NOT NULL)", "DESC"), ("length(value)", "DESC NULLS LAST")], "validated": [("email_valid", "DESC NULLS LAST")],
        "longest": [("length(value)", "DESC NULLS LAST")], "shortest": [("length(value)", "ASC NULLS LAST")], "numeric_max": [("try_cast(value AS DOUBLE)", "DESC NULLS LAST")], "numeric_min": [("try_cast(value AS DOUBLE)", "ASC NULLS LAST")],
        "prioritized:xc|xa": [("CASE value WHEN 'xc' THEN 0 WHEN 'xa' THEN 1 ELSE 2147483647 END", "ASC")],
    }[rule]


def _decision_sql(attribute: str, rules: list[str], value: str | None = None) -> str:
    """Winner, value and deciding rule of one attribute over the common table r."""
    keys = [(r, f"k{i}_{j}", *t) for i, r in enumerate(rules) for j, t in enumerate(_terms_sql(r))]
    project = "".join(f", {e} AS {k}" for _, k, e, _ in keys)
    order = ", ".join([*(f"{k} {o}" for _, k, _, o in keys), "record_key"])
    arms = " ".join("WHEN " + " OR ".join(f"w.{k} IS DISTINCT FROM s.{k}" for q, k, _, _ in keys if q == r) + f" THEN '{r}'" for r in rules)
    return f"""SELECT w.entity_id, '{attribute}' AS attribute, w.record_key, w.value, CASE WHEN s.record_key IS NULL THEN 'tiebreak_deterministic' {arms} ELSE 'tiebreak_deterministic' END AS rule
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order}) AS rn FROM (SELECT *{project} FROM (SELECT *, {value or attribute + '::VARCHAR'} AS value FROM r))) w
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order}) AS rn FROM (SELECT *{project} FROM (SELECT *, {value or attribute + '::VARCHAR'} AS value FROM r))) s ON s.entity_id = w.entity_id AND s.rn = 2 WHERE w.rn = 1"""


_RULES = ["source_priority", "recency", "frequency", "most_common", "completeness", "validated", "longest", "shortest", "numeric_max", "numeric_min", "prioritized:xc|xa"]
for _rule in _RULES:
    query(f"{_X} FROM x) {_decision_sql(_ON.get(_rule, 'given_name'), [_rule])}", f"survivorship_{_rule.partition(':')[0]}")(
        lambda spark, d, r=_rule: N.decide(C.members(spark, d), _ON.get(r, "given_name"), [r], C.RANK, valid="email_valid" if r == "validated" else None)
    )


@query(f"WITH {STD}, {MEMBERS} SELECT entity_id, min(record_key) AS record_key, array_to_string(list_sort(list_distinct(list(email) FILTER (WHERE email IS NOT NULL AND email <> ''))), '; ') AS value, 'combined_list' AS rule FROM std JOIN mem USING (record_key) GROUP BY 1")
def combined_list(spark, d):
    return N.decide(C.members(spark, d), "email", ["combined_list"], C.RANK).select("entity_id", "record_key", "value", "rule")


@query(f"WITH {STD}, {MEMBERS} SELECT entity_id, min(record_key) AS record_key, sum(try_cast(addr_number AS DOUBLE))::BIGINT AS value FROM std JOIN mem USING (record_key) GROUP BY 1")
def survivorship_sum(spark, d):
    x = N.decide(C.members(spark, d), "addr_number", ["sum"], C.RANK)
    return x.select("entity_id", "record_key", F.col("value").cast("double").cast("long").alias("value"))


_CHAIN = ["completeness", "recency", "source_priority"]
_ALL = ["given_name", "family_name", "email", "phone_e164", "birth_date"]
_ADDRESS = ["addr_number", "addr_street", "addr_unit", "addr_city", "addr_region", "addr_postal"]
_ADDRESS_SQL = f"CASE WHEN coalesce({', '.join(_ADDRESS)}) IS NOT NULL THEN concat_ws(chr(31), " + ", ".join(f"coalesce({c}, '')" for c in _ADDRESS) + ") END"
_LINES = " UNION ALL ".join([*(_decision_sql(a, _CHAIN) for a in _ALL), _decision_sql("address", _CHAIN, _ADDRESS_SQL)])


def _lineage(spark, d):
    return N.lineage(C.members(spark, d), {a: _CHAIN for a in (*_ALL, "address")}, C.RANK, groups={"address": _ADDRESS})


@query(f"{_X} FROM x) {_LINES}")
def golden_lineage(spark, d):
    return _lineage(spark, d)


@query(f"{_X} FROM x), g AS ({_LINES}) SELECT entity_id, " + ", ".join(f"max(value) FILTER (attribute = '{a}') AS {a}" for a in (*_ALL, "address")) + " FROM g GROUP BY 1")
def golden_records(spark, d):
    return N.records(_lineage(spark, d), [*_ALL, "address"])


@query()
def nested_metadata(spark, d):
    return N.nested_metadata(C.members(spark, d))


@query(f"{_X} FROM x), g AS ({_decision_sql('email', _CHAIN)}), o AS (SELECT entity_id, max_by(record_key, (created_at, id)) AS v FROM golden_lineage WHERE attribute = 'email' GROUP BY 1) SELECT g.entity_id, CASE WHEN o.entity_id IS NOT NULL THEN o.v ELSE value END AS email FROM g LEFT JOIN o USING (entity_id)")
def golden_overrides(spark, d):
    """E-mails with the last override of each entity (here the donors named by an earlier assembly)."""
    g = N.records(N.lineage(C.members(spark, d), {"email": _CHAIN}, C.RANK), ["email"])
    o = table(spark, d, "golden_lineage").filter("attribute = 'email'").select("entity_id", "created_at", "id", F.col("record_key").alias("value"))
    return N.overridden(g, o, "email")


_COMPLETE = "(" + " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in N.SURVIVABLE) + ")"
_POLICY = {"source_priority": "coalesce(CASE source_system WHEN 'crm' THEN 1 WHEN 'billing' THEN 2 WHEN 'webforms' THEN 3 END, 2147483647) ASC", "most_recent": "coalesce(updated_at_source, ingested_at) DESC NULLS LAST", "oldest": "coalesce(updated_at_source, ingested_at) ASC NULLS LAST", "most_complete": f"{_COMPLETE} DESC"}
for _p, _o in _POLICY.items():
    query(f"{_X} FROM x) SELECT entity_id, record_key FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_o}, record_key) = 1", f"master_{_p}")(lambda spark, d, p=_p: N.masters(C.members(spark, d), p, C.RANK))


@query("SELECT entity_id, record_key FROM (SELECT entity_id, record_key, count(*) AS won FROM golden_lineage WHERE entity_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY won DESC, record_key NULLS LAST) = 1")
def master_most_attributes(spark, d):
    return N.masters(C.members(spark, d), "most_attributes", C.RANK, table(spark, d, "golden_lineage"))


@query(f"{_X} FROM x), m AS (SELECT entity_id, record_key AS master_key FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY rank, record_key) = 1) SELECT entity_id, master_key, record_key FROM x JOIN m USING (entity_id) WHERE record_key <> master_key")
def merge_plans(spark, d):
    x = C.members(spark, d)
    return N.merge_plans(x, N.masters(x, "source_priority", C.RANK))


# Quality ----------------------------------------------------------------------------------------


def _now():
    return F.lit("2025-04-01").cast("date")


_SIZES = f"WITH {STD}, {MEMBERS}, s AS (SELECT entity_id, count(*) AS n FROM mem GROUP BY 1)"


@query(_SIZES + " SELECT (SELECT count(*) FROM std) AS records, (SELECT count(*) FROM s) AS entities, (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM s) AS duplicate_records, (SELECT count(*) FILTER (n > 1) FROM s) AS duplicate_groups, (SELECT max(n) FROM s) AS largest_group, count(*) FILTER (match_probability >= 0.95) AS auto_merge, count(*) FILTER (match_probability >= 0.6 AND match_probability < 0.95) AS review, count(*) FILTER (match_probability < 0.6) AS reject FROM match_scores WHERE is_active")
def metric_snapshot(spark, d):
    return Q.snapshot(C.std(spark, d), C.membership(spark, d), table(spark, d, "match_scores"))


@query(_SIZES + " SELECT source_system, count(*) AS records, count(*) FILTER (n > 1) AS duplicate_records, count(DISTINCT entity_id) FILTER (n > 1) AS groups FROM mem JOIN s USING (entity_id) GROUP BY 1")
def source_metrics(spark, d):
    return Q.by_source(C.membership(spark, d))


_QC = {"given_name": 1.0, "family_name": 1.0, "email": 2.0, "phone_e164": 1.5, "addr_street": 1.0, "birth_date": 0.5}
_FRESH, _STALE = 30, 365
_PRESENT = " + ".join(f"CASE WHEN {c} IS NOT NULL AND length(trim({c}::VARCHAR)) > 0 THEN {w}::DOUBLE ELSE 0::DOUBLE END" for c, w in _QC.items())
_JUDGED, _PASSED = (" + ".join(f"CASE WHEN {v} IS NOT NULL AND {t.format(f)} THEN 1.0::DOUBLE ELSE 0::DOUBLE END" for v, f in (("email", "email_valid"), ("phone_e164", "phone_valid"))) for t in ("{} IS NOT NULL", "{}"))
_QUAL = f"""WITH {STD}, dims AS (SELECT record_key, ({_PRESENT}) / {sum(_QC.values())}::DOUBLE AS completeness, CASE WHEN ({_JUDGED}) > 0 THEN ({_PASSED}) / ({_JUDGED}) END AS validity,
    CASE WHEN updated_at_source IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_STALE}::DOUBLE - date_diff('day', updated_at_source, TIMESTAMP '2025-04-01')) / {_STALE - _FRESH}::DOUBLE)) END AS freshness FROM std),
    q AS (SELECT *, 100.0::DOUBLE * (0.5::DOUBLE * completeness + coalesce(0.3::DOUBLE * validity, 0) + coalesce(0.2::DOUBLE * freshness, 0)) / (0.5::DOUBLE + CASE WHEN validity IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN freshness IS NULL THEN 0 ELSE 0.2::DOUBLE END) AS score FROM dims)"""
_PARTS = ["completeness", "validity", "freshness", "score"]


def _quality(spark, d):
    return Q.record_quality(C.std(spark, d), _QC, _now(), _FRESH, _STALE)


@query(_QUAL + " SELECT record_key, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PARTS) + " FROM q")
def record_quality(spark, d):
    return _quality(spark, d).select("record_key", *(r6(c).alias(c) for c in _PARTS))


@query(_QUAL + """, q6 AS (SELECT * REPLACE (round(score, 6) AS score) FROM q) SELECT count(*) AS scored, round(avg(score), 4) AS mean_score, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (WHERE score < 50) AS below_50, count(*) FILTER (WHERE score >= 50 AND score < 80) AS between_50_80,
    count(*) FILTER (WHERE score >= 80) AS at_least_80, round(avg(completeness), 4) AS mean_completeness, round(avg(validity), 4) AS mean_validity, round(avg(freshness), 4) AS mean_freshness FROM q6""")
def quality_distribution(spark, d):
    x = Q.distribution(_quality(spark, d).withColumn("score", r6("score")))
    return x.select(*(F.round(c, 4).alias(c) if c.startswith("mean_") else F.col(c) for c in x.columns))


@query(_QUAL + " SELECT record_key, round(score, 6) AS score FROM q ORDER BY round(score, 6), record_key LIMIT 20")
def quality_worst(spark, d):
    return _quality(spark, d).select("record_key", r6("score").alias("score")).orderBy("score", "record_key").limit(20)


_JUNK = "count(*) AS n, count(*) FILTER (WHERE (email IS NOT NULL AND email_valid = false) OR (phone_e164 IS NOT NULL AND phone_valid = false)) AS junk, count(*) FILTER (WHERE coalesce(updated_at_source, ingested_at) < TIMESTAMP '2025-04-01' - 365 * INTERVAL '1 day') AS stale"


@query(f"WITH {STD} SELECT {_JUNK} FROM std")
def junk_stale(spark, d):
    return Q.junk_and_stale(C.std(spark, d), _now())


_GOLD = ["given_name", "family_name", "email", "phone_e164", "birth_date", "address"]


@query(f"{_X} FROM x), g AS ({_LINES}), gold AS (SELECT entity_id, " + ", ".join(f"max(value) FILTER (attribute = '{a}') AS {a}" for a in _GOLD) + " FROM g GROUP BY 1), c AS (SELECT " + ", ".join(f"coalesce(count({a}) / nullif(count(*), 0), 0) AS c_{a}" for a in _GOLD) + f" FROM gold), j AS (SELECT {_JUNK} FROM std), s AS (SELECT coalesce(sum(k) FILTER (k > 1), 0) AS dup FROM (SELECT count(*) AS k FROM mem GROUP BY entity_id)), y AS (SELECT c.*, (" + " + ".join(f"c_{a}" for a in _GOLD) + f") / {len(_GOLD)} AS completeness, junk / n AS junk_rate, stale / n AS stale_rate, dup / n AS duplicate_rate FROM c, j, s) SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in [*(f"c_{a}" for a in _GOLD), "completeness", "junk_rate", "stale_rate", "duplicate_rate"]) + ", round((completeness + 1 - junk_rate + 1 - stale_rate + 1 - duplicate_rate) / 4, 6) AS dq_score FROM y")
def data_quality(spark, d):
    golden = N.records(_lineage(spark, d), _GOLD)
    x = Q.data_quality(golden, C.std(spark, d), C.membership(spark, d), _GOLD, _now())
    return x.select(*(r6(c).alias(c) for c in x.columns))


@query(f"WITH {STD}, e AS (SELECT rec_a_key AS k, match_probability AS p FROM match_scores WHERE is_active UNION ALL SELECT rec_b_key, match_probability FROM match_scores WHERE is_active), b AS (SELECT record_key, max(p) AS p FROM std LEFT JOIN e ON k = record_key GROUP BY 1) SELECT count(*) FILTER (p >= 0.95) AS matched, count(*) FILTER (p >= 0.6 AND p < 0.95) AS review, count(*) FILTER (p IS NULL OR p < 0.6) AS unmatched FROM b")
def screening(spark, d):
    return Q.screening(C.std(spark, d), table(spark, d, "match_scores"))


@query(f"{_HEAD.rstrip()}, ev AS (SELECT 'created'{_TAIL}) SELECT 'run-1' AS run_id, event_type, count(*) AS n FROM ev GROUP BY 2")
def event_counts(spark, d):
    """A run's events by type: here those of the reconciliation."""
    return reconcile_events(spark, d).groupBy(F.lit("run-1").alias("run_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MEMBERS} SELECT entity_id, count(*) AS members, min(record_key) AS first_member FROM mem GROUP BY 1 HAVING count(*) >= 3 AND entity_id > '4' ORDER BY entity_id LIMIT 50")
def duplicate_groups(spark, d):
    return Q.duplicate_groups(C.membership(spark, d), 3, "4", 50)


@query("SELECT id, rec_a_key, rec_b_key, match_probability FROM match_scores WHERE is_active AND match_probability BETWEEN 0.5 AND 0.97 ORDER BY abs(match_probability - 0.95), rec_a_key, rec_b_key, id LIMIT 50")
def uncertain_pairs(spark, d):
    return Q.uncertain(table(spark, d, "match_scores"), 0.95, 0.5, 0.97).select("id", "rec_a_key", "rec_b_key", "match_probability")


@query("SELECT run_id, count(*) AS pairs, count(*) FILTER (match_probability >= 0.95) AS auto_merge, round(count(*) FILTER (match_probability >= 0.95) / count(*), 6) AS rate, max(scored_at) AS last FROM match_scores GROUP BY 1 ORDER BY last DESC, run_id LIMIT 20")
def runs_insight(spark, d):
    """The latest 20 runs with the share of their pairs that merge."""
    g = table(spark, d, "match_scores").groupBy("run_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("match_probability") >= 0.95).alias("auto_merge"), F.max("scored_at").alias("last"))
    return g.select("run_id", "pairs", "auto_merge", r6(F.col("auto_merge") / F.col("pairs")).alias("rate"), "last").orderBy(F.desc("last"), "run_id").limit(20)


# Evaluation -------------------------------------------------------------------------------------
_LABEL = f"WITH {STD}, {MEMBERS}, x AS (SELECT std.*, mem.entity_id FROM std JOIN mem USING (record_key)), {C.pairs_sql('x', 'x', rules=[*C.RULE_SQL, 'l.entity_id = r.entity_id'])}, {C.weights_sql()}, lab AS (SELECT scored.*, coalesce(a.entity_id = b.entity_id, false) AS is_match, match_key <> '3' AS found_by_blocking FROM scored JOIN mem a ON a.record_key = record_key_l JOIN mem b ON b.record_key = record_key_r)"


def _labelled(spark, d):
    return E.labelled_by_column(C.members(spark, d).select(*C.PEOPLE, "entity_id"), C.PLAIN, "entity_id")


@query(_LABEL + " SELECT record_key_l, record_key_r, match_probability, is_match, found_by_blocking FROM lab")
def labelled_predictions(spark, d):
    return _labelled(spark, d).select("record_key_l", "record_key_r", r6("match_probability").alias("match_probability"), "is_match", "found_by_blocking")


_RATES = ["p_rate", "n_rate", "tp_rate", "tn_rate", "fp_rate", "fn_rate", "precision", "recall", "specificity", "npv", "accuracy", "f1", "f2", "f0_5", "p4", "phi"]


def _truth_sql(adjusted: bool) -> str:
    """The truth space as the contract writes it; ``adjusted`` by the pairs never made and those blocking missed."""
    extra = "(tl - total_pos - total_neg)" if adjusted else "0"
    at = "CASE WHEN found_by_blocking THEN match_weight ELSE -999::DOUBLE END" if adjusted else "match_weight"
    return f""", tt AS (SELECT {at} AS tt, is_match::INT AS pos, (NOT is_match)::INT AS neg FROM lab), g AS (SELECT tt, count(*) AS k, sum(pos) AS pos, sum(neg) AS neg FROM tt GROUP BY 1), c AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS n),
    s AS (SELECT tt, sum(pos) OVER (ORDER BY tt DESC) AS cp, sum(neg) OVER (ORDER BY tt) - neg AS cn, (SELECT sum(pos) FROM g) AS total_pos, (SELECT sum(neg) FROM g) AS total_neg, (SELECT sum(k) FROM g) AS total_labels, -k + sum(k) OVER (ORDER BY tt) AS below, sum(k) OVER (ORDER BY tt DESC) AS above, (SELECT n * (n - 1) / 2 FROM c) AS tl FROM g),
    a AS (SELECT tt, cp, cn + {extra} AS cn, total_pos, {"tl - total_pos" if adjusted else "total_neg"} AS total_neg, {"tl" if adjusted else "total_labels"} AS total_labels, below + {extra} AS below, above FROM s),
    f AS (SELECT tt, total_labels::DOUBLE AS t, total_pos::DOUBLE AS P, total_neg::DOUBLE AS N, (above - cp)::DOUBLE AS FP, cp::DOUBLE AS TP, (below - cn)::DOUBLE AS FN, cn::DOUBLE AS TN FROM a)
    SELECT round(tt, 6) AS truth_threshold, P AS p, N AS n, TP AS tp, TN AS tn, FP AS fp, FN AS fn, round(P / t, 6) AS p_rate, round(N / t, 6) AS n_rate, round(TP / P, 6) AS tp_rate, round(TN / N, 6) AS tn_rate, round(FP / N, 6) AS fp_rate, round(FN / P, 6) AS fn_rate,
    round(CASE WHEN TP + FP = 0 THEN 1 ELSE TP / (TP + FP) END, 6) AS precision, round(TP / P, 6) AS recall, round(TN / N, 6) AS specificity, round(CASE WHEN TN + FN = 0 THEN 1 ELSE TN / (TN + FN) END, 6) AS npv, round((TP + TN) / (P + N), 6) AS accuracy,
    round(2.0 * TP / (2 * TP + FN + FP), 6) AS f1, round(5.0 * TP / (5 * TP + 4 * FN + FP), 6) AS f2, round(1.25 * TP / (1.25 * TP + 0.25 * FN + FP), 6) AS f0_5, round(4.0 * TP * TN / ((4.0 * TP * TN) + ((TP + TN) * (FP + FN))), 6) AS p4,
    round(CASE WHEN TN + FN = 0 OR TP + FP = 0 OR P = 0 OR N = 0 THEN 0 ELSE (TP * TN - FP * FN) / sqrt((TP + FP) * P * N * (TN + FN)) END, 6) AS phi FROM f WHERE tt >= -998"""


def _truth(x):
    return x.select(r6("truth_threshold").alias("truth_threshold"), "p", "n", "tp", "tn", "fp", "fn", *(r6(c).alias(c) for c in _RATES))


@query(_LABEL + _truth_sql(True))
def truth_space(spark, d):
    """From a label column: all pairs never made are negatives, those blocking missed are not found."""
    return _truth(E.truth_space(_labelled(spark, d).withColumn("match_weight", r6("match_weight")), E.possible_pairs(C.members(spark, d))))


@query(_LABEL + _truth_sql(False))
def truth_space_of_labels(spark, d):
    """From labelled pairs alone."""
    return _truth(E.truth_space(_labelled(spark, d).withColumn("match_weight", r6("match_weight")), missed_as_zero=False))


@query(_LABEL + " SELECT record_key_l, record_key_r, CASE WHEN is_match THEN 'FN' ELSE 'FP' END AS status FROM lab WHERE (is_match AND NOT (match_probability >= 0.9 AND found_by_blocking)) OR (NOT is_match AND match_probability >= 0.9 AND found_by_blocking)")
def prediction_errors(spark, d):
    return E.prediction_errors(_labelled(spark, d).withColumn("match_probability", r6("match_probability")), 0.9).select("record_key_l", "record_key_r", "status")


@query(f"WITH {STD}, {C.pairs_sql(extra='l.record_key = r.record_key', rules=['l.record_key = r.record_key'])}, {C.weights_sql()}, g AS (SELECT round(mw, 2) AS match_weight, count(*) AS c FROM w GROUP BY 1) SELECT match_weight, round(c / sum(c) OVER (), 6) AS prop, round(sum(c) OVER (ORDER BY match_weight) / sum(c) OVER (), 6) AS cum_prop FROM g")
def unlinkables(spark, d):
    x = E.unlinkables(C.people(spark, d), C.PLAIN)
    return x.select("match_weight", r6("prop").alias("prop"), r6("cum_prop").alias("cum_prop"))


_CLOSED = f"{MEMBERS}, truth AS (SELECT DISTINCT l.record_key AS a, r.record_key AS b FROM mem l JOIN mem r ON l.entity_id = r.entity_id WHERE l.record_key < r.record_key)"


@query(f"WITH {_CLOSED} SELECT a, b FROM truth")
def closure_pairs(spark, d):
    return E.closure_pairs(C.membership(spark, d))


@query(f"WITH {_CLOSED}, f AS (SELECT DISTINCT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b FROM match_scores WHERE is_active AND match_probability >= 0.95 AND rec_a_key <> rec_b_key), c AS (SELECT count(*) FILTER (f.a IS NOT NULL AND t.a IS NOT NULL) AS tp, count(*) FILTER (t.a IS NULL) AS fp, count(*) FILTER (f.a IS NULL) AS fn FROM f FULL JOIN truth t ON f.a = t.a AND f.b = t.b) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def pairwise_metrics(spark, d):
    x = E.pairwise(_edges(spark, d, 0.95), E.closure_pairs(C.membership(spark, d)))
    return x.select("tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


# Profiles ---------------------------------------------------------------------------------------
_PC = ["given_name", "email", "addr_number", "birth_date"]
_LONG = "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM int_std_records" for c in _PC) + "), g AS (SELECT \"column\", value, count(*) AS n FROM v GROUP BY 1, 2)"


@query(f"""WITH {_LONG} SELECT "column", sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS nulls, count(value) AS "distinct", count(*) FILTER (n = 1 AND value IS NOT NULL) AS singles, max(n) FILTER (value IS NOT NULL) AS mode_count, min(value) AS least, max(value) AS greatest,
    min(length(value))::INT AS shortest, max(length(value))::INT AS longest, round(sum(length(value) * n) / sum(n) FILTER (value IS NOT NULL), 6) AS mean_length, coalesce(sum(n) FILTER (regexp_full_match(value, '[+-]?[0-9]+')), 0)::BIGINT AS integers, coalesce(sum(n) FILTER (regexp_full_match(value, '\\d{{4}}-\\d{{2}}-\\d{{2}}')), 0)::BIGINT AS dates,
    round(log2(sum(n) FILTER (value IS NOT NULL)) - sum(n * log2(n)) FILTER (value IS NOT NULL) / sum(n) FILTER (value IS NOT NULL), 6) AS entropy FROM g GROUP BY 1""")
def column_shape(spark, d):
    x = P.shape(table(spark, d, "int_std_records"), _PC)
    return x.select("column", "rows", "nulls", "distinct", "singles", "mode_count", "least", "greatest", "shortest", "longest", r6("mean_length").alias("mean_length"), "integers", "dates", r6("entropy").alias("entropy"))


@query(f'WITH {_LONG}, t AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INT AS rank FROM g WHERE value IS NOT NULL) SELECT "column", value, n AS count, round(n / total, 6) AS share, rank FROM t WHERE rank <= 5')
def top_values(spark, d):
    return P.top_values(table(spark, d, "int_std_records"), _PC, 5).withColumn("share", r6("share"))


@query(f'WITH {_LONG} SELECT "column", value, n AS count, sum(n) OVER (PARTITION BY "column")::BIGINT AS total FROM g WHERE value IS NOT NULL')
def value_frequencies(spark, d):
    return P.frequencies(table(spark, d, "int_std_records"), _PC)


@query(" UNION ALL ".join(f"SELECT source_system AS source, '{c}' AS \"column\", round(count({c}) / count(*), 6) AS completeness FROM int_std_records GROUP BY 1" for c in _PC))
def completeness(spark, d):
    return P.completeness(table(spark, d, "int_std_records"), _PC, "source_system").withColumn("completeness", r6("completeness"))


@query("WITH h AS (SELECT ('0x' || substr(md5(concat_ws(chr(31), coalesce(record_key, chr(0)), coalesce(email, chr(0)))), 1, 12))::BIGINT::HUGEINT AS h FROM int_std_records) SELECT count(*) AS rows, md5(count(*) || ':' || coalesce(sum(h), 0)) AS digest FROM h")
def corpus_digest(spark, d):
    return P.digest(table(spark, d, "int_std_records"), ["record_key", "email"])


_FC = [*_PC, "std_version", "addr_unit", "record_key", "addr_city"]
_WORDS = ", ".join(f"'{w}'" for w in P.PLACEHOLDER_WORDS)
_FLAT = "trim(regexp_replace(lower(value), '[[:space:]]+', ' ', 'g'))"
_SHAPES = "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM {{t}}" for c in _FC) + f""" ), g AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2),
    s AS (SELECT "column", sum(n) AS rows, coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS filled, count(value) AS dist, count(DISTINCT {_FLAT}) AS norm, max(n) FILTER (value IS NOT NULL) AS mode, coalesce(sum(n) FILTER (lower(trim(value)) IN ({_WORDS})), 0) AS fake,
        coalesce(sum(n) FILTER (regexp_full_match(value, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')), 0) AS numbers, coalesce(sum(n) FILTER (regexp_full_match(value, '[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}')), 0) AS dates, coalesce(sum(n) FILTER (lower(value) IN ('true', 'false')), 0) AS flags FROM g GROUP BY 1)"""
_CODES = """SELECT "column", 'P001' AS code FROM s WHERE filled = 0 UNION ALL SELECT "column", 'P002' FROM s WHERE filled > 0 AND filled / rows < 0.5 UNION ALL SELECT "column", 'P003' FROM s WHERE mode / filled >= 0.2 UNION ALL SELECT "column", 'P004' FROM s WHERE fake / filled >= 0.01
    UNION ALL SELECT "column", 'P005' FROM s WHERE norm < dist AND (dist - norm) / dist >= 0.1 UNION ALL SELECT "column", 'P006' FROM s WHERE greatest(numbers, dates, flags) / filled >= 0.99 UNION ALL SELECT "column", 'P007' FROM s WHERE dist = 1 AND filled > 1 UNION ALL SELECT "column", 'P008' FROM s WHERE dist < filled AND dist / filled >= 0.99"""


@query("WITH " + _SHAPES.format(t="int_std_records") + " " + _CODES)
def profile_findings(spark, d):
    return P.findings(P.shape(table(spark, d, "int_std_records"), _FC))


_KEYS = {"given_name": ["given_name"], "email": ["email"], "family_name + birth_date": ["family_name", "birth_date"], "addr_region": ["addr_region"]}


@query("WITH n AS (SELECT count(*)::DOUBLE AS rows FROM int_std_records), k AS (" + " UNION ALL ".join(f"SELECT '{k}' AS key, (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM int_std_records WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)} GROUP BY {', '.join(cs)})) AS pairs, (SELECT count(*) FROM int_std_records WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)})::DOUBLE AS filled" for k, cs in _KEYS.items()) + """), v AS (SELECT key, pairs, 1 - pairs / (rows * (rows - 1) / 2) >= 0.99 AND 1 - filled * (filled - 1) / (rows * (rows - 1)) <= 0.5 AS viable FROM k, n WHERE rows * (rows - 1) / 2 > 100000)
    SELECT '' AS "column", 'P009' AS code FROM v HAVING count(*) > 0 AND NOT bool_or(viable) UNION ALL (SELECT key, 'P010' FROM v WHERE viable ORDER BY pairs, key LIMIT 1)""")
def profile_key_findings(spark, d):
    """Whether any candidate key blocks the table, and the most selective that does; a table of few pairs needs none."""
    std = table(spark, d, "int_std_records")
    return P.key_findings(E.rank_keys(std, _KEYS), std.count(), budget=100_000)


@query("WITH a AS (SELECT * FROM int_std_records WHERE source_system = 'crm'), b AS (SELECT * REPLACE (CASE WHEN source_system = 'webforms' THEN NULL ELSE addr_unit END AS addr_unit) FROM int_std_records WHERE source_system <> 'crm'), p AS (SELECT 'x' AS x), va AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) / count(*) AS fill FROM a" for c in [*_FC, "given_name"][:-1]) + "), vb AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) / count(*) AS fill FROM b" for c in [*_FC[:-1], "family_name"]) + """)
    SELECT "column", 'P011' AS code FROM va JOIN vb USING ("column") WHERE va.fill >= 0.2 AND vb.fill < va.fill AND 1 - vb.fill * vb.fill / (va.fill * va.fill) >= 0.1
    UNION ALL SELECT coalesce(va."column", vb."column"), 'P012' FROM va FULL JOIN vb ON va."column" = vb."column" WHERE va."column" IS NULL OR vb."column" IS NULL""")
def profile_drift(spark, d):
    """Findings of a profile against the one before: here crm's rows, then the others with other columns."""
    s = table(spark, d, "int_std_records")
    now = s.filter("source_system <> 'crm'").withColumn("addr_unit", F.when(F.col("source_system") != "webforms", F.col("addr_unit")))
    return P.drift_findings(P.shape(now, [*_FC[:-1], "family_name"]), P.shape(s.filter("source_system = 'crm'"), _FC))


@query("SELECT source_system, field, count(*) AS n, count(value) AS filled FROM (SELECT source_system, unnest(json_keys(payload)) AS field, payload FROM raw_records_golden WHERE payload IS NOT NULL) s, LATERAL (SELECT nullif(json_extract_string(s.payload, '$.' || s.field), '') AS value) GROUP BY 1, 2")
def json_flatten(spark, d):
    x = P.json_flatten(table(spark, d, "raw_records_golden"), "payload", ["source_system"])
    return x.groupBy("source_system", "field").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") != "", F.col("value"))).alias("filled"))


@query(f"WITH {STD}, {C.pairs_sql()}, {C.weights_sql()} SELECT count(*) FILTER (match_probability >= 0.95) AS would_merge, count(*) FILTER (match_probability >= 0.6 AND match_probability < 0.95) AS would_review FROM scored")
def match_preview(spark, d):
    p = L.predict(C.people(spark, d), C.PLAIN).select(r6("match_probability").alias("p"))
    return p.agg(F.count_if(F.col("p") >= 0.95).alias("would_merge"), F.count_if((F.col("p") >= 0.6) & (F.col("p") < 0.95)).alias("would_review"))
