"""Queries of the problems tagged llm, with SQL where DuckDB can say the same over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.functions import text as X
from kinweave.llm import components, history, leakage, matching, names, packing, places, spam, survivors
from kinweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.found(table(spark, sf_dir, "raw_records_golden"), table(spark, sf_dir, "profile_runs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.grouped_records(table(spark, sf_dir, "match_scores"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matches(table(spark, sf_dir, "raw_records_golden")).select("rec_a_key", "rec_b_key")


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matches(table(spark, sf_dir, "raw_records_golden"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variants(table(spark, sf_dir, "raw_records_golden"), table(spark, sf_dir, "profile_runs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "entity_membership"), table(spark, sf_dir, "int_std_records")).select("entity_id", "attribute", "record_key")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.judged(survivors.cut(survivors.claims(survivors.members(table(spark, sf_dir, "entity_membership"), table(spark, sf_dir, "int_std_records")))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.same_door(table(spark, sf_dir, "address_golden"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_targets"))


def p8_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filling(packing.cut(p8_containers(spark, sf_dir)), table(spark, sf_dir, "pack_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_confidence, p5_found, p6_found, p6_values, p7_found, p8_containers, p8_filling, p9_found, p10_found)}

def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_FILLER = _list(X.FILLER_WORDS)
_PHONE = "regexp_replace(regexp_replace(phone_e164, '[^0-9]', '', 'g'), '^1([0-9]{10})$', '\\1')"
_LETTERS = "(length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) > 1)::INT"
_CLAIMS = {
    "given_name": ("lower(trim(given_name)) NOT IN " + _FILLER, _LETTERS.format("given_name")),
    "family_name": ("lower(trim(family_name)) NOT IN " + _FILLER, _LETTERS.format("family_name")),
    "email": (f"coalesce(email_valid, true) AND lower(email) NOT IN {_FILLER} AND contains(email, '@') AND split_part(lower(email), '@', 1) NOT IN {_list(X.NOBODY_LOCAL)} AND split_part(lower(email), '@', 2) NOT IN {_list(X.NOBODY_DOMAIN)}", "1"),
    "phone_e164": (f"coalesce(phone_valid, true) AND length({_PHONE}) >= 7 AND {_PHONE} <> repeat(left({_PHONE}, 1), length({_PHONE})) AND {_PHONE} NOT IN {_list(X.DEFAULT_DIGITS)}", "1"),
    "address": ("lower(trim(addr_street)) NOT IN " + _FILLER, " + ".join(f"({c} IS NOT NULL)::INT" for c in survivors.ADDRESS)),
    "birth_date": (f"birth_date::VARCHAR NOT IN {_list(X.DEFAULT_DATES)}", "1"),
}
_P6 = " UNION ALL ".join(f"SELECT entity_id, record_key, source_system, coalesce(updated_at_source, ingested_at) AS upd, '{a}' AS attribute, {whole} AS whole FROM live WHERE {ok}" for a, (ok, whole) in _CLAIMS.items())

SQL = {
    "p6_found": f"""
        WITH m AS (SELECT record_key, max_by(entity_id, (assigned_at, id)) AS entity_id FROM entity_membership WHERE record_key IS NOT NULL GROUP BY 1),
        s AS (SELECT * FROM int_std_records WHERE record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY ingested_at DESC NULLS LAST, id DESC) = 1),
        x AS (SELECT s.*, entity_id FROM s JOIN m USING (record_key)),
        live AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY entity_id) > 1), c AS ({_P6})
        SELECT entity_id, attribute, record_key FROM c QUALIFY row_number() OVER (PARTITION BY entity_id, attribute ORDER BY whole DESC, upd DESC NULLS LAST,
            CASE source_system WHEN 'crm' THEN 1 WHEN 'billing' THEN 2 WHEN 'webforms' THEN 3 ELSE 4 END, record_key) = 1
    """,
    "p3_found": """
        WITH RECURSIVE last AS (
            SELECT least(rec_a_key, rec_b_key) AS a, greatest(rec_a_key, rec_b_key) AS b,
                   max_by(match_probability, (scored_at, id)) AS p
            FROM match_scores WHERE is_active AND rec_a_key <> rec_b_key GROUP BY 1, 2),
        e AS (SELECT a, b FROM last WHERE p >= 0.95),
        ends AS (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e),
        reach AS (
            SELECT DISTINCT v AS root, v FROM ends
            UNION
            SELECT r.root, n.w FROM reach r JOIN ends n ON n.v = r.v WHERE r.root < n.w)
        SELECT v AS record_key, min(root) AS group_key FROM reach GROUP BY v
    """,
}
