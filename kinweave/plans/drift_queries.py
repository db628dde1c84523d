"""Queries of problem 2 over raw_records_golden."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.operators import drift
from kinweave.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "raw_records_golden"), table(spark, sf_dir, "profile_runs"))


def p2_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.alternatives(table(spark, sf_dir, "raw_records_golden"), table(spark, sf_dir, "profile_runs"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "raw_records_golden"), table(spark, sf_dir, "profile_runs"))


def p2_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.tagged_union(table(spark, sf_dir, "raw_records_golden"))


QUERIES = {"p2_found": p2_found, "p2_alternatives": p2_alternatives, "p2_unified": p2_unified, "p2_schema": p2_schema}
_TYPE = "CASE json_type(payload, '$.' || field) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END"
_JSON_TYPE = "CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END"
SQL: dict[str, str] = {
    "p2_schema": f"""WITH RECURSIVE e AS (
        SELECT source_system, k AS field, json_extract(payload, '$."' || k || '"') AS v FROM (SELECT source_system, payload, unnest(json_keys(payload)) AS k FROM raw_records_golden WHERE NOT coalesce(is_deleted, false) AND payload IS NOT NULL)
        UNION ALL
        SELECT source_system, CASE WHEN kind = 'OBJECT' THEN field || '.' || k ELSE field || '[]' END, CASE WHEN kind = 'OBJECT' THEN json_extract(v, '$."' || k || '"') ELSE json_extract(v, '$[' || k || ']') END
        FROM (SELECT source_system, field, v, json_type(v) AS kind, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) ELSE []::VARCHAR[] END) AS k FROM e WHERE json_type(v) IN ('OBJECT', 'ARRAY'))),
        t AS (SELECT source_system, field, json_type(v) AS t FROM e), g AS (SELECT source_system, field, {_JSON_TYPE} AS type, count(*) AS n_values FROM t GROUP BY 1, 2, 3)
        SELECT source_system, field, type, n_values, count(*) OVER (PARTITION BY source_system, field)::INT AS alternatives FROM g WHERE type IS NOT NULL""",
    "p2_alternatives": f"""WITH o AS (SELECT ingest_batch_id, min(snapshot) AS no FROM profile_runs WHERE subject = 'raw' AND ingest_batch_id IS NOT NULL GROUP BY 1),
        f AS (SELECT source_system, ingest_batch_id, unnest(json_keys(payload)) AS field, payload FROM raw_records_golden WHERE NOT coalesce(is_deleted, false) AND payload IS NOT NULL),
        t AS (SELECT source_system, ingest_batch_id, field, {_TYPE} AS type FROM f), g AS (SELECT source_system, field, type, ingest_batch_id, coalesce(no, 4611686018427387904) AS no, count(*) AS n FROM t LEFT JOIN o USING (ingest_batch_id) WHERE type IS NOT NULL GROUP BY ALL)
        SELECT source_system, field, type, min_by(ingest_batch_id, (no, ingest_batch_id)) AS first_batch, count(*) AS n_batches, sum(n)::BIGINT AS n_values FROM g GROUP BY 1, 2, 3""",
}
