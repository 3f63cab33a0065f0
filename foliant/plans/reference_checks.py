"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.operators import references as R
from foliant.session import load


def _resolved(spark: SparkSession, sf_dir: str, counts: bool = False) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks")
    refs = R.references(chunks, load(spark, sf_dir, "chunk_lo_mappings"))
    refs = R.counted(refs) if counts else refs
    vers = R.versions(load(spark, sf_dir, "documents_meta"), chunks, load(spark, sf_dir, "learning_outcomes"))
    return R.resolve(refs, vers)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unresolved(_resolved(spark, sf_dir))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report(_resolved(spark, sf_dir, counts=True))


_RESOLVED_SQL = """
WITH refs AS (
  SELECT 'chunks' AS src_table, 'document_id' AS src_field, 'documents_meta' AS target,
         lower(trim(document_id, ' ' || chr(9))) AS key, created_at AS t, chunk_id AS src_key
  FROM chunks WHERE document_id IS NOT NULL
  UNION ALL
  SELECT 'chunk_lo_mappings', f.src_field, f.target, f.key, f.t,
         coalesce(f.c, '') || '|' || coalesce(f.l, '')
  FROM (
    SELECT 'chunk_id' AS src_field, 'chunks' AS target, lower(trim(chunk_id, ' ' || chr(9))) AS key, mapped_at AS t,
           lower(trim(chunk_id, ' ' || chr(9))) AS c, lower(trim(lo_id, ' ' || chr(9))) AS l FROM chunk_lo_mappings
    UNION ALL
    SELECT 'lo_id', 'learning_outcomes', lower(trim(lo_id, ' ' || chr(9))), mapped_at,
           lower(trim(chunk_id, ' ' || chr(9))), lower(trim(lo_id, ' ' || chr(9))) FROM chunk_lo_mappings
  ) f WHERE f.key IS NOT NULL
), vers AS (
  SELECT 'documents_meta' AS target, lower(trim(document_id, ' ' || chr(9))) AS key, created_at, deleted_at FROM documents_meta
  UNION SELECT 'chunks', lower(trim(chunk_id, ' ' || chr(9))), created_at, deleted_at FROM chunks
  UNION SELECT 'learning_outcomes', lower(trim(lo_id, ' ' || chr(9))), created_at, deleted_at FROM learning_outcomes
), numbered AS (SELECT *, row_number() OVER () AS rn FROM refs),
resolved AS (
  SELECT r.rn, any_value(r.src_table) AS src_table, any_value(r.src_field) AS src_field, any_value(r.src_key) AS src_key,
         any_value(r.t) AS t,
         CASE WHEN bool_or(v.created_at <= r.t AND (v.deleted_at IS NULL OR v.deleted_at > r.t)) THEN NULL
              WHEN count(v.key) = 0 THEN 'missing'
              WHEN count(CASE WHEN v.created_at > r.t THEN 1 END) = count(v.key) THEN 'late'
              ELSE 'deleted' END AS kind
  FROM numbered r LEFT JOIN vers v ON v.target = r.target AND v.key = r.key GROUP BY r.rn
)
"""
SQL = {
    "p1_found": _RESOLVED_SQL + """
SELECT DISTINCT src_table, src_field, src_key, kind, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS ref_month
FROM resolved WHERE kind IS NOT NULL""",
    "p1_report": _RESOLVED_SQL + """
SELECT src_table, src_field, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, count(*) AS refs,
       count(CASE WHEN kind = 'missing' THEN 1 END) AS missing, count(CASE WHEN kind = 'late' THEN 1 END) AS late,
       count(CASE WHEN kind = 'deleted' THEN 1 END) AS deleted,
       round(count(kind) * 1.0 / count(*), 6) AS orphan_share
FROM resolved GROUP BY 1, 2, 3""",
}
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
