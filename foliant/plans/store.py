"""Queries over the document store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import ids, text
from foliant.operators import reads as R
from foliant.session import load


def docs(spark: SparkSession, d: str) -> DataFrame:
    return R.current_documents(load(spark, d, "documents_meta"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.current_chunks(load(spark, d, "chunks"))


def _latest_sql(table: str, key: str, order: list[str]) -> str:
    by = ", ".join(f"{c} DESC NULLS LAST" for c in order)
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn FROM {table}) WHERE rn = 1)"


DOCS_SQL = _latest_sql("documents_meta", "document_id", R.DOCUMENT_ORDER)
CHUNKS_SQL = _latest_sql("chunks", "chunk_id", R.CHUNK_ORDER)
WITH = f"WITH d AS {DOCS_SQL}, c AS {CHUNKS_SQL}, visible AS (SELECT * FROM d WHERE deleted_at IS NULL AND coalesce(lms_published, true))\n"
TYPE_SQL = """CASE WHEN contains(lower(coalesce(mime_type, '')), 'pdf') OR file_path ILIKE '%.pdf' THEN 'pdf'
  WHEN contains(lower(coalesce(mime_type, '')), 'wordprocessingml') OR file_path ILIKE '%.docx' THEN 'docx'
  WHEN contains(lower(coalesce(mime_type, '')), 'presentationml') OR file_path ILIKE '%.pptx' THEN 'pptx'
  WHEN contains(lower(coalesce(mime_type, '')), 'markdown') OR file_path ILIKE '%.md' OR file_path ILIKE '%.markdown' THEN 'markdown'
  ELSE 'unknown' END"""


def visible_documents(s, d):
    return R.visible_documents(docs(s, d)).select("document_id", "course_id", "title")


def hidden_documents(s, d):
    return R.hidden_documents(docs(s, d))


def documents_by_filter(s, d):
    out = R.list_documents(docs(s, d), ["pdf", "docx"], "vi", datetime(2024, 1, 1), datetime(2025, 7, 1), limit=40, offset=5)
    return out.select("document_id", "doc_type", "created_at")


def document_types(s, d):
    t = text.doc_type(F.col("mime_type"), F.col("file_path"))
    return docs(s, d).groupBy(t.alias("doc_type"), F.coalesce("status", F.lit("?")).alias("status")).agg(F.count("*").alias("n"), F.sum("page_count").alias("pages"))


def course_documents(s, d):
    return R.course_documents(docs(s, d), chunks(s, d))


def course_documents_of_chapter(s, d):
    return R.course_documents(docs(s, d), chunks(s, d), "5")


def document_summaries(s, d):
    return R.document_summaries(docs(s, d), chunks(s, d))


def page_chunks(s, d):
    return R.page_chunks(docs(s, d), chunks(s, d), 2)


def neighbor_chunks(s, d):
    c = chunks(s, d)
    return R.neighbours(c, docs(s, d), c.where(R.alive()), 2)


def next_edges(s, d):
    return R.next_edges(chunks(s, d))


def _cards(s, d):
    """Cards made of the first three chunks of a section."""
    c = chunks(s, d).where("part_index < 3 AND document_id IS NOT NULL")
    return c.groupBy("document_id", "heading_path").agg(F.sort_array(F.collect_list("chunk_id")).alias("source_chunk_ids"), F.min("created_at").alias("created_at")).select(
        F.md5(F.concat("document_id", F.lit("/"), F.array_join("heading_path", "/"))).alias("card_id"), "source_chunk_ids", "created_at", F.lit(None).cast("timestamp").alias("deleted_at"))


def lesson_cards(s, d):
    return R.cards(_cards(s, d), chunks(s, d).where("document_id IS NOT NULL"))


def outcome_chunks(s, d):
    return R.chunks_for_outcomes(load(s, d, "chunk_lo_mappings").groupBy("chunk_id", "lo_id").agg(F.max("confidence").alias("confidence")), chunks(s, d), docs(s, d))


def chunk_ids(s, d):
    c = load(s, d, "chunks").select("chunk_id", "document_id", "content_hash", "content").distinct()
    return c.select(
        "chunk_id", ids.stable_uuid(F.col("document_id")).alias("document_uuid"), ids.uuid5(F.col("chunk_id")).alias("name_uuid"),
        F.md5("content").alias("content_md5"), F.sha1("content").alias("content_sha1"), F.sha2("content", 256).alias("content_sha256"))


def job_ids(s, d):
    m = load(s, d, "documents_meta").where("document_id IS NOT NULL AND processing_generation >= 0")
    return m.groupBy(ids.job_id(F.col("document_id"), F.col("processing_generation")).alias("job_id")).agg(F.count("*").alias("deliveries"), F.min("created_at").alias("first_at"))


def outcome_codes(s, d):
    lo = load(s, d, "learning_outcomes").select("lo_id", "code", "parent_code", "bloom_level").distinct()
    return lo.select("lo_id", "code", text.parent_code(F.col("code")).alias("derived_parent"), F.size(F.split("code", r"\.")).alias("parts"),
                     text.bloom_name(F.col("bloom_level")).alias("bloom"), text.outcome_code(F.lower(F.regexp_replace("code", r"^L\.O\.", ""))).alias("from_short"))


def breadcrumbs(s, d):
    c = chunks(s, d)
    return c.select("chunk_id", text.breadcrumb(F.col("heading_path")).alias("crumb"), F.substring("content", 1, 180).alias("preview"), (F.length("content") > 180).alias("truncated"),
                    text.word_count(F.col("content")).alias("words"))


def course_content_dedup(s, d):
    c = chunks(s, d).where(R.alive())
    return c.groupBy("course_id", F.md5("content").alias("content_md5")).agg(F.count("*").alias("copies"), F.min("chunk_id").alias("kept")).where("copies > 1")


SQL = {
    "visible_documents": WITH + "SELECT document_id, course_id, title FROM visible",
    "hidden_documents": WITH + "SELECT document_id FROM d WHERE deleted_at IS NOT NULL OR lms_published IS FALSE",
    "documents_by_filter": WITH + f"""SELECT document_id, {TYPE_SQL} AS doc_type, created_at FROM d
WHERE deleted_at IS NULL AND doc_type IN ('pdf', 'docx') AND lower(language) = 'vi' AND created_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00'
ORDER BY created_at DESC NULLS LAST, document_id LIMIT 40 OFFSET 5""",
    "document_types": WITH + f"SELECT {TYPE_SQL} AS doc_type, coalesce(status, '?') AS status, count(*) AS n, sum(page_count) AS pages FROM d GROUP BY 1, 2",
    "course_documents": WITH + """SELECT v.course_id, v.document_id, v.title, v.chapter_code, coalesce(max(c.page_number), 0) AS pages, count(*) AS chunks
FROM visible v JOIN c ON c.document_id = v.document_id WHERE c.deleted_at IS NULL GROUP BY 1, 2, 3, 4""",
    "course_documents_of_chapter": WITH + """SELECT v.course_id, v.document_id, v.title, v.chapter_code, coalesce(max(c.page_number), 0) AS pages, count(*) AS chunks
FROM visible v JOIN c ON c.document_id = v.document_id WHERE c.deleted_at IS NULL AND v.chapter_code = '5' GROUP BY 1, 2, 3, 4""",
    "document_summaries": WITH + f"""SELECT document_id, title, {TYPE_SQL} AS doc_type, mime_type,
(SELECT count(*) FROM c WHERE c.document_id = d.document_id AND c.deleted_at IS NULL) AS chunk_count FROM d WHERE deleted_at IS NULL""",
    "page_chunks": WITH + """SELECT v.document_id, v.title, c.chunk_id, c.page_number, c.sort_order FROM visible v JOIN c ON c.document_id = v.document_id
WHERE c.deleted_at IS NULL AND 2 BETWEEN c.page_start AND c.page_end""",
    "neighbor_chunks": WITH + """, live AS (SELECT c.* FROM c JOIN visible v ON v.document_id = c.document_id WHERE c.deleted_at IS NULL)
SELECT a.chunk_id AS anchor, b.chunk_id, b.sort_order, b.sort_order - a.sort_order AS distance
FROM live a JOIN live b ON a.document_id = b.document_id AND b.sort_order BETWEEN a.sort_order - 2 AND a.sort_order + 2""",
    "next_edges": WITH + """SELECT document_id, chunk_id, next_id FROM (SELECT document_id, chunk_id, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY sort_order NULLS LAST, chunk_id) AS next_id
FROM c WHERE deleted_at IS NULL AND document_id IS NOT NULL) WHERE next_id IS NOT NULL""",
    "lesson_cards": WITH + """, cards AS (SELECT md5(document_id || '/' || array_to_string(heading_path, '/')) AS card_id, list(chunk_id) AS ids, min(created_at) AS created_at
  FROM c WHERE part_index < 3 AND document_id IS NOT NULL AND heading_path IS NOT NULL GROUP BY document_id, heading_path),
pairs AS (SELECT card_id, created_at, unnest(ids) AS chunk_id FROM cards)
SELECT c.document_id, p.card_id, p.chunk_id, row_number() OVER (PARTITION BY c.document_id ORDER BY c.sort_order NULLS FIRST, p.created_at NULLS FIRST, p.card_id, p.chunk_id) - 1 AS card_index
FROM pairs p JOIN c ON c.chunk_id = p.chunk_id WHERE c.deleted_at IS NULL AND c.document_id IS NOT NULL""",
    "outcome_chunks": WITH + """, m AS (SELECT chunk_id, lo_id, max(confidence) AS confidence FROM chunk_lo_mappings WHERE lo_id IS NOT NULL GROUP BY 1, 2)
SELECT m.lo_id, m.chunk_id, m.confidence, v.role, row_number() OVER (PARTITION BY m.lo_id ORDER BY coalesce(v.role = 'reference', false), m.confidence DESC NULLS LAST, c.sort_order NULLS LAST, m.chunk_id) AS rank
FROM m JOIN c ON c.chunk_id = m.chunk_id JOIN visible v ON v.document_id = c.document_id WHERE c.deleted_at IS NULL""",
    "chunk_ids": """WITH c AS (SELECT DISTINCT chunk_id, document_id, content_hash, content FROM chunks),
u AS (SELECT *, lower(replace(document_id, '-', '')) AS hx, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(document_id)) AS hd, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS hc FROM c)
SELECT chunk_id, CASE WHEN document_id IS NULL THEN NULL WHEN regexp_full_match(document_id, '[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}') THEN concat_ws('-', hx[1:8], hx[9:12], hx[13:16], hx[17:20], hx[21:32])
ELSE concat_ws('-', hd[1:8], hd[9:12], '5' || hd[14:16], translate(hd[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || hd[18:20], hd[21:32]) END AS document_uuid,
CASE WHEN chunk_id IS NOT NULL THEN concat_ws('-', hc[1:8], hc[9:12], '5' || hc[14:16], translate(hc[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || hc[18:20], hc[21:32]) END AS name_uuid,
md5(content) AS content_md5, sha1(content) AS content_sha1, sha256(content) AS content_sha256 FROM u""",
    "job_ids": """SELECT document_id || '-g' || processing_generation AS job_id, count(*) AS deliveries, min(created_at) AS first_at
FROM documents_meta WHERE document_id IS NOT NULL AND processing_generation >= 0 GROUP BY 1""",
    "outcome_codes": """SELECT lo_id, code, CASE WHEN len(string_split(code, '.')) > 3 THEN regexp_replace(code, '\\.[^.]+$', '') END AS derived_parent, len(string_split(code, '.')) AS parts,
CASE bloom_level WHEN 1 THEN 'remember' WHEN 2 THEN 'understand' WHEN 3 THEN 'apply' WHEN 4 THEN 'analyze' WHEN 5 THEN 'evaluate' WHEN 6 THEN 'create' END AS bloom,
code AS from_short FROM (SELECT DISTINCT lo_id, code, parent_code, bloom_level FROM learning_outcomes)""",
    "breadcrumbs": WITH + """SELECT chunk_id, array_to_string(heading_path, ' > ') AS crumb, substring(content, 1, 180) AS preview, length(content) > 180 AS truncated,
len(regexp_extract_all(content, '[\\p{L}\\p{N}\\p{M}_]+')) AS words FROM c""",
    "course_content_dedup": WITH + """SELECT course_id, md5(content) AS content_md5, count(*) AS copies, min(chunk_id) AS kept FROM c WHERE deleted_at IS NULL
GROUP BY 1, 2 HAVING count(*) > 1""",
}
QUERIES = {f.__name__: f for f in (
    visible_documents, hidden_documents, documents_by_filter, document_types, course_documents, course_documents_of_chapter, document_summaries, page_chunks,
    neighbor_chunks, next_edges, lesson_cards, outcome_chunks, chunk_ids, job_ids, outcome_codes, breadcrumbs, course_content_dedup)}
