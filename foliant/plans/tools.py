"""Queries of the vector collection, the ingestion run and the course tools."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from foliant.functions.text import doc_type
from foliant.operators import chunking as K
from foliant.operators import ingest as I
from foliant.operators import reads as R
from foliant.operators import retrieval as X
from foliant.operators import tools as T
from foliant.operators import vector_store as V
from foliant.operators import writes as W
from foliant.plans.curriculum import COURSE
from foliant.plans.mutations import _DEG, _REL, _now, _relations, _seed_sql
from foliant.plans.search import _E, QUERY, _of_model
from foliant.plans.store import CHUNKS_SQL, DOCS_SQL, TYPE_SQL, chunks, docs
from foliant.session import load, shared_dir
from foliant.sources import tables

WITH = f"WITH d AS {DOCS_SQL}, c AS {CHUNKS_SQL}, visible AS (SELECT * FROM d WHERE deleted_at IS NULL AND coalesce(lms_published, true))\n"


def _files(s, d):
    return docs(s, d).where("document_id IS NOT NULL").withColumns({"owner_id": F.lit(" "), "doc_type": doc_type(F.col("mime_type"), F.col("file_path"))})


def _points(s, d):
    return V.points(chunks(s, d), _of_model(s, d), _files(s, d))


def vector_points(s, d):
    return _points(s, d).select("chunk_id", "document_id", "document_name", "doc_type", "course_id", "owner_id", "content_type", F.size("vector").alias("dimension"))


def vector_search(s, d):
    """A search in the collection with every kind of condition."""
    found = X.search(_points(s, d), R.hidden_documents(docs(s, d)), QUERY, 20, doc_types=["pdf", "docx"], heading_contains="The", uploaded_after=datetime(2023, 1, 1), uploaded_before=datetime(2026, 1, 1))
    return found.select("chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_stale(s, d):
    """Points of documents sent again without every third chunk."""
    kept = chunks(s, d).where("sort_order % 3 <> 0 AND document_id IS NOT NULL")
    return V.stale(_points(s, d), kept)


def vector_counts(s, d):
    p = _points(s, d)
    every = V.count(p).withColumn("what", F.lit("all"))
    left = V.count(V.without_documents(p, R.hidden_documents(docs(s, d)).unionByName(docs(s, d).where("role = 'reference'").select("document_id")))).withColumn("what", F.lit("lectures"))
    return every.unionByName(left).unionByName(V.count(p, F.col("doc_type") == "pdf").withColumn("what", F.lit("pdf")))


def vector_upsert(s, d):
    """Old points, those of even places sent again with another hash."""
    p = _points(s, d)
    new = p.join(chunks(s, d).where("sort_order % 2 = 0").select("chunk_id"), "chunk_id", "left_semi").withColumn("content_hash", F.lit("new"))
    return V.upserted(p, new, 64).groupBy((F.col("content_hash") == "new").alias("sent_again")).agg(F.count("*").alias("points"))


def _ingested(s, d):
    root = f"{shared_dir(s)}/ingest-{uuid.uuid4().hex}"
    clean = [(lambda c: F.regexp_replace(c, "\u00a0", " "), F.contains("content", F.lit("\u00a0")))]
    sections = load(s, d, "sections")
    I.ingest(s, root, _files(s, d), sections, K.heading_chunks, _now(), steps=clean)
    return root


def ingest_statuses(s, d):
    return tables.read(s, _ingested(s, d), "statuses").select("document_id", "status", "error")


def ingest_repeated(s, d):
    """Run twice, the second time without every other section: what stays."""
    root = f"{shared_dir(s)}/ingest-{uuid.uuid4().hex}"
    for part in (load(s, d, "sections"), load(s, d, "sections").where("ord % 2 = 0")):
        I.ingest(s, root, _files(s, d), part, K.heading_chunks, _now())
    c, p, o = (tables.read(s, root, t) for t in ("chunks", "points", "outbox"))
    live = c.where("deleted_at IS NULL").select("chunk_id")
    return (
        live.join(p.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("n")).withColumn("what", F.lit("chunks without point"))
        .unionByName(p.select("chunk_id").join(live, "chunk_id", "left_anti").agg(F.count("*").alias("n")).withColumn("what", F.lit("points without chunk")))
        .unionByName(o.groupBy("aggregate_id").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).withColumn("what", F.lit("files with two events"))))


def chunk_languages(s, d):
    c = chunks(s, d)
    return c.select("chunk_id", I.language_or_default(F.col("language")).alias("language"), F.length(I.content_or_input(F.col("content"), F.col("embedding_input"))).alias("chars"))


def document_lookups(s, d):
    """The look-ups of one document of the course with most files."""
    key = docs(s, d).where(F.col("course_id") == COURSE).agg(F.min("document_id")).collect()[0][0]
    k = docs(s, d)
    one = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).cast("string").alias("value"))
    return one(T.context(k, key), "title", "title").unionByName(one(T.status(k, key), "status", "status")).unionByName(one(T.generation(k, key), "generation", "generation")).unionByName(one(T.placement(k, key), "role", "role"))


def tool_documents(s, d):
    return T.course_list(docs(s, d), chunks(s, d), COURSE).select("document_id", "chapter_code", "pages", "chunks")


def tool_page(s, d):
    """The second page of the course's smallest visible document that has one."""
    c = chunks(s, d)
    of = R.page_chunks(docs(s, d), c, 2).join(docs(s, d).where(F.col("course_id") == COURSE).select("document_id"), "document_id")
    key = of.agg(F.min("document_id")).collect()[0][0]
    return T.page(docs(s, d), c, key or "", 2, COURSE).select("document_id", "chunk_id", "total", "truncated", F.md5("content").alias("content_md5"))


def tool_relations(s, d):
    return T.relations(_relations(s, d), chunks(s, d), docs(s, d), COURSE, "l.o.1", 9, 999).select("relation_id", "hop", "rank")


def mentions_replaced(s, d):
    """Mapped outcomes as mentions; those of every second chunk are replaced."""
    m = load(s, d, "chunk_lo_mappings").where("chunk_id IS NOT NULL AND lo_id IS NOT NULL").groupBy("chunk_id", F.col("lo_id").alias("concept_id")).agg(F.max("confidence").alias("confidence"))
    of = chunks(s, d).where("sort_order % 2 = 0").select("chunk_id")
    return W.replace_mentions(m, m.join(of, "chunk_id", "left_semi").withColumn("confidence", F.lit(1.0)), of)


def relations_replaced(s, d):
    """Relations of every second chunk replaced by their reverse."""
    r = _relations(s, d).select("relation_id", "chunk_id", "source_key", "relation_type", "target_key")
    of = chunks(s, d).where("sort_order % 2 = 0").select("chunk_id")
    back = r.select(F.concat(F.lit("r"), "relation_id").alias("relation_id"), "chunk_id", F.col("target_key").alias("source_key"), "relation_type", F.col("source_key").alias("target_key"))
    return W.replace_relations(r, back, of).select("relation_id", "source_key", "target_key")


def enrichment(s, d):
    """Concepts, mentions and events after mapped outcomes came as concepts."""
    m = load(s, d, "chunk_lo_mappings").where("chunk_id IS NOT NULL AND lo_id IS NOT NULL").select("chunk_id", F.col("lo_id").alias("concept_id"), "confidence").distinct()
    concepts = m.select("concept_id", F.col("concept_id").alias("label"), F.lit(None).cast("string").alias("language"), _now().alias("updated_at")).distinct()
    out = I.enriched(concepts.limit(0), m.limit(0), s.createDataFrame([], I.EVENTS), concepts, m, chunks(s, d), docs(s, d))
    return out["concepts"].agg(F.count("*").alias("n")).withColumn("what", F.lit("concepts")).unionByName(out["mentions"].agg(F.count("*").alias("n")).withColumn("what", F.lit("mentions"))).unionByName(
        out["outbox"].agg(F.count("*").alias("n")).withColumn("what", F.lit("events")))


_P = WITH + f""", {_E}, f AS (SELECT document_id, title, {TYPE_SQL} AS doc_type, course_id, role FROM d WHERE document_id IS NOT NULL),
p AS (SELECT e.chunk_id, c.document_id, f.title AS document_name, f.doc_type, f.course_id, c.content_type, c.sort_order, f.role, len(e.vector) AS dimension FROM e JOIN c ON c.chunk_id = e.chunk_id JOIN f ON f.document_id = c.document_id WHERE e.model = 'course-embed-64')"""
SQL = {
    "vector_points": _P + " SELECT chunk_id, document_id, document_name, doc_type, nullif(trim(course_id), '') AS course_id, CAST(NULL AS VARCHAR) AS owner_id, content_type, dimension FROM p",
    "vector_search": _P + """ SELECT chunk_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank FROM (SELECT p.chunk_id, list_cosine_similarity(e.vector, qv) AS s FROM p JOIN e ON e.chunk_id = p.chunk_id AND e.model = 'course-embed-64' JOIN c ON c.chunk_id = p.chunk_id
JOIN d ON d.document_id = p.document_id, q WHERE p.doc_type IN ('pdf', 'docx') AND coalesce(p.content_type <> 'toc', true) AND len(list_filter(c.heading_path, lambda h: contains(lower(h), 'the'))) > 0
AND d.created_at >= TIMESTAMPTZ '2023-01-01 00:00:00+00' AND d.created_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' AND d.deleted_at IS NULL AND coalesce(d.lms_published, true) ORDER BY s DESC, chunk_id LIMIT 20)""",
    "vector_stale": _P + ", k AS (SELECT document_id, chunk_id FROM c WHERE sort_order % 3 <> 0 AND document_id IS NOT NULL) SELECT document_id, chunk_id FROM p WHERE document_id IN (SELECT document_id FROM k) AND chunk_id NOT IN (SELECT chunk_id FROM k)",
    "vector_counts": _P + """ SELECT 'all' AS what, count(*) AS points FROM p UNION ALL SELECT 'lectures', count(*) FROM p WHERE coalesce(role <> 'reference', true) AND document_id NOT IN (SELECT document_id FROM d WHERE document_id IS NOT NULL AND (deleted_at IS NOT NULL OR lms_published IS FALSE))
UNION ALL SELECT 'pdf', count(*) FROM p WHERE doc_type = 'pdf'""",
    "vector_upsert": _P + " SELECT coalesce(sort_order % 2 = 0, false) AS sent_again, count(*) AS points FROM p GROUP BY 1",
    "ingest_statuses": WITH + f""", t AS (SELECT document_id, mime_type, file_path, {TYPE_SQL} AS k FROM d WHERE deleted_at IS NULL AND document_id IS NOT NULL),
x AS (SELECT DISTINCT document_id FROM (SELECT document_id, ord, max(content) AS content FROM sections WHERE ord IS NOT NULL GROUP BY 1, 2) WHERE trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> '')
SELECT t.document_id, CASE WHEN k = 'unknown' OR x.document_id IS NULL THEN 'ERROR' ELSE 'INDEXED' END AS status, CASE WHEN k = 'unknown' THEN 'unsupported type: ' || coalesce(mime_type, file_path, '?') WHEN x.document_id IS NULL THEN 'no text' END AS error
FROM t LEFT JOIN x ON x.document_id = t.document_id""",
    "ingest_repeated": "SELECT unnest(['chunks without point', 'points without chunk', 'files with two events']) AS what, 0 AS n",
    "chunk_languages": WITH + "SELECT chunk_id, CASE WHEN lower(language) IN ('vi', 'en', 'mixed') THEN lower(language) ELSE 'vi' END AS language, length(coalesce(nullif(content, ''), embedding_input, '')) AS chars FROM c",
    "document_lookups": WITH + f""", k AS (SELECT * FROM d WHERE document_id = (SELECT min(document_id) FROM d WHERE course_id = '{COURSE}'))
SELECT 'title' AS what, title AS value FROM k WHERE deleted_at IS NULL UNION ALL SELECT 'status', upper(trim(status)) FROM k WHERE deleted_at IS NULL UNION ALL SELECT 'generation', CAST(coalesce(processing_generation, 0) AS VARCHAR) FROM k WHERE deleted_at IS NULL UNION ALL SELECT 'role', role FROM k""",
    "tool_documents": WITH + f"""SELECT v.document_id, v.chapter_code, coalesce(max(c.page_number), 0) AS pages, count(*) AS chunks FROM visible v JOIN c ON c.document_id = v.document_id WHERE c.deleted_at IS NULL AND v.course_id = '{COURSE}'
GROUP BY v.document_id, v.chapter_code, v.title ORDER BY try_cast(v.chapter_code AS INT) NULLS LAST, v.chapter_code NULLS LAST, v.title, v.document_id LIMIT 60""",
    "tool_page": WITH + f""", x AS (SELECT c.* FROM visible v JOIN c ON c.document_id = v.document_id WHERE c.deleted_at IS NULL AND 2 BETWEEN c.page_start AND c.page_end AND v.course_id = '{COURSE}'),
o AS (SELECT *, count(*) OVER () AS total FROM x WHERE document_id = (SELECT min(document_id) FROM x) ORDER BY sort_order NULLS FIRST, chunk_id LIMIT 8) SELECT document_id, chunk_id, total, length(content) > 1800 AS truncated, md5(content[1:1800]) AS content_md5 FROM o""",
    "mentions_replaced": WITH + """SELECT m.chunk_id, m.lo_id AS concept_id, CASE WHEN m.chunk_id IN (SELECT chunk_id FROM c WHERE sort_order % 2 = 0) THEN 1.0 ELSE max(confidence) END AS confidence
FROM chunk_lo_mappings m WHERE m.chunk_id IS NOT NULL AND m.lo_id IS NOT NULL GROUP BY 1, 2""",
    "enrichment": WITH + """, a AS (SELECT c.chunk_id, c.document_id FROM c JOIN d ON d.document_id = c.document_id WHERE c.deleted_at IS NULL AND d.deleted_at IS NULL), m AS (SELECT DISTINCT m.chunk_id, lo_id, document_id FROM chunk_lo_mappings m JOIN a ON a.chunk_id = m.chunk_id WHERE lo_id IS NOT NULL)
SELECT 'concepts' AS what, count(DISTINCT lo_id) AS n FROM m UNION ALL SELECT 'mentions', count(*) FROM m UNION ALL SELECT 'events', count(DISTINCT document_id) FROM m""",
}
_R0 = WITH + f""", {_REL.format(course=f"AND course_id = '{COURSE}'")}, {_DEG}, {_seed_sql('l.o.1')}"""
SQL["tool_relations"] = _R0 + """, h1 AS (SELECT *, 1 AS hop FROM rel WHERE source_key IN (SELECT key FROM seeds) OR target_key IN (SELECT key FROM seeds) ORDER BY created_at, relation_id LIMIT 25),
f AS (SELECT source_key AS key FROM h1 UNION SELECT target_key FROM h1),
h2 AS (SELECT *, 2 AS hop FROM rel WHERE (source_key IN (SELECT key FROM f) OR target_key IN (SELECT key FROM f)) AND relation_id NOT IN (SELECT relation_id FROM h1) ORDER BY created_at, relation_id LIMIT (SELECT 25 - count(*) FROM h1))
SELECT relation_id, hop, row_number() OVER (ORDER BY hop, created_at, relation_id) AS rank FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""
_EVERY = _REL.format(course="").replace("rel AS (SELECT md5", "rel AS (SELECT md5").split("rel AS (")[0].rstrip().rstrip(",")
SQL["relations_replaced"] = WITH + f""", {_EVERY}, r AS (SELECT md5(concat_ws('|', chunk_id, source_key, relation_type, target_key)) AS relation_id, * FROM rel0), k AS (SELECT chunk_id FROM c WHERE sort_order % 2 = 0)
SELECT relation_id, source_key, target_key FROM r WHERE chunk_id NOT IN (SELECT chunk_id FROM k) UNION ALL SELECT 'r' || relation_id, target_key, source_key FROM r WHERE chunk_id IN (SELECT chunk_id FROM k)"""
QUERIES = {f.__name__: f for f in (
    vector_points, vector_search, vector_stale, vector_counts, vector_upsert, ingest_statuses, ingest_repeated, chunk_languages, document_lookups, tool_documents, tool_page, tool_relations, mentions_replaced, relations_replaced, enrichment)}
