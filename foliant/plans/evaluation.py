"""Queries of the evaluation of retrieval and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import evaluation as E
from foliant.operators import reads as R
from foliant.operators import retrieval as T
from foliant.plans import search as Q
from foliant.plans.store import chunks, docs
from foliant.session import load


def _asked(s, d):
    """Outcomes as questions, with the vector of their surest chunk."""
    best = R.chunks_for_outcomes(Q._mappings(s, d), chunks(s, d), docs(s, d), 20)
    v = Q._of_model(s, d)
    asked = best.join(v.select("chunk_id", "course_id", "vector"), "chunk_id").groupBy(F.col("lo_id").alias("query_id")).agg(F.min_by(F.struct("course_id", "vector", "chunk_id"), "rank").alias("q"))
    return v, asked.select("query_id", "q.course_id", "q.vector", F.col("q.chunk_id").alias("of"))


def _ranked(s, d):
    v, asked = _asked(s, d)
    return T.rank_all(v, asked, 10, within=("course_id",)).join(chunks(s, d).select("chunk_id", "document_id", "page_start", "page_end", "page_number", "heading_path"), "chunk_id"), asked


def evidence_eval(s, d):
    """Evidence of a question: the pages of the chunks its outcome is mapped to."""
    ranked, asked = _ranked(s, d)
    evidence = Q._mappings(s, d).join(chunks(s, d).where("page_number IS NOT NULL AND document_id IS NOT NULL"), "chunk_id").select(F.col("lo_id").alias("query_id"), "document_id", F.col("page_number").alias("page"))
    return E.evidence_metrics(ranked, evidence.join(asked.select("query_id"), "query_id", "left_semi"))


def heading_eval(s, d):
    """The heading path of a question's own chunk must be found again."""
    ranked, asked = _ranked(s, d)
    expected = asked.join(chunks(s, d).select(F.col("chunk_id").alias("of"), "document_id", F.col("heading_path").alias("path")), "of").select("query_id", "document_id", "path")
    return E.path_metrics(ranked, expected)


def chunk_structure(s, d):
    titles = load(s, d, "sections").where("heading IS NOT NULL AND document_id IS NOT NULL").select("document_id", F.col("page_number").alias("page"), F.col("heading").alias("title")).distinct()
    return E.structure(chunks(s, d).where("document_id IS NOT NULL"), titles)


def document_extent(s, d):
    sec = load(s, d, "sections").where("document_id IS NOT NULL").groupBy("document_id", "ord").agg(F.max("content").alias("content"), F.max("heading").alias("heading"))
    return E.document_extent(sec).select("document_id", "chars", "sections", F.size("headings").alias("n_headings"), F.md5(F.array_join("headings", "\n")).alias("headings_md5"))


def chunk_variants(s, d):
    """The stored chunks against themselves without contents, as variants."""
    c = chunks(s, d).select("content", "content_type")
    return E.variants({"all": c, "no contents": c.where(T.payload_filter())}).groupBy("variant").agg(F.count("*").alias("chunks"), F.count_distinct(E.digest(F.col("content"))).alias("texts"))


_Q = Q.WITH + f""", {Q._OC}, {Q._E}, v AS (SELECT * FROM e WHERE model = 'course-embed-64'),
a AS (SELECT lo_id, first(course_id ORDER BY rank) AS course_id, first(vector ORDER BY rank) AS qv, first(chunk_id ORDER BY rank) AS of FROM (SELECT oc.lo_id, oc.rank, v.chunk_id, v.course_id, v.vector FROM oc JOIN v ON v.chunk_id = oc.chunk_id WHERE rank <= 20) GROUP BY 1),
r AS (SELECT * FROM (SELECT a.lo_id, v.chunk_id, row_number() OVER (PARTITION BY a.lo_id ORDER BY list_cosine_similarity(v.vector, qv) DESC, v.chunk_id) AS rank FROM a JOIN v ON v.course_id = a.course_id) WHERE rank <= 10)"""
SQL = {
    "evidence_eval": _Q + """, ev AS (SELECT DISTINCT m.lo_id, c.document_id, c.page_number AS page FROM m JOIN c ON c.chunk_id = m.chunk_id WHERE c.page_number IS NOT NULL AND c.document_id IS NOT NULL AND m.lo_id IN (SELECT lo_id FROM a)),
k AS (SELECT ev.lo_id, ev.document_id, ev.page, min(CASE WHEN page BETWEEN coalesce(page_start, page_number) AND coalesce(page_end, page_number) THEN rank END) AS first, min(CASE WHEN page = page_number THEN rank END) AS strict
  FROM ev LEFT JOIN (SELECT r.lo_id, r.rank, c.document_id, c.page_start, c.page_end, c.page_number FROM r JOIN c ON c.chunk_id = r.chunk_id) x ON x.lo_id = ev.lo_id AND x.document_id = ev.document_id GROUP BY 1, 2, 3),
q1 AS (SELECT lo_id, min(first) AS first, min(strict) AS strict, avg(CASE WHEN first <= 6 THEN 1.0 ELSE 0.0 END) AS recall FROM k GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 3) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 3) AS hit_3, round(avg(CASE WHEN first <= 6 THEN 1.0 ELSE 0 END), 3) AS hit_6,
round(avg(recall), 3) AS recall_6, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 3) AS mrr_10, round(avg(CASE WHEN strict <= 6 THEN 1.0 ELSE 0 END), 3) AS strict_6 FROM q1""",
    "heading_eval": _Q + """, x AS (SELECT a.lo_id, a0.document_id AS d0, a0.heading_path AS p0, c.document_id, c.heading_path AS p, r.rank FROM a JOIN c a0 ON a0.chunk_id = a.of LEFT JOIN r ON r.lo_id = a.lo_id LEFT JOIN c ON c.chunk_id = r.chunk_id),
k AS (SELECT lo_id, min(CASE WHEN document_id = d0 AND p[1:greatest(least(len(p), len(p0)), 1)] = p0[1:greatest(least(len(p), len(p0)), 1)] THEN rank END) AS first FROM x GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 3) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 3) AS mrr_10 FROM k""",
    "chunk_structure": Q.WITH + """, b AS (SELECT * FROM c WHERE document_id IS NOT NULL), t AS (SELECT DISTINCT document_id, page_number AS page, lower(trim(heading)) AS title FROM sections WHERE heading IS NOT NULL AND document_id IS NOT NULL AND trim(heading) <> ''),
kp AS (SELECT t.document_id, t.title, bool_or(contains(lower(concat_ws(chr(10), array_to_string(b.heading_path, chr(10)), b.content)), t.title)) AS kept FROM (SELECT DISTINCT document_id, title FROM t) t JOIN b ON b.document_id = t.document_id GROUP BY 1, 2),
kc AS (SELECT document_id, count(*) AS titles, count(*) FILTER (kept) AS titles_kept FROM kp GROUP BY 1), rt AS (SELECT document_id, count(*) AS n FROM b WHERE len(heading_path) > 0 AND (document_id, page_number, lower(trim(heading_path[-1]))) IN (SELECT document_id, page, title FROM t WHERE page IS NOT NULL) GROUP BY 1),
p AS (SELECT document_id, count(*) AS chunks, median(length(content)) AS median_chars, count(*) FILTER (length(content) < 200) AS short, count(*) FILTER (page_end > page_start) AS multi_page FROM b GROUP BY 1)
SELECT p.*, coalesce(titles, 0) AS titles, coalesce(titles_kept, 0) AS titles_kept, round(coalesce(rt.n, 0) * 1.0 / chunks, 4) AS label_accuracy FROM p LEFT JOIN kc USING (document_id) LEFT JOIN rt USING (document_id)""",
    "document_extent": """WITH s AS (SELECT document_id, ord, max(content) AS content, max(heading) AS heading FROM sections WHERE document_id IS NOT NULL GROUP BY 1, 2), h AS (SELECT document_id, heading, min(ord) AS at0 FROM s WHERE trim(heading) <> '' GROUP BY 1, 2),
l AS (SELECT document_id, list(heading ORDER BY at0, heading) AS hs FROM h GROUP BY 1), z AS (SELECT document_id, sum(coalesce(length(content), 0)) AS chars, count(*) AS sections FROM s GROUP BY 1)
SELECT z.document_id, chars, sections, len(hs) AS n_headings, md5(array_to_string(hs, chr(10))) AS headings_md5 FROM z LEFT JOIN l ON l.document_id = z.document_id""",
    "chunk_variants": Q.WITH + "SELECT 'all' AS variant, count(*) AS chunks, count(DISTINCT sha1(content)[1:10]) AS texts FROM c UNION ALL SELECT 'no contents', count(*), count(DISTINCT sha1(content)[1:10]) FROM c WHERE coalesce(content_type <> 'toc', true)",
}
QUERIES = {f.__name__: f for f in (evidence_eval, heading_eval, chunk_structure, document_extent, chunk_variants)}
