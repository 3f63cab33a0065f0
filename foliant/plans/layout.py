"""Queries over page lines, page reports and slides."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import layout as L
from foliant.plans.pages import _LINES, _R, _lines, _report
from foliant.session import load


def page_paragraphs(s, d):
    """Lines of sections as lines of pages; those of 14 points are headings."""
    lines = _lines(s, d).select(
        "document_id", "page", (F.col("ord") * 10_000 + F.col("pos")).alias("ord"), F.col("ord").alias("block_index"), "text", F.when(F.col("size") == 14.0, 2).otherwise(0).alias("level"))
    return L.paragraphs(lines).select("document_id", "page", "ord", "element_type", F.md5("content").alias("content_md5"))


def report_updates(s, d):
    r = _report(s, d).withColumn("reasons", F.array().cast("array<string>"))
    ocr = r.where("status = 'needs_ocr'")
    out = L.mark_parsed(L.mark_attempt(L.mark_failure(L.mark_failure(r, ocr, "layout"), ocr, "layout"), ocr, "layout"), ocr.where("page <= 2"), "layout", True)
    return out.select("document_id", "page", F.array_join("reasons", ",").alias("reasons"), F.array_join("attempts", ",").alias("attempts"), "parsed_by", "layout_aware")


def reread_plan(s, d):
    return L.reread_plan(_report(s, d), most_ranges=2)


def joined_slides(s, d):
    sec = load(s, d, "sections").where("element_type = 'slide' AND document_id IS NOT NULL").groupBy("document_id", "ord").agg(*(F.max(c).alias(c) for c in ("page_number", "heading", "content")))
    return L.slides(sec).select("document_id", "title", "first_page", "last_page", "slides", F.md5("content").alias("content_md5"))


SQL = {
    "page_paragraphs": f"""WITH {_LINES}, l AS (SELECT document_id, page, ord * 10000 + pos AS ord, ord AS blk, text, CASE WHEN size = 14.0 THEN 2 ELSE 0 END AS level FROM lines),
s AS (SELECT *, CASE WHEN level > 0 OR coalesce(lag(level) OVER w, 0) > 0 OR blk IS DISTINCT FROM lag(blk) OVER w THEN 1 ELSE 0 END AS st FROM l WINDOW w AS (PARTITION BY document_id, page ORDER BY ord)),
g AS (SELECT *, sum(st) OVER (PARTITION BY document_id, page ORDER BY ord) AS grp FROM s)
SELECT document_id, page, min(ord) AS ord, CASE WHEN max(level) > 0 THEN 'heading' ELSE 'paragraph' END AS element_type, md5(string_agg(text, chr(10) ORDER BY ord)) AS content_md5 FROM g GROUP BY document_id, page, grp""",
    "report_updates": f"""WITH {_R} SELECT document_id, page, CASE WHEN status = 'needs_ocr' THEN 'layout_failed' ELSE '' END AS reasons,
array_to_string(CASE WHEN status = 'needs_ocr' THEN list_concat(coalesce(attempts, []), ['layout']) ELSE attempts END, ',') AS attempts,
CASE WHEN status = 'needs_ocr' AND page <= 2 THEN 'layout' ELSE parsed_by END AS parsed_by, CASE WHEN status = 'needs_ocr' AND page <= 2 THEN true ELSE layout_aware END AS layout_aware FROM r""",
    "reread_plan": f"""WITH {_R}, p AS (SELECT document_id, count(*) FILTER (status = 'needs_ocr') AS need, count(*) AS pages, min(page) AS f, max(page) AS l FROM r GROUP BY 1),
n AS (SELECT r.document_id, page, page - row_number() OVER (PARTITION BY r.document_id ORDER BY page) AS run FROM r JOIN p ON p.document_id = r.document_id WHERE status = 'needs_ocr' AND need < 0.5 * pages),
g AS (SELECT document_id, min(page) AS first, max(page) AS last FROM n GROUP BY document_id, run), h AS (SELECT *, first - lag(last) OVER (PARTITION BY document_id ORDER BY first) AS gap FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY gap DESC NULLS LAST, first DESC) AS rank FROM h),
m AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND rank <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY first) AS grp FROM k)
SELECT document_id, f AS first, l AS last, true AS whole FROM p WHERE need > 0 AND need >= 0.5 * pages UNION ALL SELECT document_id, min(first), max(last), false FROM m GROUP BY document_id, grp""",
    "joined_slides": r"""WITH s AS (SELECT document_id, ord, max(page_number) AS pn, max(heading) AS heading, max(content) AS content FROM sections WHERE element_type = 'slide' AND document_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN length(trim(coalesce(heading, ''))) > 0 THEN trim(regexp_replace(regexp_replace(heading, '\s+', ' ', 'g'), '(?i)\s*(?:\((?:tiếp(?: theo)?|cont\.?|continued|suite|forts\.?|\d+)\)|(?:cont\.|continued))\s*$', '')) END AS t0 FROM s),
f AS (SELECT *, coalesce(t0, last_value(t0 IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pn NULLS FIRST, ord ROWS UNBOUNDED PRECEDING), 'Slide ' || pn) AS title FROM t),
g AS (SELECT *, sum(ch) OVER (PARTITION BY document_id ORDER BY pn NULLS FIRST, ord) AS grp FROM (SELECT *, CASE WHEN title = lag(title) OVER (PARTITION BY document_id ORDER BY pn NULLS FIRST, ord) THEN 0 ELSE 1 END AS ch FROM f))
SELECT document_id, min(title) AS title, min(pn) AS first_page, max(pn) AS last_page, count(*) AS slides, md5(string_agg(content, chr(10) ORDER BY pn NULLS FIRST, ord)) AS content_md5 FROM g GROUP BY document_id, grp""",
}
QUERIES = {f.__name__: f for f in (page_paragraphs, report_updates, reread_plan, joined_slides)}
