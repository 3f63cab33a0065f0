"""Queries over pages, sections and tables of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import pages as P
from foliant.session import load


def _report(s, d):
    return load(s, d, "page_report").groupBy("document_id", "page").agg(
        F.max("status").alias("status"), F.max("chars").alias("chars"), F.max("attempts").alias("attempts"), F.max("parsed_by").alias("parsed_by"), F.max("layout_aware").alias("layout_aware"))


def _totals(s, d):
    return load(s, d, "documents_meta").where("document_id IS NOT NULL").select("document_id", F.col("page_count").alias("pages_total"))


def coverage_report(s, d):
    return P.coverage(_report(s, d), _totals(s, d))


def missing_text(s, d):
    return P.missing_text(_report(s, d))


def page_sets(s, d):
    return P.page_sets(_report(s, d)).select("document_id", "page", F.explode("sets").alias("page_set"))


def _ocr(s, d):
    return _report(s, d).where("status = 'needs_ocr'")


def page_ranges(s, d):
    return P.page_ranges(_ocr(s, d))


def page_ranges_capped(s, d):
    return P.bounded_ranges(P.page_ranges(_ocr(s, d)), 3)


def page_ranges_text(s, d):
    return P.format_ranges(P.page_ranges(_ocr(s, d)))


def page_classification(s, d):
    """Metrics of pages from their sections and reports: a page that the
    report gives to OCR is an image, others have a tenth of it for each image,
    code stands for drawings."""
    sec = load(s, d, "sections").where("page_number IS NOT NULL").select("document_id", "ord", "content", "page_number", "element_type", F.size(F.coalesce("images", F.array())).alias("images")).distinct()
    m = sec.groupBy("document_id", F.col("page_number").alias("page")).agg(
        F.sum(F.coalesce(F.length("content"), F.lit(0))).cast("int").alias("char_count"), F.count_if(F.col("element_type") == "table").cast("int").alias("table_count"),
        F.sum("images").alias("images"), F.count_if(F.col("element_type") == "code").alias("drawing_count"))
    m = m.join(_report(s, d).select("document_id", "page", "status"), ["document_id", "page"], "left").withColumns({
        "image_area_ratio": F.when(F.col("status") == "needs_ocr", 0.9).otherwise(F.least(F.col("images") * 0.1, F.lit(0.4))), "multi_column": F.col("status") == "complex_layout"}).drop("status")
    return P.classify(m).select("document_id", "page", "char_count", "status", F.array_join("reasons", ",").alias("reasons"))


def _lines(s, d):
    """Lines of sections as page lines; the first and last of a page as its margin."""
    sec = load(s, d, "sections").where("page_number IS NOT NULL AND content IS NOT NULL").select("document_id", "ord", "page_number", "content").distinct()
    cut = sec.select("document_id", F.col("page_number").alias("page"), "ord", F.posexplode(F.split("content", "\n")), F.size(F.split("content", "\n")).alias("n"))
    size = F.when(F.length("col") < 30, 14.0).when(F.length("col") < 60, 12.0).otherwise(10.0)
    return cut.where("trim(col) <> ''").select("document_id", "page", "ord", "pos", F.col("col").alias("text"), size.alias("size"), (F.length("col") < 20).alias("bold"),
                                              ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).alias("margin"))


def running_marginals(s, d):
    return P.running_marginals(_lines(s, d))


def lines_without_marginals(s, d):
    return P.without_marginals(_lines(s, d)).groupBy("document_id").agg(F.count("*").alias("lines"))


def weighted_median_size(s, d):
    return P.body_size(_lines(s, d))


def heading_levels(s, d):
    return P.heading_levels(_lines(s, d)).groupBy("document_id", "level").agg(F.count("*").alias("lines"))


def slide_decks(s, d):
    sec = load(s, d, "sections").where("page_number IS NOT NULL").select("document_id", "ord", "content", "page_number", "element_type").distinct()
    pages = sec.groupBy("document_id", "page_number").agg(F.sum(F.length("content")).alias("chars"), F.max(F.when(F.col("element_type") == "slide", 16.0).otherwise(8.5)).alias("width"), F.lit(9.0).alias("height"))
    return P.slide_decks(pages)


def merged_pages(s, d):
    """Pages that need another reading, replaced by the other reading."""
    sec = load(s, d, "sections").where("page_number IS NOT NULL").select("document_id", "ord", "page_number", "content").distinct()
    other = sec.withColumn("content", F.concat(F.lit("re-read: "), "content"))
    return P.merge_pages(sec, other, _ocr(s, d)).select("document_id", "ord", F.md5("content").alias("content_md5"))


def _sections(s, d):
    return load(s, d, "sections").groupBy("document_id", "ord").agg(F.max("content").alias("content"), F.max("heading").alias("heading"))


def toc_score(s, d):
    return P.toc_scores(_sections(s, d)).select("document_id", "ord", "score")


def toc_sections(s, d):
    return P.toc_sections(P.toc_scores(_sections(s, d)))


def pages_at(s, d):
    """Page of every thousandth character of a document's text."""
    from pyspark.sql import Window

    sec = load(s, d, "sections").groupBy("document_id", "ord").agg(F.max(F.length("content")).cast("bigint").alias("n"), F.max("page_number").alias("page")).where("n > 0")
    end = F.sum("n").over(Window.partitionBy("document_id").orderBy("ord"))
    spans = sec.select("document_id", "page", (end - F.col("n")).alias("start"), (end - 1).alias("end"))
    asked = spans.groupBy("document_id").agg(F.max("end").alias("e")).select("document_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("e"), F.lit(1000).cast("bigint"))).alias("offset"))
    return P.pages_at(asked, spans)


def page_measures(s, d):
    """Spans from the lines of sections, three words each; two thirds of a
    page's images cover it."""
    lines = _lines(s, d).where("length(text) < 4000")
    words = F.split(F.btrim("text"), " ")
    spans = lines.select("document_id", "page", (F.col("ord") * 100_000 + F.col("pos")).alias("ord"), F.posexplode(words).alias("span", "text"), "size", F.when(F.col("bold"), 16).otherwise(0).alias("flags"),
                         F.lit(100.0).alias("height"), F.struct(F.lit(0.0).alias("x0"), F.when(F.col("margin"), 1.0).otherwise(40.0).alias("y0"), F.lit(9.0).alias("x1"), F.when(F.col("margin"), 5.0).otherwise(50.0).alias("y1")).alias("bbox"))
    sec = load(s, d, "sections").where("page_number IS NOT NULL").select("document_id", "ord", "page_number", "element_type", F.size(F.coalesce("images", F.array())).alias("images")).distinct()
    areas = sec.groupBy("document_id", F.col("page_number").alias("page")).agg(F.least(F.sum("images") * 0.3, F.lit(1.0)).alias("image_area_ratio"), F.count_if(F.col("element_type") == "code").cast("int").alias("drawing_count"))
    layout = sec.groupBy("document_id", F.col("page_number").alias("page")).agg((F.count("*") > 2).alias("multi_column"), F.count_if(F.col("element_type") == "table").cast("int").alias("table_count"))
    rows = P.report_rows(P.classify(P.measured(P.lines_of(spans), areas, layout)), "text")
    return rows.select("document_id", "page", "status", "chars", F.array_join("reasons", ",").alias("reasons"), "parsed_by")


def images_in_budget(s, d):
    sec = load(s, d, "sections").where("document_id IS NOT NULL").groupBy("document_id", "ord").agg(F.max("images").alias("images"), F.max(F.length("content")).alias("n"))
    return P.images_within(sec.select("document_id", F.col("ord").alias("page"), F.posexplode("images").alias("nth", "name"), (F.col("n") * 10).alias("bytes")), 9_000).select("document_id", "page", "nth", "name")


_R = """r AS (SELECT document_id, page, max(status) AS status, max(chars) AS chars, max(attempts) AS attempts, max(parsed_by) AS parsed_by, max(layout_aware) AS layout_aware FROM page_report GROUP BY 1, 2)"""
_RANGES = f"""{_R}, n AS (SELECT document_id, page, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS run FROM r WHERE status = 'needs_ocr' AND page IS NOT NULL),
ranges AS (SELECT document_id, min(page) AS first, max(page) AS last FROM n GROUP BY document_id, run)"""
_LINES = """sec AS (SELECT DISTINCT document_id, ord, page_number AS page, content FROM sections WHERE page_number IS NOT NULL AND content IS NOT NULL),
x AS (SELECT document_id, ord, page, string_split(content, chr(10)) AS ls FROM sec), y AS (SELECT document_id, ord, page, len(ls) AS n, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS pos FROM x),
lines AS (SELECT *, CASE WHEN length(text) < 30 THEN 14.0 WHEN length(text) < 60 THEN 12.0 ELSE 10.0 END::DOUBLE AS size, length(text) < 20 AS bold, pos = 0 OR pos = n - 1 AS margin,
  regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS key FROM y WHERE trim(text) <> '')"""
_MARG = """m AS (SELECT document_id, key, count(DISTINCT page) AS pages FROM lines WHERE margin GROUP BY 1, 2), t AS (SELECT document_id, count(DISTINCT page) AS total FROM lines GROUP BY 1),
marg AS (SELECT m.document_id, key, pages FROM m JOIN t ON m.document_id = t.document_id WHERE pages >= greatest(3, ceil(total * 0.3)))"""
_ENDS = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TOC = f"""sec AS (SELECT document_id, ord, trim(coalesce(max(content), ''), {_TRIM}) AS content, lower(coalesce(max(heading), '')) AS heading FROM sections GROUP BY 1, 2),
x AS (SELECT *, list_filter(list_transform(regexp_split_to_array(content, {_ENDS}), lambda v: trim(v, {_TRIM})), lambda v: v <> '') AS ls,
  row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS idx, count(*) OVER (PARTITION BY document_id) AS total FROM sec),
y AS (SELECT *, len(ls) AS n, coalesce(len(list_filter(ls, lambda v: regexp_matches(v, '\\.{{3,}}\\s*\\d+\\s*$'))) * 1.0 / nullif(len(ls), 0), 0) AS leader,
  coalesce(len(list_filter(ls, lambda v: length(v) < 80)) * 1.0 / nullif(len(ls), 0), 0) AS short,
  regexp_matches(heading, 'mục lục|table of contents|danh mục') OR length(content) <= 60 AND regexp_matches(lower(content), 'mục lục|table of contents|danh mục') AS word FROM x),
scored AS (SELECT document_id, ord, idx, total, CAST(CASE WHEN word THEN 2 ELSE 0 END + CASE WHEN idx <= 0.2 * total THEN 1 ELSE 0 END
  + CASE WHEN leader >= 0.4 THEN 2 WHEN leader >= 0.2 THEN 1 ELSE 0 END + CASE WHEN n >= 5 AND short >= 0.7 THEN 1 ELSE 0 END AS INT) AS score FROM y)"""
_SETS = """s AS (SELECT *, status IN ('needs_ocr', 'complex_layout') AND coalesce(len(attempts), 0) <= 1 AS needs_fallback, parsed_by IS NULL AND status = 'needs_ocr' AND coalesce(len(attempts), 0) <= 1 AS unprocessed,
  parsed_by IS NULL AND status = 'needs_ocr' AND coalesce(len(attempts), 0) > 1 AS no_text, status = 'complex_layout' AND NOT coalesce(layout_aware, false) AS degraded FROM r)"""


def _listed(name: str) -> str:
    return f"""l_{name} AS (SELECT document_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM (SELECT document_id, min(page) AS a, max(page) AS b FROM
  (SELECT document_id, page, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS run FROM (SELECT DISTINCT document_id, page FROM s WHERE {name} AND page IS NOT NULL)) GROUP BY document_id, run) GROUP BY 1)"""


SQL = {
    "coverage_report": f"""WITH {_R}, {_SETS}, {_listed('unprocessed')}, {_listed('no_text')}, {_listed('degraded')},
t AS (SELECT document_id, max(page_count) AS total FROM documents_meta WHERE document_id IS NOT NULL GROUP BY 1),
br AS (SELECT document_id, string_agg(parsed_by || ':' || n, ',' ORDER BY parsed_by || ':' || n) AS by_reader FROM (SELECT document_id, parsed_by, count(*) AS n FROM r WHERE parsed_by IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT document_id, count(*) AS pages, count(*) FILTER (status = 'text') AS text_pages, count(*) FILTER (status = 'needs_ocr') AS ocr_pages, count(*) FILTER (status = 'complex_layout') AS complex_pages,
  count(*) FILTER (status = 'empty') AS empty_pages, count(*) FILTER (status IS NULL) AS unknown_pages, count(*) FILTER (parsed_by IS NOT NULL OR status = 'empty') AS resolved,
  count(*) FILTER (unprocessed) AS unprocessed, count(*) FILTER (no_text) AS no_text, count(*) FILTER (degraded) AS degraded, max(page) AS examined FROM s GROUP BY 1)
SELECT p.* EXCLUDE (examined), by_reader, l_unprocessed.pages AS unprocessed_pages, l_no_text.pages AS no_text_pages, l_degraded.pages AS degraded_pages,
CAST(greatest(coalesce(total, examined) - examined, 0) AS INT) AS skipped, unprocessed + no_text + degraded + greatest(coalesce(total, examined) - examined, 0) = 0 AS complete
FROM p LEFT JOIN t USING (document_id) LEFT JOIN br USING (document_id) LEFT JOIN l_unprocessed USING (document_id) LEFT JOIN l_no_text USING (document_id) LEFT JOIN l_degraded USING (document_id)""",
    "missing_text": f"""WITH {_R}, {_SETS}, {_listed('unprocessed')} SELECT l.document_id, l.pages, count(DISTINCT CASE WHEN unprocessed THEN page END) AS missing, count(*) AS examined
FROM l_unprocessed l JOIN s ON s.document_id = l.document_id GROUP BY 1, 2""",
    "page_sets": f"""WITH {_R}, {_SETS} SELECT document_id, page, unnest(list_filter([CASE WHEN needs_fallback THEN 'needs_fallback' END, CASE WHEN unprocessed THEN 'unprocessed' END,
CASE WHEN no_text THEN 'no_text' END, CASE WHEN degraded THEN 'degraded' END], lambda x: x IS NOT NULL)) AS page_set FROM s""",
    "page_ranges": f"WITH {_RANGES} SELECT document_id, first, last FROM ranges",
    "page_ranges_capped": f"""WITH {_RANGES}, g AS (SELECT *, first - lag(last) OVER (PARTITION BY document_id ORDER BY first) AS gap FROM ranges),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY gap DESC NULLS LAST, first DESC) AS rank FROM g),
h AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND rank <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY first) AS grp FROM k)
SELECT document_id, min(first) AS first, max(last) AS last FROM h GROUP BY document_id, grp""",
    "page_ranges_text": f"""WITH {_RANGES} SELECT document_id, string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE first || '-' || last END, ', ' ORDER BY first) AS pages FROM ranges GROUP BY 1""",
    "page_classification": f"""WITH {_R}, sec AS (SELECT DISTINCT document_id, ord, content, page_number, element_type, coalesce(len(images), 0) AS images FROM sections WHERE page_number IS NOT NULL),
m AS (SELECT document_id, page_number AS page, CAST(sum(coalesce(length(content), 0)) AS INT) AS chars, count(*) FILTER (element_type = 'table') AS tables, sum(images) AS images, count(*) FILTER (element_type = 'code') AS drawings FROM sec GROUP BY 1, 2),
x AS (SELECT m.*, m.chars >= 40 AS enough, CASE WHEN r.status = 'needs_ocr' THEN 0.9 ELSE least(images * 0.1, 0.4) END AS ratio, coalesce(r.status = 'complex_layout', false) AS cols FROM m LEFT JOIN r ON r.document_id = m.document_id AND r.page = m.page)
SELECT document_id, page, chars AS char_count,
CASE WHEN enough AND (cols OR tables > 0) THEN 'complex_layout' WHEN enough THEN 'text' WHEN ratio > 0 OR drawings > 0 THEN 'needs_ocr' WHEN chars > 0 THEN 'text' ELSE 'empty' END AS status,
concat_ws(',', CASE WHEN enough AND cols THEN 'multi_column' END, CASE WHEN enough AND tables > 0 THEN 'table_detected' END, CASE WHEN NOT enough AND ratio >= 0.5 THEN 'image_page' END,
CASE WHEN NOT enough AND ratio < 0.5 AND (ratio > 0 OR drawings > 0) THEN 'no_text_layer' END, CASE WHEN NOT enough AND ratio = 0 AND drawings = 0 AND chars > 0 THEN 'sparse_text' END) AS reasons FROM x""",
    "running_marginals": f"WITH {_LINES}, {_MARG} SELECT * FROM marg",
    "lines_without_marginals": f"""WITH {_LINES}, {_MARG} SELECT document_id, count(*) AS lines FROM lines l
WHERE NOT (margin AND EXISTS (SELECT 1 FROM marg g WHERE g.document_id = l.document_id AND g.key = l.key)) GROUP BY 1""",
    "weighted_median_size": f"""WITH {_LINES}, p AS (SELECT document_id, size, sum(length(text)) AS n FROM lines GROUP BY 1, 2),
q AS (SELECT *, sum(n) OVER (PARTITION BY document_id ORDER BY size) AS run, sum(n) OVER (PARTITION BY document_id) AS total FROM p)
SELECT document_id, coalesce(min(CASE WHEN 2 * run >= total THEN size END), 12.0) AS body_size FROM q GROUP BY 1""",
    "heading_levels": f"""WITH {_LINES}, th AS (SELECT document_id, median(size) AS body, max(size) AS top FROM lines GROUP BY 1),
g AS (SELECT *, CASE WHEN top > body THEN (top - body) / 3 ELSE 2.0 END AS gap FROM th),
z AS (SELECT l.document_id, CASE WHEN size >= body + gap * 2.2::DOUBLE THEN 1 WHEN size >= body + gap * 1.5::DOUBLE THEN 2 WHEN size >= body + gap * 0.8::DOUBLE OR bold AND size > body THEN 3 ELSE 0 END AS level FROM lines l JOIN g ON g.document_id = l.document_id)
SELECT document_id, level, count(*) AS lines FROM z GROUP BY 1, 2""",
    "slide_decks": """WITH sec AS (SELECT DISTINCT document_id, ord, content, page_number, element_type FROM sections WHERE page_number IS NOT NULL),
p AS (SELECT document_id, page_number, sum(length(content)) AS chars, max(CASE WHEN element_type = 'slide' THEN 16.0 ELSE 8.5 END) AS width FROM sec GROUP BY 1, 2)
SELECT document_id, avg(CASE WHEN width >= 1.2 * 9.0 THEN 1.0 ELSE 0.0 END) >= 0.8 AND median(chars) <= 1500 AS slides FROM p GROUP BY 1""",
    "merged_pages": f"""WITH {_R}, sec AS (SELECT DISTINCT document_id, ord, page_number, content FROM sections WHERE page_number IS NOT NULL)
SELECT document_id, ord, md5(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.document_id = sec.document_id AND r.page = sec.page_number AND r.status = 'needs_ocr') THEN 're-read: ' || content ELSE content END) AS content_md5 FROM sec""",
    "toc_score": f"WITH {_TOC} SELECT document_id, ord, score FROM scored",
    "toc_sections": f"""WITH {_TOC}, a AS (SELECT *, sum(CASE WHEN score >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY idx) AS run FROM scored),
b AS (SELECT *, min(idx) OVER (PARTITION BY document_id, run) AS begins FROM a WHERE score >= 2) SELECT document_id, ord, score FROM b WHERE begins <= greatest(3, floor(total * 0.25)) + 5""",
    "page_measures": f"""WITH {_LINES}, t AS (SELECT document_id, page, sum(length(replace(trim(text), ' ', ''))) AS chars FROM lines WHERE NOT margin AND length(text) < 4000 GROUP BY 1, 2),
sec2 AS (SELECT DISTINCT document_id, ord, page_number AS page, element_type, coalesce(len(images), 0) AS images FROM sections WHERE page_number IS NOT NULL),
g AS (SELECT document_id, page, least(sum(images) * 0.3, 1.0) AS ratio, count(*) FILTER (element_type = 'code') AS drawings, count(*) > 2 AS cols, count(*) FILTER (element_type = 'table') AS tables FROM sec2 GROUP BY 1, 2),
px AS (SELECT g.document_id, g.page, coalesce(chars, 0) AS chars, ratio, cols, tables, CASE WHEN coalesce(chars, 0) < 40 AND ratio < 0.5 THEN drawings ELSE 0 END AS drawings, coalesce(chars, 0) >= 40 AS enough FROM g LEFT JOIN t ON t.document_id = g.document_id AND t.page = g.page),
py AS (SELECT *, CASE WHEN enough AND (cols OR tables > 0) THEN 'complex_layout' WHEN enough THEN 'text' WHEN ratio > 0 OR drawings > 0 THEN 'needs_ocr' WHEN chars > 0 THEN 'text' ELSE 'empty' END AS status FROM px)
SELECT document_id, page, status, CAST(chars AS INT) AS chars, concat_ws(',', CASE WHEN enough AND cols THEN 'multi_column' END, CASE WHEN enough AND tables > 0 THEN 'table_detected' END, CASE WHEN NOT enough AND ratio >= 0.5 THEN 'image_page' END,
CASE WHEN NOT enough AND ratio < 0.5 AND (ratio > 0 OR drawings > 0) THEN 'no_text_layer' END, CASE WHEN NOT enough AND ratio = 0 AND drawings = 0 AND chars > 0 THEN 'sparse_text' END) AS reasons,
CASE WHEN chars > 0 AND status <> 'needs_ocr' THEN 'text' END AS parsed_by FROM py""",
    "images_in_budget": """WITH s AS (SELECT document_id, ord, max(images) AS images, max(length(content)) AS n FROM sections WHERE document_id IS NOT NULL GROUP BY 1, 2), i AS (SELECT document_id, ord AS page, unnest(images) AS name, generate_subscripts(images, 1) - 1 AS nth, coalesce(n * 10, 0) AS b FROM s),
r AS (SELECT *, sum(b) OVER (PARTITION BY document_id ORDER BY page, nth) AS run FROM i) SELECT document_id, page, nth, name FROM r WHERE run <= 9000""",
    "pages_at": """WITH sec AS (SELECT document_id, ord, max(length(content)) AS n, max(page_number) AS page FROM sections GROUP BY 1, 2 HAVING max(length(content)) > 0),
sp AS (SELECT document_id, page, sum(n) OVER (PARTITION BY document_id ORDER BY ord) - n AS s, sum(n) OVER (PARTITION BY document_id ORDER BY ord) - 1 AS e FROM sec),
o AS (SELECT document_id, unnest(range(0, CAST(max(e) + 1 AS BIGINT), 1000)) AS "offset" FROM sp GROUP BY document_id)
SELECT o.document_id, o."offset", sp.page FROM o JOIN sp ON sp.document_id = o.document_id AND o."offset" BETWEEN sp.s AND sp.e""",
}
QUERIES = {f.__name__: f for f in (
    coverage_report, missing_text, page_sets, page_ranges, page_ranges_capped, page_ranges_text, page_classification, running_marginals, lines_without_marginals, weighted_median_size,
    heading_levels, slide_decks, merged_pages, page_measures, images_in_budget, toc_score, toc_sections, pages_at)}
