"""Queries of the syllabus reader: syllabi are written from the tables, one a
course, and read again; the SQL states what must come back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import curriculum as C
from foliant.operators import syllabus as S
from foliant.plans import curriculum as K
from foliant.session import load


def _lines(s, d):
    """Header, and a section 4.2 with each outcome over two lines."""
    lo = load(s, d, "learning_outcomes").where("course_id IS NOT NULL AND code IS NOT NULL AND statement_vi IS NOT NULL").groupBy("course_id", "code").agg(F.max("statement_vi").alias("vi"), F.max("statement_en").alias("en"))
    nth = F.row_number().over(Window.partitionBy("course_id").orderBy("code"))
    text = F.concat_ws("\n", F.concat_ws(" - ", "code", "vi"), F.concat(F.lit("("), "en", F.lit(")")))
    body = lo.select(F.col("course_id").alias("document_id"), F.lit(2).alias("page"), (nth * 10).alias("ord"), F.posexplode(F.split(text, "\n"))).select("document_id", "page", (F.col("ord") + F.col("pos")).alias("ord"), F.col("col").alias("text"))
    c = load(s, d, "courses").where("course_id IS NOT NULL").select("course_id", "code", "name").distinct()
    head = c.select(F.col("course_id").alias("document_id"), F.lit(1).alias("page"), F.posexplode(F.array(
        F.concat(F.lit("Mã học phần (Course ID): "), F.upper("code")), F.concat(F.lit("Số tín chỉ: "), F.length("name").cast("string")), F.lit("4.2. Chuẩn đầu ra"))).alias("ord", "text"))
    return head.unionByName(body)


def _cells(s, d):
    """Schedules of sessions in chapter order, with what each chapter teaches."""
    links = K.links(s, d).where("course_id = chapter_course").select("course_id", "chapter_code", "title", "lo_code").distinct()
    per = links.groupBy("course_id", "chapter_code", "title").agg(F.array_join(F.sort_array(F.collect_list(F.concat("lo_code", F.lit(" [A.O.1, A.O.2]")))), "; ").alias("taught"))
    nth = F.row_number().over(Window.partitionBy("course_id").orderBy(F.col("chapter_code").cast("int"), "chapter_code"))
    rows = per.select(F.col("course_id").alias("document_id"), nth.alias("row_no"), F.array(nth.cast("string"), F.concat_ws(" ", F.lit("Chương"), F.concat("chapter_code", F.lit(":")), "title"), "taught").alias("cells"))
    heads = rows.select("document_id").distinct().select("document_id", F.lit(0).alias("row_no"), F.array(F.lit("Buổi (Session)"), F.lit("Nội dung"), F.lit("")).alias("cells"))
    return rows.unionByName(heads).select("document_id", F.lit(3).alias("page"), F.lit(0).alias("table_no"), "row_no", "cells")


def syllabus_courses(s, d):
    return S.courses(_lines(s, d)).where("code IS NOT NULL").select("document_id", "code", "credits")


def syllabus_outcomes(s, d):
    return S.outcomes(_lines(s, d)).select("document_id", "code", "parent_code", F.md5("statement_vi").alias("vi_md5"), F.md5("statement_en").alias("en_md5"), "bloom_level")


def syllabus_chapters(s, d):
    return S.chapters(S.schedule(_cells(s, d))).select("document_id", "code", "title", "sort_order")


def syllabus_links(s, d):
    return S.chapter_links(S.schedule(_cells(s, d))).select("document_id", "chapter_code", "lo_code")


def syllabus_pairs(s, d):
    cells = _cells(s, d)
    return S.assessment_links(_lines(s, d), cells, S.schedule(cells)).select("document_id", "lo_code", "ao_code", "chapter_code").distinct()


def syllabus_findings(s, d):
    return S.findings(_lines(s, d), _cells(s, d)).groupBy("issue", "severity").agg(F.count("*").alias("n")).where("issue IN ('session.table_missing', 'chapter.none_extracted', 'assessment.none_extracted', 'lo.missing_english')")


_N = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_W = K.WITH + f", {K.CHAPTERS_SQL}, l AS (SELECT DISTINCT course_id, chapter_code, title, lo_code FROM lk WHERE course_id = chapter_course), o AS (SELECT course_id, code, max(statement_vi) AS vi, max(statement_en) AS en FROM learning_outcomes WHERE course_id IS NOT NULL AND code IS NOT NULL AND statement_vi IS NOT NULL GROUP BY 1, 2)"
SQL = {
    "syllabus_courses": "SELECT DISTINCT course_id AS document_id, upper(code) AS code, length(name) AS credits FROM courses WHERE course_id IS NOT NULL",
    "syllabus_outcomes": _W + f""", v AS (SELECT course_id, code, vi, unnest([{', '.join(f"struct_pack(a := strpos(lower(vi), '{v}'), i := {i}, l := {level})" for i, (v, level) in enumerate(C.BLOOM_VERBS.items()))}]) AS p FROM o),
b AS (SELECT course_id, code, first(p.l ORDER BY p.a, p.i) FILTER (p.a > 0) AS level FROM v GROUP BY 1, 2)
SELECT o.course_id AS document_id, o.code, CASE WHEN len(string_split(o.code, '.')) > 3 THEN regexp_replace(o.code, '\\.[^.]+$', '') END AS parent_code, md5({_N.format('vi')}) AS vi_md5, md5({_N.format('en')}) AS en_md5, level AS bloom_level
FROM o JOIN b ON b.course_id = o.course_id AND b.code = o.code""",
    "syllabus_chapters": _W + " SELECT DISTINCT course_id AS document_id, chapter_code AS code, trim(coalesce(title, '')) AS title, CAST(chapter_code AS INT) AS sort_order FROM l",
    "syllabus_links": _W + " SELECT DISTINCT course_id AS document_id, chapter_code, lo_code FROM l",
    "syllabus_pairs": _W + " SELECT DISTINCT course_id AS document_id, lo_code, unnest(['A.O.1', 'A.O.2']) AS ao_code, chapter_code FROM l",
    "syllabus_findings": _W + """, cs AS (SELECT DISTINCT course_id FROM courses WHERE course_id IS NOT NULL UNION SELECT course_id FROM o),
f AS (SELECT 'session.table_missing' AS issue, 'error' AS severity FROM cs WHERE course_id NOT IN (SELECT course_id FROM l) UNION ALL SELECT 'chapter.none_extracted', 'error' FROM cs WHERE course_id NOT IN (SELECT course_id FROM l)
UNION ALL SELECT 'assessment.none_extracted', 'error' FROM cs UNION ALL SELECT 'lo.missing_english', 'warning' FROM o WHERE en IS NULL) SELECT issue, severity, count(*) AS n FROM f GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (syllabus_courses, syllabus_outcomes, syllabus_chapters, syllabus_links, syllabus_pairs, syllabus_findings)}
