"""Queries over courses, chapters, outcomes and assessments.

The test tables have no chapters and assessments; they are derived: a chapter
is a chapter code of a course's current files, linked to the outcomes that a
confirmed mapping gives to its chunks; an assessment is a kind of exercise
text of a course, and outcome L.O.n is assessed by the kind in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import curriculum as C
from foliant.operators import retrieval as T
from foliant.plans.store import CHUNKS_SQL, DOCS_SQL, chunks, docs
from foliant.session import load

WITH = f"WITH d AS {DOCS_SQL}, c AS {CHUNKS_SQL}\n"
#: Kinds of texts that count as assessments, with their code.
KINDS = {"exercise": "A.O.1", "lab": "A.O.1.1", "feedback": "A.O.3.2"}


def _lo(s, d):
    return load(s, d, "learning_outcomes").where("course_id IS NOT NULL AND code IS NOT NULL")


def _title(c="title"):
    """Title of a file without its last word, which names the file."""
    return F.regexp_replace(c, r"\s+\S+$", "")


def chapters(s, d):
    live = docs(s, d).where("course_id IS NOT NULL AND chapter_code IS NOT NULL")
    per = live.groupBy("course_id", F.col("chapter_code").alias("code")).agg(F.min(_title()).alias("title"), F.bool_or(F.col("deleted_at").isNull()).alias("live"))
    return per.select(F.concat_ws(":CH", "course_id", "code").alias("chapter_id"), "course_id", "code", "title", F.expr("try_cast(code AS int)").alias("sort_order"),
                      F.when(F.col("live"), None).otherwise(F.to_timestamp(F.lit("2020-01-01"))).alias("deleted_at"))


def chapter_los(s, d):
    m = load(s, d, "chunk_lo_mappings").where("provenance = 'confirmed' AND lo_id IS NOT NULL").select("chunk_id", "lo_id").distinct()
    of = docs(s, d).where("course_id IS NOT NULL AND chapter_code IS NOT NULL").select("document_id", F.concat_ws(":CH", "course_id", "chapter_code").alias("chapter_id"))
    return m.join(chunks(s, d).select("chunk_id", "document_id"), "chunk_id").join(of, "document_id").select("chapter_id", "lo_id").distinct()


def assessments(s, d):
    kind = F.split_part("source", F.lit("-"), F.lit(2))
    code = F.coalesce(*(F.when(kind == k, v) for k, v in KINDS.items()))
    rows = load(s, d, "documents").where("course_id IS NOT NULL").select("course_id", code.alias("code")).where("code IS NOT NULL").distinct()
    return rows.select(F.concat_ws(":", "course_id", "code").alias("assessment_id"), "course_id", "code", X.parent_code(F.col("code")).alias("parent_code"))


def lo_assessments(s, d):
    """Outcomes L.O.1, L.O.4, ... by the first kind, and so on; of kinds that a
    course does not have, the link dangles."""
    nth = F.pmod(F.split_part("code", F.lit("."), F.lit(3)).cast("int") - 1, F.lit(4))
    codes = F.array(*(F.lit(v) for v in KINDS.values()))
    return _lo(s, d).where(nth < 3).select("course_id", "lo_id", F.col("code").alias("lo_code"), F.element_at(codes, nth + 1).alias("ao_code")).distinct().withColumn("assessment_id", F.concat_ws(":", "course_id", "ao_code"))


def links(s, d):
    return C.chapter_outcomes(chapters(s, d), chapter_los(s, d), load(s, d, "learning_outcomes"))


def _issues(s, d):
    lo = _lo(s, d)
    every = chapters(s, d).select("chapter_id", "course_id", F.col("code").alias("chapter_code"))
    named = chapter_los(s, d).join(every, "chapter_id").join(load(s, d, "learning_outcomes").select("lo_id", F.col("code").alias("lo_code")).distinct(), "lo_id").select("course_id", "chapter_code", "lo_code")
    goals = lo.where("parent_code IS NULL").select("course_id", "code", F.col("statement_en").alias("statement_vi"))
    return C.issues(load(s, d, "courses"), lo, assessments(s, d), chapters(s, d), named, lo_assessments(s, d), goals)


def curriculum_issues(s, d):
    return _issues(s, d)


def curriculum_gate(s, d):
    return C.blocked(_issues(s, d))


def course_outline(s, d):
    return C.outline(load(s, d, "courses"), _lo(s, d)).select("course_id", "course_code", F.array_join("codes", ",").alias("codes"), "outcomes")


def chapter_outline(s, d):
    return C.chapter_outline(links(s, d))


def chapter_outcomes(s, d):
    return links(s, d).where("course_id = chapter_course").select("course_id", "chapter_code", "lo_id", "lo_code", "sort_order")


def assessment_outcomes(s, d):
    return C.assessment_outcomes(assessments(s, d), lo_assessments(s, d), load(s, d, "learning_outcomes"))


def chapter_chunks(s, d):
    return C.chapter_chunks(links(s, d).where("course_id = chapter_course"), load(s, d, "chunk_lo_mappings").where("lo_id IS NOT NULL"))


#: The course with most files in all test data.
COURSE = "52b2ce19-7113-562c-b647-bf1708f9257e"


def curriculum_read(s, d):
    """Rows of each part of one course's curriculum."""
    parts = C.read(COURSE, load(s, d, "courses"), chapters(s, d), load(s, d, "learning_outcomes"), assessments(s, d))
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), "code").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def outcomes_by_code(s, d):
    return C.by_code(_lo(s, d).select("course_id", "code", "version", "lo_id"), "version").select("course_id", "code", "version")


def bloom_levels(s, d):
    lo = _lo(s, d).select("lo_id", "statement_vi").where("statement_vi IS NOT NULL AND lo_id IS NOT NULL").distinct()
    return lo.select("lo_id", F.md5("statement_vi").alias("st"), C.bloom_of(F.col("statement_vi")).alias("inferred"))


def assessment_kinds(s, d):
    titled = load(s, d, "documents").where("title IS NOT NULL")
    return titled.groupBy(C.assessment_kind(F.concat_ws(" ", "title", "source", "text")).alias("kind")).agg(F.count("*").alias("n"))


def heading_numbers(s, d):
    """Chapter of a chunk by the numbers in its headings, to which the first
    line of its text counts here."""
    c = chunks(s, d).where("course_id IS NOT NULL").select("chunk_id", "course_id", F.concat(F.coalesce("heading_path", F.array().cast("array<string>")), F.array(F.split_part("content", F.lit("\n"), F.lit(1)))).alias("heading_path"))
    return T.chapter_numbers(c, chapters(s, d))


def titles(s, d):
    """Titles by which a chapter is known: those of its files, each once."""
    return load(s, d, "documents_meta").where("title IS NOT NULL AND course_id IS NOT NULL AND chapter_code IS NOT NULL").select(
        "course_id", F.col("chapter_code").alias("code"), _title().alias("title")).distinct()


def heading_titles(s, d):
    """Chapters whose title is contained in the headings of a chunk of their course."""
    return T.title_chapters(chunks(s, d).where("course_id IS NOT NULL"), titles(s, d))


def course_refs(s, d):
    c = load(s, d, "courses")
    refs = c.select(F.col("code").alias("ref")).unionByName(c.select(F.col("course_id").alias("ref"))).distinct()
    return C.resolve_courses(refs, c)


_LO = "lo AS (SELECT * FROM learning_outcomes WHERE course_id IS NOT NULL AND code IS NOT NULL)"
CHAPTERS_SQL = r"""ch AS (SELECT course_id || ':CH' || chapter_code AS chapter_id, course_id, chapter_code AS code, min(regexp_replace(title, '\s+\S+$', '')) AS title, try_cast(chapter_code AS INT) AS sort_order, bool_or(deleted_at IS NULL) AS live
  FROM d WHERE course_id IS NOT NULL AND chapter_code IS NOT NULL GROUP BY course_id, chapter_code),
cl AS (SELECT DISTINCT d.course_id || ':CH' || d.chapter_code AS chapter_id, m.lo_id FROM chunk_lo_mappings m JOIN c ON c.chunk_id = m.chunk_id JOIN d ON d.document_id = c.document_id
  WHERE m.provenance = 'confirmed' AND m.lo_id IS NOT NULL AND d.course_id IS NOT NULL AND d.chapter_code IS NOT NULL),
cur AS (SELECT DISTINCT lo_id, course_id, code FROM learning_outcomes WHERE deleted_at IS NULL AND is_current),
lk AS (SELECT cur.course_id, ch.course_id AS chapter_course, ch.chapter_id, ch.code AS chapter_code, ch.title, ch.sort_order, cur.lo_id, cur.code AS lo_code FROM cl JOIN ch ON ch.chapter_id = cl.chapter_id AND ch.live JOIN cur ON cur.lo_id = cl.lo_id)"""
_AO = """ao AS (SELECT DISTINCT course_id, CASE split_part(source, '-', 2) WHEN 'exercise' THEN 'A.O.1' WHEN 'lab' THEN 'A.O.1.1' WHEN 'feedback' THEN 'A.O.3.2' END AS code FROM documents
  WHERE course_id IS NOT NULL AND split_part(source, '-', 2) IN ('exercise', 'lab', 'feedback')),
la AS (SELECT DISTINCT course_id, lo_id, code AS lo_code, ['A.O.1', 'A.O.1.1', 'A.O.3.2'][(CAST(split_part(code, '.', 3) AS INT) - 1) % 4 + 1] AS ao_code FROM learning_outcomes
  WHERE course_id IS NOT NULL AND code IS NOT NULL AND (CAST(split_part(code, '.', 3) AS INT) - 1) % 4 < 3)"""
_ISSUES = f"""{_LO}, {CHAPTERS_SQL}, {_AO}, codes AS (SELECT DISTINCT course_id, code FROM lo), hp AS (SELECT DISTINCT course_id, code, parent_code FROM lo WHERE parent_code IS NOT NULL),
ap AS (SELECT course_id, code, CASE WHEN len(string_split(code, '.')) > 3 THEN regexp_replace(code, '\\.[^.]+$', '') END AS parent_code FROM ao),
tl AS (SELECT DISTINCT ch.course_id, ch.code AS chapter_code, l.code AS lo_code FROM cl JOIN ch ON ch.chapter_id = cl.chapter_id JOIN learning_outcomes l ON l.lo_id = cl.lo_id WHERE l.code IS NOT NULL),
leaf AS (SELECT * FROM codes WHERE (course_id, code) NOT IN (SELECT course_id, parent_code FROM hp)),
i AS (SELECT course_id, 'ref.unknown_lo' AS issue, 'error' AS severity, chapter_code || '>' || lo_code AS subject FROM tl WHERE (course_id, lo_code) NOT IN (SELECT course_id, code FROM codes)
UNION ALL SELECT DISTINCT course_id, 'ref.unknown_ao', 'error', lo_code || '>' || ao_code FROM la WHERE (course_id, ao_code) NOT IN (SELECT course_id, code FROM ao)
UNION ALL SELECT course_id, 'lo.orphan_parent', 'error', code FROM hp WHERE (course_id, parent_code) NOT IN (SELECT course_id, code FROM codes)
UNION ALL SELECT course_id, 'assessment.orphan_parent', 'error', code FROM ap WHERE parent_code IS NOT NULL AND (course_id, parent_code) NOT IN (SELECT course_id, code FROM ao)
UNION ALL SELECT course_id, 'lo.not_taught', 'warning', code FROM leaf WHERE (course_id, code) NOT IN (SELECT course_id, lo_code FROM tl)
UNION ALL SELECT course_id, 'lo.not_assessed', 'warning', code FROM leaf WHERE (course_id, code) NOT IN (SELECT course_id, lo_code FROM la)
UNION ALL SELECT course_id, 'chapter.title_missing', 'warning', code FROM ch WHERE trim(coalesce(title, '')) = ''
UNION ALL SELECT DISTINCT a.course_id, 'goal.code_collision', 'info', a.code FROM lo a JOIN lo b ON a.course_id = b.course_id AND a.code = b.code WHERE a.parent_code IS NULL
  AND trim(regexp_replace(coalesce(a.statement_en, ''), '\\s+', ' ', 'g')) <> trim(regexp_replace(coalesce(b.statement_vi, ''), '\\s+', ' ', 'g'))
UNION ALL SELECT DISTINCT course_id, 'lo.bloom_inferred', 'info', '' FROM lo
UNION ALL SELECT course_id, 'chapter.none_extracted', 'error', '' FROM (SELECT DISTINCT course_id FROM courses) WHERE course_id NOT IN (SELECT course_id FROM ch)
UNION ALL SELECT DISTINCT course_id, 'link.none_extracted', 'error', '' FROM ch WHERE course_id NOT IN (SELECT course_id FROM tl))"""
# Folding as in the text functions: lower case, marks dropped.
FOLD_SQL = "replace(strip_accents(lower({})), 'đ', 'd')"
NUMBER_SQL = r"(?i)(?:chương|chuong|chapter|bài|bai|lecture|tuần|tuan|buổi|buoi|unit)\s*[.:\-]?\s*0*(\d+)"
TITLES_SQL = rf"""ti AS (SELECT DISTINCT course_id, chapter_code AS code, {FOLD_SQL.format("regexp_replace(title, '\\s+\\S+$', '')")} AS k FROM documents_meta WHERE title IS NOT NULL AND course_id IS NOT NULL AND chapter_code IS NOT NULL),
tx AS (SELECT c.chunk_id, ti.code, ti.k FROM c JOIN ti ON ti.course_id = c.course_id WHERE length(k) >= 8 AND contains({FOLD_SQL.format("array_to_string(heading_path, ' ')")}, k)),
tt AS (SELECT chunk_id, first(code ORDER BY length(k) DESC, try_cast(code AS INT) NULLS LAST, code) AS chapter_code FROM tx GROUP BY 1)"""
SQL = {
    "curriculum_issues": WITH + f", {_ISSUES} SELECT * FROM i",
    "curriculum_gate": WITH + f", {_ISSUES} SELECT course_id, count(*) FILTER (severity = 'error') AS errors, count(*) AS issues, count(*) FILTER (severity = 'error') > 0 AS blocked FROM i GROUP BY 1",
    "course_outline": f"""WITH {_LO}, p AS (SELECT course_id, list_sort(list(DISTINCT code)) AS codes, count(DISTINCT code) AS n FROM lo WHERE deleted_at IS NULL AND is_current GROUP BY 1)
SELECT k.course_id, k.code AS course_code, coalesce(array_to_string(codes[1:60], ','), '') AS codes, coalesce(n, 0) AS outcomes FROM courses k LEFT JOIN p ON p.course_id = k.course_id WHERE k.deleted_at IS NULL""",
    "chapter_outline": WITH + f", {CHAPTERS_SQL} SELECT course_id, chapter_code, title, array_to_string(list_sort(list(DISTINCT lo_code))[1:60], ',') AS codes FROM lk WHERE course_id = chapter_course GROUP BY 1, 2, 3",
    "chapter_outcomes": WITH + f", {CHAPTERS_SQL} SELECT course_id, chapter_code, lo_id, lo_code, sort_order FROM lk WHERE course_id = chapter_course",
    "assessment_outcomes": f"WITH {_AO} SELECT DISTINCT l.course_id, ao.code AS ao_code, l.lo_id, l.code AS lo_code FROM learning_outcomes l JOIN la ON la.lo_id = l.lo_id JOIN ao ON ao.course_id = la.course_id AND ao.code = la.ao_code WHERE l.deleted_at IS NULL AND l.is_current",
    "chapter_chunks": WITH + f""", {CHAPTERS_SQL}, x AS (SELECT lk.course_id, chapter_code, m.chunk_id, max(confidence) AS confidence FROM (SELECT DISTINCT course_id, chapter_code, lo_id FROM lk WHERE course_id = chapter_course) lk
  JOIN chunk_lo_mappings m ON m.lo_id = lk.lo_id WHERE m.chunk_id IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY course_id, chapter_code ORDER BY confidence DESC NULLS LAST, chunk_id) AS place FROM x) SELECT course_id, chapter_code, chunk_id, place FROM p WHERE place <= 20""",
    "curriculum_read": WITH + f""", {CHAPTERS_SQL}, {_AO} SELECT DISTINCT 'course' AS part, code FROM courses WHERE course_id = '{COURSE}' AND deleted_at IS NULL UNION ALL SELECT 'chapters', code FROM ch WHERE live AND course_id = '{COURSE}'
UNION ALL SELECT DISTINCT 'outcomes', code FROM cur WHERE course_id = '{COURSE}' UNION ALL SELECT 'assessments', code FROM ao WHERE course_id = '{COURSE}'""",
    "outcomes_by_code": f"WITH {_LO} SELECT course_id, code, max(version) AS version FROM lo GROUP BY 1, 2",
    "bloom_levels": f"""WITH {_LO}, t AS (SELECT DISTINCT lo_id, statement_vi, lower(statement_vi) AS x FROM lo WHERE statement_vi IS NOT NULL AND lo_id IS NOT NULL),
v AS (SELECT lo_id, statement_vi, unnest([{', '.join(f"struct_pack(a := strpos(x, '{v}'), i := {i}, l := {level})" for i, (v, level) in enumerate(C.BLOOM_VERBS.items()))}]) AS p FROM t)
SELECT lo_id, md5(statement_vi) AS st, first(p.l ORDER BY p.a, p.i) FILTER (p.a > 0) AS inferred FROM v GROUP BY 1, statement_vi""",
    "assessment_kinds": """SELECT CASE WHEN contains(x, 'giữa kỳ') OR contains(x, 'midterm') THEN 'midterm' WHEN contains(x, 'cuối kỳ') OR contains(x, 'final exam') THEN 'final' WHEN contains(x, 'nhóm') OR contains(x, 'group') THEN 'group_quiz'
WHEN contains(x, 'dự án') OR contains(x, 'project') THEN 'project' ELSE 'quiz' END AS kind, count(*) AS n FROM (SELECT lower(regexp_replace(concat_ws(' ', title, source, text), '[\\s\\x0b]+', ' ', 'g')) AS x FROM documents WHERE title IS NOT NULL) GROUP BY 1""",
    "heading_numbers": WITH + rf""", {CHAPTERS_SQL}, f AS (SELECT chunk_id, course_id, regexp_extract_all(concat_ws(' ', array_to_string(heading_path, ' '), split_part(content, chr(10), 1)), '{NUMBER_SQL}', 1) AS ns FROM c WHERE course_id IS NOT NULL),
x AS (SELECT chunk_id, course_id, unnest(ns) AS code, generate_subscripts(ns, 1) AS pos FROM f)
SELECT chunk_id, first(x.code ORDER BY pos) AS chapter_code FROM x JOIN ch ON ch.course_id = x.course_id AND ch.code = x.code GROUP BY 1""",
    "heading_titles": WITH + f", {TITLES_SQL} SELECT * FROM tt",
    "course_refs": "SELECT DISTINCT ref, course_id, true AS known FROM (SELECT code AS ref, course_id FROM courses UNION ALL SELECT course_id, course_id FROM courses)",
}
QUERIES = {f.__name__: f for f in (
    curriculum_issues, curriculum_gate, course_outline, chapter_outline, chapter_outcomes, assessment_outcomes, chapter_chunks, curriculum_read, outcomes_by_code, bloom_levels, assessment_kinds,
    heading_numbers, heading_titles, course_refs)}
