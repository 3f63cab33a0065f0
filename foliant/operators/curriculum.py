"""Curricula as tables: levels and kinds by their words, the joins between
chapters, outcomes and assessments, integrity rules, outlines.

Frames: ``courses (course_id, code, ...)``, ``chapters (chapter_id,
course_id, code, title, sort_order, deleted_at)``, ``learning_outcomes``,
``chapter_los (chapter_id, lo_id)``, ``assessments (assessment_id, course_id,
code, parent_code)``, ``lo_assessments (lo_id, assessment_id)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verbs by which an outcome's level is recognised, and the level.
BLOOM_VERBS = {
    "nhớ": 1, "liệt kê": 1, "trình bày": 1, "mô tả": 1, "định nghĩa": 1,
    "hiểu": 2, "giải thích": 2, "phân biệt": 2, "tóm tắt": 2, "nhận diện": 2,
    "áp dụng": 3, "thực hiện": 3, "sử dụng": 3, "vận dụng": 3,
    "phân tích": 4, "so sánh": 4, "phân loại": 4,
    "đánh giá": 5, "nhận xét": 5, "phê bình": 5,
    "giao tiếp": 3, "quản lý": 3, "lập kế hoạch": 3,
    "tổng hợp": 6, "thiết kế": 6, "xây dựng": 6, "tạo ra": 6, "đề xuất": 6,
}
# Kinds of assessment with their words; the first kind that occurs counts.
ASSESSMENTS = {"midterm": ["giữa kỳ", "midterm"], "final": ["cuối kỳ", "final exam"], "group_quiz": ["nhóm", "group"], "project": ["dự án", "project"]}
OTHER_ASSESSMENT = "quiz"


def bloom_of(text: Column) -> Column:
    """Level of the verb that comes first in the text, of two at one place the
    one listed first; null without any."""
    low = F.lower(text)
    met = F.array(*(F.struct(F.locate(v, low).alias("at"), F.lit(i).alias("nth"), F.lit(level).alias("level")) for i, (v, level) in enumerate(BLOOM_VERBS.items())))
    return F.array_min(F.filter(met, lambda x: x["at"] > 0))["level"]


def assessment_kind(text: Column) -> Column:
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    out = F.lit(OTHER_ASSESSMENT)
    for kind, words in reversed(ASSESSMENTS.items()):
        out = F.when(reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words)), kind).otherwise(out)
    return out


def current_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("deleted_at IS NULL AND is_current")


def chapter_outcomes(chapters: DataFrame, chapter_los: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Links between live chapters and current outcomes, with both codes: read
    by chapter it lists its outcomes, by outcome its chapters."""
    ch = chapters.where("deleted_at IS NULL").select("chapter_id", F.col("course_id").alias("chapter_course"), F.col("code").alias("chapter_code"), "title", "sort_order")
    lo = current_outcomes(outcomes).select("lo_id", "course_id", F.col("code").alias("lo_code")).distinct()
    return chapter_los.select("chapter_id", "lo_id").distinct().join(ch, "chapter_id").join(lo, "lo_id").select(
        "course_id", "chapter_course", "chapter_id", "chapter_code", "title", "sort_order", "lo_id", "lo_code")


def assessment_outcomes(assessments: DataFrame, lo_assessments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Current outcomes evaluated by each assessment, once each."""
    a = assessments.select("assessment_id", F.col("code").alias("ao_code"))
    lo = current_outcomes(outcomes).select("lo_id", "course_id", F.col("code").alias("lo_code"))
    return lo.join(lo_assessments.select("lo_id", "assessment_id"), "lo_id").join(a, "assessment_id").select("course_id", "ao_code", "lo_id", "lo_code").distinct()


def chapter_chunks(links: DataFrame, mappings: DataFrame, most: int = 20) -> DataFrame:
    """Chunks that support the outcomes of each chapter, ``most`` at most: the
    surest first, then by id.  The chapter's outcomes are those linked to it;
    codes of outcomes do not name chapters.  Each task ranks before the
    shuffle, so a chapter with very many chunks is no skew."""
    rows = links.select("course_id", "chapter_code", "lo_id").distinct().join(mappings.where("chunk_id IS NOT NULL"), "lo_id").groupBy("course_id", "chapter_code", "chunk_id").agg(F.max("confidence").alias("confidence"))
    place = F.row_number().over(Window.partitionBy("course_id", "chapter_code").orderBy(F.col("confidence").desc_nulls_last(), "chunk_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("course_id", "chapter_code", "chunk_id", "place")


def read(course_id: str, courses: DataFrame, chapters: DataFrame, outcomes: DataFrame, assessments: DataFrame) -> dict[str, DataFrame]:
    """The four parts of one course's curriculum, live and current rows only."""
    of = F.col("course_id") == course_id
    return {
        "course": courses.where(of & F.col("deleted_at").isNull()), "chapters": chapters.where(of & F.col("deleted_at").isNull()).orderBy("sort_order", "code"),
        "outcomes": current_outcomes(outcomes).where(of).orderBy("code"), "assessments": assessments.where(of).orderBy("code"),
    }


def by_code(rows: DataFrame, order: str) -> DataFrame:
    """One row a code of a course: of repeated codes the last counts."""
    return rows.groupBy("course_id", "code").agg(F.max_by(F.struct(*rows.columns), F.struct(order)).alias("r")).select("r.*")


SEVERITY = {
    "ref.unknown_lo": "error", "ref.unknown_ao": "error", "lo.orphan_parent": "error", "assessment.orphan_parent": "error", "lo.not_taught": "warning", "lo.not_assessed": "warning",
    "chapter.title_missing": "warning", "goal.code_collision": "info", "lo.bloom_inferred": "info", "chapter.none_extracted": "error", "link.none_extracted": "error",
}


def issues(courses: DataFrame, outcomes: DataFrame, assessments: DataFrame, chapters: DataFrame, chapter_links: DataFrame, lo_links: DataFrame, goals: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Integrity of curricula as rows ``(course_id, code, severity, subject)``.

    Codes that links name must exist; parents must exist; an outcome without
    children must be taught by a chapter and be assessed; chapters need a
    title; a goal must not reuse an outcome's code for something else; levels
    are only inferred; a course must have chapters, and links if it has rows.
    Inputs, all with ``course_id``: ``outcomes`` and ``assessments`` (code,
    parent_code), ``chapters`` (code, title), ``chapter_links`` (chapter_code,
    lo_code), ``lo_links`` (lo_code, ao_code), ``goals`` (code, statement_vi),
    ``rows`` of the schedule (the chapters, if not given)."""
    key = ["course_id", "code"]
    coded = lambda df, name: df.select("course_id", F.col(name).alias("code"))
    found = lambda df, code, subject=F.col("code"): df.select("course_id", F.lit(code).alias("issue"), F.lit(SEVERITY[code]).alias("severity"), subject.alias("subject"))
    lo, ao = (df.select(*key, "parent_code").distinct() for df in (outcomes, assessments))
    lo_codes, ao_codes = lo.select(*key).distinct(), ao.select(*key).distinct()
    taught, assessed = chapter_links.select("course_id", "chapter_code", "lo_code").distinct(), lo_links.select("course_id", "lo_code", "ao_code").distinct()

    def orphans(rows_: DataFrame, codes: DataFrame) -> DataFrame:
        return rows_.where("parent_code IS NOT NULL").join(codes.withColumnRenamed("code", "parent_code"), ["course_id", "parent_code"], "left_anti")

    leaves = lo_codes.join(coded(lo.where("parent_code IS NOT NULL"), "parent_code"), key, "left_anti")
    squeezed = lambda df, name: df.select(*key, F.btrim(F.regexp_replace(F.coalesce("statement_vi", F.lit("")), r"\s+", " ")).alias(name)).distinct()
    clash = squeezed(goals, "goal").join(squeezed(outcomes, "statement"), key).where("goal <> statement").select(*key).distinct()
    every = courses.select("course_id").distinct()
    listed = (chapters if rows is None else rows).select("course_id").distinct()
    of_link = F.concat_ws(">", F.col("chapter_code"), F.col("lo_code"))
    of_pair = F.concat_ws(">", F.col("lo_code"), F.col("ao_code"))
    return reduce(DataFrame.unionByName, [
        found(taught.join(lo_codes.withColumnRenamed("code", "lo_code"), ["course_id", "lo_code"], "left_anti"), "ref.unknown_lo", of_link),
        found(assessed.join(lo_codes.withColumnRenamed("code", "lo_code"), ["course_id", "lo_code"], "left_anti"), "ref.unknown_lo", of_pair),
        found(assessed.join(ao_codes.withColumnRenamed("code", "ao_code"), ["course_id", "ao_code"], "left_anti"), "ref.unknown_ao", of_pair),
        found(orphans(lo, lo_codes), "lo.orphan_parent"), found(orphans(ao, ao_codes), "assessment.orphan_parent"),
        found(leaves.join(coded(taught, "lo_code").distinct(), key, "left_anti"), "lo.not_taught"),
        found(leaves.join(coded(assessed, "lo_code").distinct(), key, "left_anti"), "lo.not_assessed"),
        found(chapters.where(F.btrim(F.coalesce("title", F.lit(""))) == "").select(*key).distinct(), "chapter.title_missing"),
        found(clash, "goal.code_collision"),
        found(outcomes.select("course_id").distinct(), "lo.bloom_inferred", F.lit("")),
        found(every.join(chapters.select("course_id").distinct(), "course_id", "left_anti"), "chapter.none_extracted", F.lit("")),
        found(listed.join(taught.select("course_id").distinct(), "course_id", "left_anti"), "link.none_extracted", F.lit("")),
    ])


def blocked(found: DataFrame) -> DataFrame:
    """Courses whose curriculum may not be imported."""
    return found.groupBy("course_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("issues")).withColumn("blocked", F.col("errors") > 0)


def outline(courses: DataFrame, outcomes: DataFrame, most: int = 60) -> DataFrame:
    """Each live course with its current outcomes in order, ``most`` at most."""
    live = current_outcomes(outcomes).select("course_id", "code").distinct()
    placed = live.withColumn("nth", F.row_number().over(Window.partitionBy("course_id").orderBy("code"))).where(F.col("nth") <= most)
    per = placed.groupBy("course_id").agg(F.sort_array(F.collect_list("code")).alias("codes")).join(live.groupBy("course_id").agg(F.count("*").alias("outcomes")), "course_id")
    return courses.where("deleted_at IS NULL").join(per, "course_id", "left").select(
        "course_id", F.col("code").alias("course_code"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.coalesce("outcomes", F.lit(0)).alias("outcomes"))


def chapter_outline(links: DataFrame, chapter: str | None = None, most: int = 60) -> DataFrame:
    """Chapters of each course with the codes of their outcomes; one chapter
    only, in any letter case, if it is named."""
    some = links.where("course_id = chapter_course")
    if chapter is not None:
        some = some.where(F.lower("chapter_code") == chapter.strip().lower())
    once = some.select("course_id", "chapter_code", "title", "lo_code").distinct()
    placed = once.withColumn("nth", F.row_number().over(Window.partitionBy("course_id", "chapter_code").orderBy("lo_code"))).where(F.col("nth") <= most)
    return placed.groupBy("course_id", "chapter_code", "title").agg(F.array_join(F.sort_array(F.collect_list("lo_code")), ",").alias("codes"))


def resolve_courses(refs: DataFrame, courses: DataFrame) -> DataFrame:
    """Course of each reference by id or code, else the UUID made of it."""
    from foliant.functions.ids import stable_uuid

    known = courses.select(F.explode(F.array(F.struct(F.col("course_id").alias("ref")), F.struct(F.col("code").alias("ref")))).alias("k"), "course_id").select("k.ref", "course_id").dropDuplicates(["ref"])
    return refs.join(known, "ref", "left").select("ref", F.coalesce("course_id", stable_uuid(F.col("ref"))).alias("course_id"), F.col("course_id").isNotNull().alias("known"))
