"""Curricula read from syllabi that are given as lines and as table rows.

``lines (document_id, page, ord, text)`` are those of the pages without
running marginals; ``cells (document_id, page, table_no, row_no, cells)`` are
the rows of the tables found on them.  A syllabus is some pages long, so its
rows may meet in one task; syllabi never meet.

Sections: 1 course, 4.1 goals, 4.2 outcomes, 5.2 assessments, 5.3 outcomes by
assessment, 6 schedule.  Every result names the page it was read from.

Null or blank lines are no lines; cells may be null; a syllabus without a
section gives no rows for it and an issue; repeated rows count once.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliant.functions.text import parent_code
from foliant.operators.curriculum import assessment_kind, bloom_of, issues

# Forms of section numbers, codes and header fields.
_HEADING = r"^(\d+(?:\.\d+)*)\.\s+\S"
_LO, _AO = r"L\.?\s?O\.(\d+(?:\.\d+)*)", r"A\.?\s?O\.(\d+(?:\.\d+)*)"
_PAIR = r"L\.O\.\d+(?:\.\d+)*\s*\[[^\]]*\]"
_CHAPTER, _SESSION = r"(?iu)Chương\s*(\d+)", r"^(\d+)(?:\s*[,–-]\s*(\d+))?$"
FIELDS = {
    "code": r"Mã học phần[^:]*:\s*([A-Z]{2}\d{3,5})", "title_vi": r"Tên học phần\s*:\s*([^(\n]+?)\s*\(\s*[^)\n]+?\s*\)", "title_en": r"Tên học phần\s*:\s*[^(\n]+?\s*\(\s*([^)\n]+?)\s*\)",
    "credits": r"Số tín chỉ[^:]*:\s*(\d+)", "semester": r"Học kỳ áp dụng[^:]*:\s*(\S+)", "lo_year": r"Năm chuẩn đầu ra áp dụng[^:]*:\s*(\d{4})", "version": r"Editing version\)\s*:\s*(\S+)",
}
_INVISIBLE = "[﻿​‌‍⁠]"
_PLACE = ["document_id", "page", "ord"]


def squeezed(c: Column) -> Column:
    """Single blanks, characters without width left out."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _INVISIBLE, ""), r"(?U)\s+", " "))


def _squeeze(text: str | None) -> str:
    return " ".join(re.sub(_INVISIBLE, "", text or "").split())


def _opening(text: str, deepest: int = 2) -> int | None:
    """Where the bracket opens that closes the text, if no more than
    ``deepest`` levels of brackets are inside."""
    depth = most = 0
    for i in range(len(text) - 1, -1, -1):
        if text[i] == ")":
            depth += 1
            most = max(most, depth)
        elif text[i] == "(":
            depth -= 1
            if depth == 0:
                return i if most <= deepest else None
    return None


def translated(block: str | None) -> tuple[str, str | None]:
    """Text and its translation in brackets at the end: from the first bracket
    that begins a line and leaves all brackets closed, else from the bracket
    that the end closes."""
    text = (block or "").strip()
    if text.endswith(")"):
        at = 0
        for line in text.split("\n"):
            begin = at + len(line) - len(line.lstrip(" \t"))
            at += len(line) + 1
            rest = text[begin:]
            if begin > 0 and line.lstrip(" \t").startswith("(") and text[begin - 1] in "\n \t" and "\n" in text[:begin] and rest.count("(") == rest.count(")"):
                return _squeeze(text[:begin]), _squeeze(rest[1:-1])
        at_end = _opening(text)
        if at_end:
            return _squeeze(text[:at_end]), _squeeze(text[at_end + 1 : -1])
    return _squeeze(text), None


def _texts(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


@F.pandas_udf(_texts("vi", "en"))
def bilingual(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([translated(x) for x in s], columns=["vi", "en"])


def section(lines: DataFrame, number: str) -> DataFrame:
    """Lines of one numbered section, heading included: from the first heading
    with its number to the next that is none of its own parts."""
    marked = lines.where(F.btrim(F.coalesce("text", F.lit(""))) != "").withColumn("_no", F.regexp_extract("text", _HEADING, 1))
    doc = Window.partitionBy("document_id")
    first = F.min(F.when(F.col("_no") == number, F.struct("page", "ord"))).over(doc)
    at = F.struct("page", "ord")
    placed = marked.withColumn("_first", first).where(F.col("_first").isNotNull() & (at >= F.col("_first")))
    other = (F.col("_no") != "") & (at > F.col("_first")) & ~F.startswith("_no", F.lit(f"{number}."))
    end = F.min(F.when(other, at)).over(doc)
    return placed.withColumn("_end", end).where(F.col("_end").isNull() | (at < F.col("_end"))).select(*_PLACE, "text")


def blocks(lines: DataFrame, mark: str) -> DataFrame:
    """``(document_id, nth, page, code, body)``: text from each mark (its first
    group is the code) to the next, over line ends."""
    pieces = F.split(F.regexp_replace("text", mark, "\u0001$1\u0002"), "\u0001")
    cut = lines.select(*_PLACE, F.posexplode(pieces).alias("pos", "piece"))
    by = Window.partitionBy("document_id").orderBy("page", "ord", "pos")
    code = F.when(F.contains("piece", F.lit("\u0002")), F.split_part("piece", F.lit("\u0002"), F.lit(1)))
    grouped = cut.withColumn("code", code).withColumn("nth", F.sum(F.col("code").isNotNull().cast("int")).over(by)).where("nth > 0")
    text = F.when(F.col("code").isNotNull(), F.split_part("piece", F.lit("\u0002"), F.lit(2))).otherwise(F.col("piece"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "pos", text.alias("t")))), lambda x: x["t"]), "\n")
    return grouped.groupBy("document_id", "nth").agg(F.max("code").alias("code"), F.min("page").alias("page"), body.alias("body")).withColumn(
        "body", F.regexp_replace(F.btrim("body", F.lit(" \t\r\n")), r"^[-–]\s*", ""))


def courses(lines: DataFrame) -> DataFrame:
    """Header fields of each syllabus; the year, version and credits may be
    missing, the title then is the code."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda x: x["text"]), "\n")
    whole = lines.groupBy("document_id").agg(text.alias("text"))
    out = whole.select("document_id", *(F.nullif(squeezed(F.regexp_extract("text", p, 1)), F.lit("")).alias(k) for k, p in FIELDS.items()))
    return out.withColumn("credits", F.col("credits").cast("int")).withColumn("title_vi", F.coalesce("title_vi", "code"))


def goals(lines: DataFrame) -> DataFrame:
    """Goals of 4.1: all in the first language, then all in the second, under
    the same codes."""
    found = blocks(section(lines, "4.1"), _LO).withColumn("body", squeezed(F.col("body"))).where("body <> ''")
    turn = F.row_number().over(Window.partitionBy("document_id", "code").orderBy("nth"))
    return found.withColumn("turn", turn).groupBy("document_id", F.concat(F.lit("L.O."), "code").alias("code")).agg(
        F.max(F.when(F.col("turn") == 1, F.col("body"))).alias("statement_vi"), F.max(F.when(F.col("turn") == 2, F.col("body"))).alias("statement_en"), F.min("page").alias("page"))


def outcomes(lines: DataFrame) -> DataFrame:
    """Outcomes of 4.2; of a repeated code the first counts.  ``times``: how
    often it is there."""
    found = blocks(section(lines, "4.2"), _LO).where("body <> ''").groupBy("document_id", "code").agg(
        F.min_by("body", "nth").alias("body"), F.min_by("page", "nth").alias("page"), F.min("nth").alias("nth"), F.count("*").alias("times"))
    code = F.concat(F.lit("L.O."), "code")
    return found.withColumn("b", bilingual("body")).select(
        "document_id", code.alias("code"), parent_code(code).alias("parent_code"), F.col("b.vi").alias("statement_vi"), F.col("b.en").alias("statement_en"),
        bloom_of(F.col("b.vi")).alias("bloom_level"), "page", "nth", "times")


def _table(cells: DataFrame, words: list[str]) -> DataFrame:
    """Rows, the first left out, of the first table whose first row holds one
    of the words."""
    head = F.lower(squeezed(F.array_join("cells", " ", "")))
    hit = (F.col("row_no") == 0) & reduce(Column.__or__, (F.contains(head, F.lit(w)) for w in words))
    first = F.min(F.when(hit, F.struct("page", "table_no"))).over(Window.partitionBy("document_id"))
    return cells.withColumn("_t", first).where((F.struct("page", "table_no") == F.col("_t")) & (F.col("row_no") > 0)).drop("_t")


def _cell(i: int) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit(""))


def assessments(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Assessments of 5.2: of the table of activities, or of the text where
    there is none; of a repeated code the first counts."""
    rows = _table(cells, ["loại hoạt", "activity"])
    tabled = rows.where(F.size("cells") >= 2).select("document_id", "page", F.col("row_no").alias("nth"), _cell(1).alias("kind"), F.regexp_extract(_cell(2), _AO, 1).alias("code"),
                                                     F.regexp_replace(_cell(2), rf"(?s)^.*?{_AO}", "").alias("body")).where("code <> ''")
    text = blocks(section(lines, "5.2"), _AO).join(rows.select("document_id").distinct(), "document_id", "left_anti").select("document_id", "page", "nth", F.lit("").alias("kind"), "code", "body")
    found = tabled.unionByName(text).withColumn("body", F.regexp_replace(F.btrim("body", F.lit(" \t\r\n")), r"^[-–]\s*", ""))
    once = found.groupBy("document_id", "code").agg(F.min_by(F.struct("kind", "body", "page"), "nth").alias("r"))
    code = F.concat(F.lit("A.O."), "code")
    named = once.withColumn("b", bilingual("r.body"))
    activity = F.nullif(F.regexp_extract(squeezed(F.col("r.kind")), r"^\s*([A-Z]{2,4})\s*-", 1), F.lit(""))
    return named.select("document_id", code.alias("code"), parent_code(code).alias("parent_code"), F.col("b.vi").alias("name_vi"), F.col("b.en").alias("name_en"), activity.alias("activity"),
                        assessment_kind(F.concat_ws(" ", F.col("r.kind"), F.col("b.vi"), F.col("b.en"))).alias("category"), F.col("r.page").alias("page"))


def codes_in(c: Column, pattern: str, prefix: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(prefix), x))


def _topics(content: str | None) -> list[str]:
    found = (re.match(r"\d+(?:\.\d+)+\.?\s+(\S.*)$", s.strip()) for s in (content or "").splitlines())
    named = [_squeeze(m[1].rstrip(")").strip()) for m in found if m]
    return list({t.lower(): t for t in reversed(named) if t}.values())[::-1]


def _titles(content: str | None, chapter: str | None) -> tuple[str, str | None]:
    """Title of a row, which may go on over lines until a subsection or the
    translation in brackets, and the translation."""
    lines = [s.strip() for s in (content or "").splitlines() if s.strip()]
    stop = next((i for i, s in enumerate(lines) if i and (s.startswith("(") or re.match(r"\d+(?:\.\d+)+\.?\s", s))), len(lines))
    first = " ".join(lines[:stop])
    m = re.match(r"\d+\s+(\S.*)$", first) or re.match(r"Chương\s*\d+\s*[.:]?\s*(.*)$", first, re.I)
    given = re.search(rf"\(\s*{re.escape(chapter)}\s+([^\n]+)", content or "") if chapter else None
    if given:
        return _squeeze(m[1] if m else first), _squeeze(given[1])
    english = next((s for s in lines[1:] if s.startswith("(")), None)
    return _squeeze(m[1] if m else first), None if english is None else _squeeze(re.sub(r"^C?hapter\s*\d+\s*[.:]?\s*", "", english.lstrip("(").rstrip(")"), flags=re.I))


@F.pandas_udf(_texts("title_vi", "title_en"))
def _row_titles(content: pd.Series, chapter: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_titles(t, c) for t, c in zip(content, chapter)], columns=["title_vi", "title_en"])


@F.pandas_udf(ArrayType(StringType()))
def _row_topics(content: pd.Series) -> pd.Series:
    return content.map(_topics)


def schedule(cells: DataFrame) -> DataFrame:
    """Rows of section 6, from all tables that name sessions in one of their
    first three rows, in order.

    A row without label continues the one before it, over page ends too.  Its
    session is the number in its label (or the first of a range), else one
    more than the last before; its chapter stands in the label, or in the
    first line of the content where the label is a number."""
    text = F.lower(squeezed(F.array_join("cells", " ", "")))
    table = ["document_id", "page", "table_no"]
    heads = cells.where("row_no < 3").withColumn("h", text).where("h <> ''").groupBy(*table).agg(F.min_by("h", "row_no").alias("h"))
    named = heads.where(F.contains("h", F.lit("buổi")) | F.contains("h", F.lit("session"))).select(*table)
    rows = cells.where(F.size("cells") >= 3).join(named, table, "left_semi").select("document_id", "page", "table_no", "row_no", squeezed(_cell(1)).alias("label"), _cell(2).alias("content"), _cell(3).alias("activity"))
    low = F.lower(F.concat_ws(" ", "label", squeezed(F.col("content"))))
    rows = rows.where(~(F.contains(low, F.lit("buổi")) & F.contains(low, F.lit("session")) & F.contains(low, F.lit("nội dung"))))
    by = Window.partitionBy("document_id").orderBy("page", "table_no", "row_no")
    placed = rows.withColumn("row_order", F.sum((F.col("label") != "").cast("int")).over(by)).where("row_order > 0")
    whole = F.array_sort(F.collect_list(F.struct("page", "table_no", "row_no", "content", "activity")))
    pairs = F.regexp_extract_all(F.array_join(F.transform("parts", lambda x: x["activity"]), "\n"), F.lit(_PAIR), F.lit(0))
    merged = placed.groupBy("document_id", "row_order").agg(F.max("label").alias("label"), whole.alias("parts")).withColumns({
        "content": F.element_at("parts", 1)["content"], "page": F.element_at("parts", 1)["page"], "pairs": pairs})
    line = F.btrim(F.split_part(F.btrim("content", F.lit(" \t\r\n")), F.lit("\n"), F.lit(1)))
    in_label, in_line = F.regexp_extract("label", _CHAPTER, 1), F.regexp_extract(line, r"(?iu)^Chương\s*(\d+)", 1)
    number, last = F.regexp_extract("label", _SESSION, 1), F.regexp_extract("label", _SESSION, 2)
    given = F.when((in_label == "") & (number != ""), number.cast("int"))
    read = merged.withColumns({
        "chapter_code": F.when(in_label != "", in_label).when((number != "") & (in_line != ""), in_line), "given": given,
        "readable": (in_label != "") | (number != ""), "_last": F.when(given.isNotNull(), F.greatest(given, F.when(last != "", last.cast("int"))))})
    earlier = Window.partitionBy("document_id").orderBy("row_order").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(F.col("_last").isNotNull(), F.struct("row_order", "_last")), ignorenulls=True).over(earlier)
    numbered = read.withColumn("_a", anchor).withColumn("expected", F.coalesce(F.col("_a._last") + F.col("row_order") - F.col("_a.row_order"), F.col("row_order")).cast("int"))
    titled = numbered.withColumn("t", _row_titles("content", "chapter_code")).withColumn("topics", F.flatten(F.transform("parts", lambda x: F.array(x["content"]))))
    topics = _row_topics(F.array_join("topics", "\n"))
    lo = F.array_distinct(F.flatten(F.transform("pairs", lambda p: codes_in(p, r"^L\.O\.(\d+(?:\.\d+)*)", "L.O."))))
    ao = F.array_distinct(F.flatten(F.transform("pairs", lambda p: codes_in(p, _AO, "A.O."))))
    return titled.select("document_id", "row_order", "page", "label", "readable", "given", "expected", F.coalesce("given", "expected").alias("session_no"), "chapter_code",
                         F.col("t.title_vi").alias("title_vi"), F.col("t.title_en").alias("title_en"), lo.alias("lo_codes"), ao.alias("ao_codes"), topics.alias("topics"))


def chapters(rows: DataFrame) -> DataFrame:
    """Chapters of the schedule: title and page of a chapter's first row, the
    topics of all of its rows, each once whatever its letter case."""
    of = rows.where("chapter_code IS NOT NULL")
    topics = of.select("document_id", "chapter_code", "row_order", F.posexplode("topics").alias("pos", "topic")).groupBy("document_id", "chapter_code", F.lower("topic").alias("low")).agg(
        F.min(F.struct("row_order", "pos", "topic")).alias("t")).groupBy("document_id", "chapter_code").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["topic"]).alias("topics"))
    first = of.groupBy("document_id", "chapter_code").agg(F.min_by(F.struct("title_vi", "title_en", "page"), "row_order").alias("f"))
    return first.join(topics, ["document_id", "chapter_code"], "left").select(
        "document_id", F.col("chapter_code").alias("code"), F.col("f.title_vi").alias("title"), F.col("f.title_en").alias("title_en"), F.col("chapter_code").cast("int").alias("sort_order"),
        F.array_join(F.coalesce("topics", F.array().cast("array<string>")), "; ").alias("topics"), F.col("f.page").alias("page"))


def topics_of(c: Column) -> Column:
    """The list of topics that was written into one string."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.btrim(x)), lambda x: x != "")


def chapter_links(rows: DataFrame) -> DataFrame:
    """Outcomes of each chapter; of repeated links the first row's page."""
    of = rows.where("chapter_code IS NOT NULL").select("document_id", "chapter_code", "row_order", "page", F.explode("lo_codes").alias("lo_code"))
    return of.groupBy("document_id", "chapter_code", "lo_code").agg(F.min_by("page", "row_order").alias("page"))


def assessment_links(lines: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of outcome and assessment: general ones of 5.3 (no ``row_order``)
    and those of each row of the schedule, kept apart, since a chapter may be
    assessed by fewer."""
    table = _table(cells, ["chuẩn đầu ra chi tiết", "learning outcome"])
    at = lambda i: F.coalesce(F.try_element_at("cells", F.size("cells") - i), F.lit(""))
    tabled = table.where(F.size("cells") >= 2).select("document_id", F.regexp_extract(at(1), _LO, 1).alias("lo"), F.explode(codes_in(at(0), _AO, "A.O.")).alias("ao_code")).where("lo <> ''")
    text = blocks(section(lines, "5.3"), _LO).join(table.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.col("code").alias("lo"), F.explode(codes_in(F.col("body"), _AO, "A.O.")).alias("ao_code"))
    general = tabled.unionByName(text).select("document_id", F.concat(F.lit("L.O."), "lo").alias("lo_code"), "ao_code", F.lit(None).cast("bigint").alias("row_order"), F.lit(None).cast("string").alias("chapter_code")).distinct()
    own = rows.select("document_id", F.explode("lo_codes").alias("lo_code"), "ao_codes", "row_order", "chapter_code").select("document_id", "lo_code", F.explode("ao_codes").alias("ao_code"), "row_order", "chapter_code")
    return general.unionByName(own.withColumn("row_order", F.col("row_order").cast("bigint")).distinct())


def findings(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """All issues of each syllabus ``(document_id, issue, severity, subject)``:
    what could not be read, and the integrity rules of the curriculum."""
    head, lo, ao, rows = courses(lines), outcomes(lines), assessments(lines, cells), schedule(cells)
    ch, links, pairs = chapters(rows), chapter_links(rows), assessment_links(lines, cells, rows)
    docs = head.select("document_id")
    row = lambda df, issue, severity, subject=F.lit(""): df.select("document_id", F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))
    without = lambda df: docs.join(df.select("document_id").distinct(), "document_id", "left_anti")
    of = lambda df: df.withColumnRenamed("document_id", "course_id")
    rules = issues(of(docs), of(lo), of(ao), of(ch), of(links), of(pairs), of(goals(lines)), of(rows)).withColumnRenamed("course_id", "document_id")
    return reduce(DataFrame.unionByName, [
        rules, row(head.where("code IS NULL"), "course.code_missing", "error"), row(head.where("title_en IS NULL"), "course.title_missing", "warning"),
        row(head.where("version IS NULL"), "course.syllabus_version_missing", "warning"), row(without(section(lines, "4.2")), "lo.section_missing", "error"),
        row(section(lines, "4.2").select("document_id").distinct().join(lo.select("document_id").distinct(), "document_id", "left_anti"), "lo.none_extracted", "error"),
        row(lo.where("times > 1"), "lo.duplicate_code", "warning", F.col("code")), row(lo.where("statement_en IS NULL"), "lo.missing_english", "warning", F.col("code")),
        row(without(_table(cells, ["loại hoạt", "activity"])), "assessment.table_missing", "warning"), row(without(ao), "assessment.none_extracted", "error"),
        row(without(rows), "session.table_missing", "error"), row(rows.where("NOT readable"), "session.unreadable_label", "warning", F.col("label")),
        row(rows.where("given <> expected"), "session.number_mismatch", "warning", F.col("given")),
    ])
