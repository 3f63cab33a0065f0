"""Sections from page lines, updates of the page report, plans for re-reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.pages import bounded_ranges, page_ranges

# Marks of a continued slide at the end of its title.
CONTINUED = r"(?i)\s*(?:\((?:tiếp(?: theo)?|cont\.?|continued|suite|forts\.?|\d+)\)|(?:cont\.|continued))\s*$"


def paragraphs(lines: DataFrame) -> DataFrame:
    """Sections of each page: a heading line (``level`` > 0) stands alone,
    consecutive body lines of a block make one paragraph."""
    by = Window.partitionBy("document_id", "page").orderBy("ord")
    block = F.coalesce("block_index", F.lit(-1))
    starts = (F.col("level") > 0) | (F.lag("level").over(by) > 0) | (block != F.lag(block).over(by)) | F.lag("ord").over(by).isNull()
    grouped = lines.withColumn("grp", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(by))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return grouped.groupBy("document_id", "page", "grp").agg(text.alias("content"), F.max("level").alias("level"), F.min("ord").alias("ord")).select(
        "document_id", "page", "ord", F.when(F.col("level") > 0, "heading").otherwise("paragraph").alias("element_type"), "level", "content")


def _listed(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page").distinct().withColumn("_listed", F.lit(True))


def mark_failure(report: DataFrame, pages: DataFrame, backend: str) -> DataFrame:
    """Add ``<backend>_failed`` to the reasons of the listed pages, once; the
    pages do not count as tried."""
    reason = f"{backend}_failed"
    out = report.join(_listed(pages), ["document_id", "page"], "left")
    return out.withColumn("reasons", F.when(F.col("_listed"), F.array_union(F.coalesce("reasons", F.array().cast("array<string>")), F.array(F.lit(reason)))).otherwise(F.col("reasons"))).drop("_listed")


def mark_attempt(report: DataFrame, pages: DataFrame, backend: str) -> DataFrame:
    """Add a reader to the attempts of the listed pages, once."""
    out = report.join(_listed(pages), ["document_id", "page"], "left")
    return out.withColumn("attempts", F.when(F.col("_listed"), F.array_union(F.coalesce("attempts", F.array().cast("array<string>")), F.array(F.lit(backend)))).otherwise(F.col("attempts"))).drop("_listed")


def mark_parsed(report: DataFrame, pages: DataFrame, backend: str, layout_aware: bool) -> DataFrame:
    """The listed pages were read by ``backend``; knowing the layout is kept."""
    out = report.join(_listed(pages), ["document_id", "page"], "left")
    return out.withColumns({
        "parsed_by": F.when(F.col("_listed"), F.lit(backend)).otherwise(F.col("parsed_by")),
        "layout_aware": F.when(F.col("_listed") & F.lit(layout_aware), F.lit(True)).otherwise(F.col("layout_aware"))}).drop("_listed")


def reread_plan(report: DataFrame, full_share: float = 0.5, most_ranges: int = 8) -> DataFrame:
    """Ranges of pages that the second reader has to read: the whole file
    where half of its pages need it, else at most ``most_ranges`` ranges."""
    need = F.col("status") == "needs_ocr"
    per = report.groupBy("document_id").agg(F.count_if(F.coalesce(need, F.lit(False))).alias("need"), F.count("*").alias("pages"), F.min("page").alias("first"), F.max("page").alias("last"))
    whole = F.col("need") >= full_share * F.col("pages")
    full = per.where((F.col("need") > 0) & whole).select("document_id", "first", "last", F.lit(True).alias("whole"))
    some = per.where((F.col("need") > 0) & ~whole).select("document_id")
    ranges = bounded_ranges(page_ranges(report.where(need).join(some, "document_id", "left_semi")), most_ranges)
    return full.unionByName(ranges.select("document_id", "first", "last", F.lit(False).alias("whole")))


def slide_title(c: Column) -> Column:
    """Title without marks of continuation, single blanks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), CONTINUED, ""))


def slides(sections: DataFrame) -> DataFrame:
    """Slides of a deck, continued ones joined to their first: the deck's title
    is the path's first part, a slide without title takes the last one."""
    by = Window.partitionBy("document_id").orderBy("page_number", "ord")
    titled = sections.withColumn("title", F.when(F.length(F.btrim(F.coalesce("heading", F.lit("")))) > 0, slide_title(F.col("heading"))))
    filled = titled.withColumn("title", F.coalesce("title", F.last("title", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.concat(F.lit("Slide "), F.col("page_number").cast("string"))))
    new = F.coalesce(F.col("title") != F.lag("title").over(by), F.lit(True))
    grouped = filled.withColumn("grp", F.sum(new.cast("int")).over(by))
    return grouped.groupBy("document_id", "grp").agg(
        F.first("title").alias("title"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("slides"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "ord", "content"))), lambda x: x["content"]), "\n").alias("content")).drop("grp")
