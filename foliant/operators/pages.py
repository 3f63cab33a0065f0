"""Page-level analysis of documents given as lines, metrics or reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import margin_key

# Thresholds of the page classes.
MIN_CHARS, SCAN_COVERAGE = 40, 0.5
# Classes that need another reader, and those without usable text.
FALLBACK, NO_TEXT = ["needs_ocr", "complex_layout"], ["needs_ocr"]


def classify(metrics: DataFrame) -> DataFrame:
    """``status`` of each page with the ``reasons`` for it.

    Enough characters: text, or a complex layout with several columns or
    tables.  Fewer: a page that an image covers, or that has any image or
    drawing, must be read again; else what there is counts as sparse text."""
    enough = F.coalesce(F.col("char_count"), F.lit(0)) >= MIN_CHARS
    image = F.coalesce(F.col("image_area_ratio"), F.lit(0.0))
    drawn = (image > 0) | (F.coalesce(F.col("drawing_count"), F.lit(0)) > 0)
    columns, tables = F.coalesce(F.col("multi_column"), F.lit(False)), F.coalesce(F.col("table_count"), F.lit(0)) > 0
    some = F.coalesce(F.col("char_count"), F.lit(0)) > 0
    status = (
        F.when(enough & (columns | tables), "complex_layout").when(enough, "text").when((image >= SCAN_COVERAGE) | drawn, "needs_ocr").when(some, "text").otherwise("empty")
    )
    reasons = F.array_compact(F.array(
        F.when(enough & columns, "multi_column"), F.when(enough & tables, "table_detected"), F.when(~enough & (image >= SCAN_COVERAGE), "image_page"),
        F.when(~enough & (image < SCAN_COVERAGE) & drawn, "no_text_layer"), F.when(~enough & ~drawn & some, "sparse_text")))
    return metrics.withColumns({"status": status, "reasons": reasons})


def heading_thresholds(lines: DataFrame) -> DataFrame:
    """Font sizes from which a line is a heading of level 1, 2, 3: steps of
    0.8, 1.5 and 2.2 gaps above body text, a gap being a third of the way to
    the greatest size, or 2 points where all sizes are alike."""
    per = lines.groupBy("document_id").agg(F.median("size").alias("body"), F.max("size").alias("top"))
    gap = F.when(F.col("top") > F.col("body"), (F.col("top") - F.col("body")) / 3).otherwise(2.0)
    return per.select("document_id", "body", *((F.col("body") + gap * step).alias(name) for name, step in (("h3", 0.8), ("h2", 1.5), ("h1", 2.2))))


def heading_levels(lines: DataFrame) -> DataFrame:
    """0 for body text; bold type above the size of body text is level 3."""
    bold = F.coalesce(F.col("bold"), F.lit(False)) & (F.col("size") > F.col("body"))
    level = F.when(F.col("size") >= F.col("h1"), 1).when(F.col("size") >= F.col("h2"), 2).when((F.col("size") >= F.col("h3")) | bold, 3).otherwise(0)
    return lines.join(heading_thresholds(lines), "document_id").withColumn("level", level)


def running_marginals(lines: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Margin lines that recur, numbers aside, on enough of a document's pages."""
    keyed = lines.withColumn("key", margin_key(F.col("text")))
    total = keyed.groupBy("document_id").agg(F.count_distinct("page").alias("total"))
    per = keyed.where("margin").groupBy("document_id", "key").agg(F.count_distinct("page").alias("pages"))
    return per.join(total, "document_id").where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("total") * share))).select("document_id", "key", "pages")


def without_marginals(lines: DataFrame) -> DataFrame:
    keyed = lines.withColumn("key", margin_key(F.col("text")))
    found = running_marginals(lines).select("document_id", "key").withColumn("margin", F.lit(True))
    return keyed.join(found, ["document_id", "key", "margin"], "left_anti")


def body_size(lines: DataFrame, empty: float = 12.0) -> DataFrame:
    """Font size at which half of a document's characters are reached."""
    per = lines.groupBy("document_id", "size").agg(F.sum(F.length("text")).alias("n"))
    by = Window.partitionBy("document_id").orderBy("size")
    run = per.withColumns({"run": F.sum("n").over(by), "total": F.sum("n").over(Window.partitionBy("document_id"))})
    return run.groupBy("document_id").agg(F.coalesce(F.min(F.when(2 * F.col("run") >= F.col("total"), F.col("size"))), F.lit(empty)).alias("body_size"))


def slide_decks(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """Is a document a deck: nearly all pages wide, and little text on them?"""
    wide = F.avg((F.col("width") >= 1.2 * F.col("height")).cast("double")) >= 0.8
    auto = wide & (F.median("chars") <= 1500)
    return pages.groupBy("document_id").agg({"auto": auto, "always": F.lit(True), "never": F.lit(False)}[mode].alias("slides"))


def _page_columns() -> dict[str, Column]:
    """Conditions of a report row; readers are counted by their attempts."""
    tried = F.size(F.coalesce("attempts", F.array()))
    lost = F.col("parsed_by").isNull() & F.coalesce(F.col("status").isin(NO_TEXT), F.lit(False))
    return {
        "needs_fallback": F.coalesce(F.col("status").isin(FALLBACK), F.lit(False)) & (tried <= 1),
        "unprocessed": lost & (tried <= 1),
        "no_text": lost & (tried > 1),
        "degraded": F.coalesce(F.col("status") == "complex_layout", F.lit(False)) & ~F.coalesce("layout_aware", F.lit(False)),
    }


def page_sets(report: DataFrame) -> DataFrame:
    """Sets each page belongs to: it needs the other reader, no reader tried
    to get its missing text, a second one found none, or its layout was read
    by no reader that knows layouts."""
    return report.select("document_id", "page", F.array_compact(F.array(*(F.when(c, name) for name, c in _page_columns().items()))).alias("sets"))


def coverage(report: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row a document: pages by status and by reader, pages of each open
    set as ranges, resolved pages (read, or empty) and completeness.

    ``totals`` ``(document_id, pages_total)``: pages beyond the examined ones
    are listed as skipped and make a document incomplete."""
    sets = _page_columns()
    marked = report.withColumns({f"_{k}": v for k, v in sets.items()})
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    per = marked.groupBy("document_id").agg(
        F.count("*").alias("pages"), count(F.col("status") == "text", "text_pages"), count(F.col("status") == "needs_ocr", "ocr_pages"),
        count(F.col("status") == "complex_layout", "complex_pages"), count(F.col("status") == "empty", "empty_pages"), count(F.col("status").isNull(), "unknown_pages"),
        count(F.col("parsed_by").isNotNull() | (F.col("status") == "empty"), "resolved"),
        *(count(F.col(f"_{k}"), k) for k in ("unprocessed", "no_text", "degraded")), F.max("page").alias("_examined"))
    readers = report.where("parsed_by IS NOT NULL").groupBy("document_id", "parsed_by").agg(F.count("*").alias("n")).groupBy("document_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "parsed_by", F.col("n").cast("string")))), ",").alias("by_reader"))
    out = per.join(readers, "document_id", "left")
    for k in ("unprocessed", "no_text", "degraded"):
        listed = format_ranges(page_ranges(marked.where(f"_{k}"))).withColumnRenamed("pages", f"{k}_pages")
        out = out.join(listed, "document_id", "left")
    if totals is not None:
        out = out.join(totals.groupBy("document_id").agg(F.max("pages_total").alias("pages_total")), "document_id", "left")
    else:
        out = out.withColumn("pages_total", F.col("_examined"))
    skipped = F.greatest(F.coalesce("pages_total", "_examined") - F.col("_examined"), F.lit(0))
    return out.withColumn("skipped", skipped.cast("int")).withColumn(
        "complete", (F.col("unprocessed") + F.col("no_text") + F.col("degraded") + F.col("skipped")) == 0).drop("_examined", "pages_total")


def missing_text(report: DataFrame) -> DataFrame:
    """Documents with pages whose text no reader tried to get: how many of
    how many, and which."""
    lost = report.where(_page_columns()["unprocessed"])
    size = report.groupBy("document_id").agg(F.count("*").alias("examined"))
    return format_ranges(page_ranges(lost)).join(lost.groupBy("document_id").agg(F.count_distinct("page").alias("missing")), "document_id").join(size, "document_id")


def page_ranges(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages of each document."""
    by = Window.partitionBy("document_id").orderBy("page")
    numbered = pages.select("document_id", "page").where("page IS NOT NULL").distinct().withColumn("run", F.col("page") - F.row_number().over(by))
    return numbered.groupBy("document_id", "run").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("run")


def bounded_ranges(ranges: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ranges a document: the smallest gaps close first, the
    left one of equals.  A closed gap changes no other, so the ``most - 1``
    widest gaps (of equals the right ones) are those that stay."""
    if most <= 0:
        return ranges
    by = Window.partitionBy("document_id").orderBy("first")
    gap = F.col("first") - F.lag("last").over(by)
    ranked = ranges.withColumn("gap", gap).withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("gap").desc_nulls_last(), F.desc("first"))))
    cut = F.col("gap").isNotNull() & (F.col("rank") <= most - 1)
    grouped = ranked.withColumn("grp", F.sum(cut.cast("int")).over(by))
    return grouped.groupBy("document_id", "grp").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("grp")


def format_ranges(ranges: DataFrame) -> DataFrame:
    """``3-5, 12`` for each document."""
    shown = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    rows = F.sort_array(F.collect_list(F.struct("first", shown.alias("s"))))
    return ranges.groupBy("document_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), ", ").alias("pages"))


def merge_pages(base: DataFrame, other: DataFrame, replaced: DataFrame) -> DataFrame:
    """Sections of the replaced pages from ``other``, all else from ``base``."""
    keys = ["document_id", "page_number"]
    pages = replaced.select("document_id", F.col("page").alias("page_number")).distinct()
    return base.join(pages, keys, "left_anti").unionByName(other.join(pages, keys, "left_semi"))


def pages_at(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """Page in which each character offset lies.

    Spans of a document are disjoint, so offset and span starts are merged in
    one ordered pass instead of compared with one another.
    """
    marks = spans.select("document_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("page", "end").alias("span")).unionByName(
        offsets.select("document_id", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<page:int,end:bigint>").alias("span")))
    by = Window.partitionBy("document_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marks.withColumn("span", F.last("span", ignorenulls=True).over(by)).where("kind = 1")
    return last.select("document_id", F.col("at").alias("offset"), F.when(F.col("at") <= F.col("span.end"), F.col("span.page")).alias("page"))


# Words that name a table of contents.
TOC_WORDS = ["mục lục", "table of contents", "danh mục"]
_LEADER = r"\.{3,}\s*\d+\s*$"
#: Every line end that text may have.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_BLANK = " \t\r\n\u000b\u000c"


def toc_scores(sections: DataFrame) -> DataFrame:
    """Score of each section for being part of a table of contents: 2 for its
    words in the heading or in a content of at most 60 characters, 1 in the
    first fifth of the document, 2 or 1 from 40 or 20 percent of lines with a
    leader and a page, 1 for at least 5 lines, 70 percent of them short."""
    by = Window.partitionBy("document_id")
    named = lambda c: F.coalesce(F.forall(F.lit(TOC_WORDS), lambda w: ~F.contains(F.lower(c), w)), F.lit(True))
    text = F.btrim(F.coalesce("content", F.lit("")), F.lit(_BLANK))
    lines = F.filter(F.transform(F.split(text, LINE_END), lambda x: F.btrim(x, F.lit(_BLANK))), lambda x: x != "")
    n = F.size("lines")
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    leader = share(F.size(F.filter("lines", lambda x: x.rlike(_LEADER))))
    short = share(F.size(F.filter("lines", lambda x: F.length(x) < 80)))
    word = ~named(F.coalesce("heading", F.lit(""))) | ((F.length("text") <= 60) & ~named(F.col("text")))
    idx = F.row_number().over(Window.partitionBy("document_id").orderBy("ord")) - 1
    placed = sections.withColumns({"text": text, "lines": lines, "idx": idx, "total": F.count("*").over(by)})
    score = (
        F.when(word, 2).otherwise(0) + F.when(F.col("idx") <= 0.2 * F.col("total"), 1).otherwise(0)
        + F.when(leader >= 0.4, 2).when(leader >= 0.2, 1).otherwise(0) + F.when((n >= 5) & (short >= 0.7), 1).otherwise(0)
    )
    return placed.withColumn("score", score).drop("lines", "text")


def toc_sections(scored: DataFrame) -> DataFrame:
    """Sections of a table of contents: runs that score 2 or more and begin
    at most five sections after the first quarter, or after the third."""
    by = Window.partitionBy("document_id").orderBy("idx")
    hit = F.col("score") >= 2
    run = F.sum((~hit).cast("int")).over(by)
    marked = scored.withColumn("run", run).where(hit)
    begins = F.min("idx").over(Window.partitionBy("document_id", "run"))
    last = F.greatest(F.lit(3), F.floor(F.col("total") * 0.25)) + 5
    return marked.withColumn("begins", begins).where(F.col("begins") <= last).select("document_id", "ord", "score")


# Bands at the top and bottom of a page that are its margin.
MARGIN_BAND = 0.07


def lines_of(spans: DataFrame) -> DataFrame:
    """Lines from spans ``(document_id, page, height, ord, span, text, size,
    flags, bbox)``: their texts joined, the style of the longest span (bold:
    flag 16, italic: flag 2), and whether the line lies wholly in a margin;
    blank lines leave."""
    longest = F.max_by(F.struct("size", "flags"), F.struct(F.length("text"), -F.col("span")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "")
    lines = spans.where("text IS NOT NULL").groupBy("document_id", "page", "ord").agg(
        F.btrim(text).alias("text"), longest.alias("style"), F.max("height").alias("height"), F.min("bbox.y0").alias("y0"), F.max("bbox.y1").alias("y1"))
    in_margin = (F.col("y1") <= F.col("height") * MARGIN_BAND) | (F.col("y0") >= F.col("height") * (1 - MARGIN_BAND))
    flag = lambda n: F.col("style.flags").bitwiseAND(F.lit(n)) > 0
    return lines.where("text <> ''").select("document_id", "page", "ord", "text", F.col("style.size").alias("size"), flag(16).alias("bold"), flag(2).alias("italic"), in_margin.alias("margin"))


def measured(lines: DataFrame, areas: DataFrame, layout: DataFrame) -> DataFrame:
    """Metrics of pages for ``classify``: characters and lines outside the
    margins; drawings count only where there is little text and no image that
    covers the page, columns and tables only where there is enough text.
    ``areas (document_id, page, image_area_ratio, drawing_count)``; ``layout
    (document_id, page, multi_column, table_count)``."""
    keys = ["document_id", "page"]
    text = lines.where(~F.coalesce("margin", F.lit(False))).groupBy(*keys).agg(F.sum(F.length("text")).cast("int").alias("char_count"), F.count("*").cast("int").alias("line_count"))
    every = areas.join(text, keys, "full").join(layout, keys, "left")
    chars, ratio = F.coalesce("char_count", F.lit(0)), F.coalesce("image_area_ratio", F.lit(0.0))
    enough = chars >= MIN_CHARS
    return every.select(
        *keys, chars.alias("char_count"), F.coalesce("line_count", F.lit(0)).alias("line_count"), ratio.alias("image_area_ratio"),
        F.when(~enough & (ratio < SCAN_COVERAGE), F.coalesce("drawing_count", F.lit(0))).otherwise(0).alias("drawing_count"),
        (enough & F.coalesce("multi_column", F.lit(False))).alias("multi_column"), F.when(enough, F.coalesce("table_count", F.lit(0))).otherwise(0).alias("table_count"))


def report_rows(assessed: DataFrame, backend: str) -> DataFrame:
    """Rows of the page report after the first reader: it holds a page if it
    has characters and needs no other reading."""
    held = (F.col("char_count") > 0) & (F.col("status") != "needs_ocr")
    return assessed.select("document_id", "page", "status", F.col("char_count").alias("chars"), "reasons", F.array(F.lit(backend)).alias("attempts"), F.when(held, F.lit(backend)).alias("parsed_by"), F.lit(False).alias("layout_aware"))


def images_within(images: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Images of each document in order, as long as all before and itself are
    within the budget; the rest is left out without an error."""
    run = F.sum(F.coalesce("bytes", F.lit(0))).over(Window.partitionBy("document_id").orderBy("page", "nth"))
    return images.withColumn("run", run).where(F.col("run") <= most_bytes).drop("run")


def placed_in_range(sections: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections that a reader made of ranges of pages, on their pages: blank
    ones leave, those without a page belong to the first of their range, those
    outside come back apart.  ``ranges (document_id, range_no, first, last)``."""
    met = sections.where(F.btrim(F.coalesce("content", F.lit(""))) != "").join(ranges, ["document_id", "range_no"]).withColumn("page_number", F.coalesce("page_number", "first"))
    inside = F.col("page_number").between(F.col("first"), F.col("last"))
    return met.where(inside).drop("first", "last"), met.where(~inside).drop("first", "last")
