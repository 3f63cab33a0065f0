"""Reads of the document store: current versions, visibility, look-ups, joins.

A key may have several versions (files ingested again, rows sent again); the
current one is chosen by a maximum over the ordering columns, which combines
on the map side, so a key with very many versions is no skew.  Null keys are
kept as one group of their own; empty tables give empty results.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import doc_type
from foliant.operators.ordered import next_value, ranked


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in ``order`` (nulls least)."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(best).select("row.*")


DOCUMENT_ORDER = ["processing_generation", "created_at", "status", "mime_type", "title", "language", "deleted_at", "file_path", "role", "chapter_code", "lms_published", "page_count", "course_id"]
CHUNK_ORDER = ["created_at", "sort_order", "content", "deleted_at", "document_id", "language", "course_id", "page_number"]


def current_documents(metas: DataFrame) -> DataFrame:
    return latest(metas, ["document_id"], [c for c in DOCUMENT_ORDER if c in metas.columns])


def current_chunks(chunks: DataFrame) -> DataFrame:
    return latest(chunks, ["chunk_id"], [c for c in CHUNK_ORDER if c in chunks.columns])


def alive() -> Column:
    return F.col("deleted_at").isNull()


def shown() -> Column:
    """Unknown is visible: only an explicit false hides."""
    return F.coalesce(F.col("lms_published"), F.lit(True))


def visible_documents(docs: DataFrame) -> DataFrame:
    return docs.where(alive() & shown())


def hidden_documents(docs: DataFrame, course_id: str | None = None) -> DataFrame:
    """Ids of documents unpublished or deleted, of one course or of all."""
    out = docs.where(~(alive() & shown()))
    return (out.where(F.col("course_id") == course_id) if course_id is not None else out).select("document_id")


def list_documents(
    docs: DataFrame, doc_types: list[str] | None = None, language: str | None = None, after: datetime | None = None,
    before: datetime | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """Live documents, newest first; a condition applies only if it is given."""
    out = docs.where(alive()).withColumn("doc_type", doc_type(F.col("mime_type"), F.col("file_path")))
    if doc_types:
        out = out.where(F.col("doc_type").isin(doc_types))
    if language is not None:
        out = out.where(F.lower("language") == language)
    if after is not None:
        out = out.where(F.col("created_at") >= F.lit(after))
    if before is not None:
        out = out.where(F.col("created_at") < F.lit(before))
    return out.orderBy(F.col("created_at").desc_nulls_last(), "document_id").offset(offset).limit(limit)


def course_documents(docs: DataFrame, chunks: DataFrame, chapter: str | None = None) -> DataFrame:
    """Visible documents with their live chunks counted and their last page."""
    some = visible_documents(docs)
    if chapter is not None:
        some = some.where(F.col("chapter_code") == chapter)
    per = chunks.where(alive()).groupBy("document_id").agg(F.max("page_number").alias("pages"), F.count("*").alias("chunks"))
    return some.join(per, "document_id").select(
        "course_id", "document_id", "title", "chapter_code", F.coalesce("pages", F.lit(0)).alias("pages"), "chunks")


def document_summaries(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """All live documents with their number of live chunks (0 included)."""
    per = chunks.where(alive()).groupBy("document_id").agg(F.count("*").alias("n"))
    return docs.where(alive()).join(per, "document_id", "left").select(
        "document_id", "title", doc_type(F.col("mime_type"), F.col("file_path")).alias("doc_type"), "mime_type", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def page_chunks(docs: DataFrame, chunks: DataFrame, page: int) -> DataFrame:
    """Live chunks that cover a page of a visible document."""
    return visible_documents(docs).select("document_id", "title").join(chunks.where(alive() & (F.col("page_start") <= page) & (F.col("page_end") >= page)), "document_id").select(
        "document_id", "title", "chunk_id", "page_number", "sort_order")


def neighbours(chunks: DataFrame, docs: DataFrame, anchors: DataFrame, window: int = 1) -> DataFrame:
    """Live chunks within ``window`` places of each anchor in its document.

    The places an anchor asks for are few and known, so the range join is an
    equi-join on (document, place): no pairs of a long document are formed.
    """
    live = chunks.where(alive()).join(visible_documents(docs).select("document_id"), "document_id", "left_semi").select("document_id", "sort_order", "chunk_id", "content")
    at = live.join(anchors.select("chunk_id").distinct(), "chunk_id", "left_semi").select("document_id", F.col("chunk_id").alias("anchor"), F.col("sort_order").alias("place"))
    wanted = at.select("document_id", "anchor", "place", F.explode(F.sequence(F.col("place") - window, F.col("place") + window)).alias("sort_order"))
    return wanted.join(live, ["document_id", "sort_order"]).select("anchor", "chunk_id", "sort_order", (F.col("sort_order") - F.col("place")).alias("distance"))


def next_edges(chunks: DataFrame) -> DataFrame:
    """Each live chunk with the one after it in its document; long documents
    are ordered in blocks."""
    live = chunks.where(alive() & F.col("document_id").isNotNull() & F.col("chunk_id").isNotNull()).select("document_id", "chunk_id", "sort_order")
    return next_value(live, "document_id", "sort_order", "chunk_id").where("next_chunk_id IS NOT NULL").select("document_id", "chunk_id", F.col("next_chunk_id").alias("next_id"))


def cards(cards_: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each card and chunk it was made from, numbered by document."""
    pairs = cards_.where(alive()).select("card_id", "created_at", F.explode(F.array_distinct("source_chunk_ids")).alias("chunk_id"))
    w = Window.partitionBy("document_id").orderBy("sort_order", "created_at", "card_id", "chunk_id")
    joined = pairs.join(chunks.where(F.col("deleted_at").isNull()).select("chunk_id", "document_id", "sort_order"), "chunk_id")
    return joined.select("document_id", "card_id", "chunk_id", (F.row_number().over(w) - 1).alias("card_index"))


def chunks_for_outcomes(mappings: DataFrame, chunks: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """Mapped visible chunks of every outcome, ranked: lecture material before
    references, surer ones first.

    One outcome may hold a third of all rows: with ``most`` every task ranks
    its own rows first and sends ``most`` of an outcome on; the whole ranking
    is sorted in ranges, see ``ordered.ranked``."""
    order = [F.coalesce(F.col("role") == "reference", F.lit(False)).asc(), F.col("confidence").desc_nulls_last(), F.col("sort_order").asc_nulls_last(), F.col("chunk_id").asc()]
    rows = (
        mappings.where(F.col("lo_id").isNotNull()).join(chunks.where(alive()).select("chunk_id", "document_id", "sort_order"), "chunk_id")
        .join(visible_documents(docs).select("document_id", "role"), "document_id").select("lo_id", "chunk_id", "confidence", "role", "sort_order"))
    if most is None:
        return ranked(rows, ["lo_id"], order).drop("sort_order")
    place = F.row_number().over(Window.partitionBy("lo_id").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= most).drop("sort_order")
