"""Reads for a course assistant, with their limits, and look-ups of one row.

Limits are part of these tools: 60 documents, 8 chunks a page with the total,
3 neighbours on each side, 2 hops, 25 relations, 1 800 characters of a text.
Unknown ids give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import graph as G
from foliant.operators import reads as R

MOST_DOCUMENTS, MOST_CHUNKS, MOST_WINDOW, MOST_HOPS, MOST_RELATIONS, MOST_CHARS = 60, 8, 3, 2, 25, 1800


def clamped(value: int | None, least: int, most: int, default: int) -> int:
    return default if value is None else max(least, min(most, value))


def shown(chunks: DataFrame) -> DataFrame:
    """Chunks with at most 1 800 characters, and whether more was there."""
    return chunks.withColumns({"truncated": F.length("content") > MOST_CHARS, "content": F.substring("content", 1, MOST_CHARS)})


def document(docs: DataFrame, document_id: str) -> DataFrame:
    return docs.where((F.col("document_id") == document_id) & R.alive())


def context(docs: DataFrame, document_id: str, language: str = "vi") -> DataFrame:
    """Course and title of a live document, and the language of its course."""
    return document(docs, document_id).select("document_id", "course_id", "title", F.lit(language).alias("language"))


def status(docs: DataFrame, document_id: str) -> DataFrame:
    return document(docs, document_id).select("document_id", F.upper(F.btrim("status")).alias("status"))


def generation(docs: DataFrame, document_id: str) -> DataFrame:
    return document(docs, document_id).select("document_id", F.coalesce("processing_generation", F.lit(0)).alias("generation"))


def placement(docs: DataFrame, document_id: str) -> DataFrame:
    """Role and chapter, of deleted documents too."""
    return docs.where(F.col("document_id") == document_id).select("document_id", "role", "chapter_code")


def course_list(docs: DataFrame, chunks: DataFrame, course_id: str, chapter: str | None = None) -> DataFrame:
    some = R.course_documents(docs, chunks, chapter).where(F.col("course_id") == course_id)
    return some.orderBy(F.expr("try_cast(chapter_code AS int)").asc_nulls_last(), F.col("chapter_code").asc_nulls_last(), "title", "document_id").limit(MOST_DOCUMENTS)


def page(docs: DataFrame, chunks: DataFrame, document_id: str, number: int, course_id: str | None = None) -> DataFrame:
    """The first chunks of a page of a visible document, with the page's total."""
    some = docs.where(F.col("document_id") == document_id)
    if course_id is not None:
        some = some.where(F.col("course_id") == course_id)
    rows = R.page_chunks(some, chunks, number).join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("total", F.count("*").over(Window.partitionBy()))  # one page
    return shown(rows.orderBy("sort_order", "chunk_id").limit(MOST_CHUNKS))


def around(docs: DataFrame, chunks: DataFrame, chunk_id: str, window: int | None = None) -> DataFrame:
    anchors = chunks.where(F.col("chunk_id") == chunk_id).select("chunk_id")
    rows = R.neighbours(chunks, docs, anchors, clamped(window, 1, MOST_WINDOW, 1))
    return shown(rows.join(chunks.select("chunk_id", "content"), "chunk_id")).orderBy("sort_order")


def relations(rel: DataFrame, chunks: DataFrame, docs: DataFrame, course_id: str, concept: str, hops: int | None = None, limit: int | None = None) -> DataFrame:
    """Relations of a concept as JSON objects, in order of discovery."""
    seen = G.course_relations(rel, chunks, docs, course_id)
    found = G.reachable(seen, concept, clamped(hops, 1, MOST_HOPS, 1), clamped(limit, 1, MOST_RELATIONS, MOST_RELATIONS))
    return found.select("rank", "relation_id", "hop", F.to_json(F.struct(F.col("source_key").alias("source"), F.col("relation_type").alias("relation"), F.col("target_key").alias("target"), "document_id", "page_number", "hop")).alias("json"))
