"""Ingestion of many files as one batch: preprocess, chunk, embed, index,
commit, report.

Each step is a frame; a file that fails in one becomes a row with its error
and leaves the following ones.  Chunks, points, outbox events and statuses are
committed as one version, so readers see all of a run or nothing, and a run
that is repeated after a loss gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import doc_type
from foliant.operators import vector_store as V
from foliant.operators.embedding import embed
from foliant.operators.writes import replace_pending, snapshot_replace
from foliant.session import materialize
from foliant.sources import tables

#: Types that have a reader.
SUPPORTED = ("pdf", "docx", "pptx", "markdown")
CHUNKS = "chunk_id string, document_id string, course_id string, sort_order int, content string, embedding_input string, content_hash string, heading_path array<string>, page_number int, content_type string, language string, created_at timestamp, deleted_at timestamp"
EVENTS = "event_id string, event_type string, aggregate_type string, aggregate_id string, payload string, status string, retry_count int"


def resolved(files: DataFrame) -> DataFrame:
    """``doc_type`` of each file by media type or name, and the error of those
    without a reader."""
    kind = doc_type(F.col("mime_type"), F.col("file_path"))
    return files.withColumn("doc_type", kind).withColumn("error", F.when(~kind.isin(*SUPPORTED), F.concat(F.lit("unsupported type: "), F.coalesce("mime_type", "file_path", F.lit("?")))))


def preprocessed(sections: DataFrame, steps: list[tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """Each step ``(change, applies)`` in order, on the contents it applies
    to; where a step gives null, which is how it fails, the content stays."""
    out = sections
    for change, applies in steps:
        out = out.withColumn("content", F.when(F.coalesce(applies, F.lit(False)), F.coalesce(change(F.col("content")), F.col("content"))).otherwise(F.col("content")))
    return out


def language_or_default(c: Column, default: str = "vi") -> Column:
    """A language that chunks may have, else the default."""
    return F.when(F.lower(c).isin("vi", "en", "mixed"), F.lower(c)).otherwise(default)


def content_or_input(content: Column, embedding_input: Column) -> Column:
    """The text of a chunk: its content, else what was embedded, else empty."""
    return F.coalesce(F.nullif(content, F.lit("")), embedding_input, F.lit(""))


def current(files: DataFrame, generations: DataFrame) -> DataFrame:
    """Files whose generation is not behind the one that is known by now: of
    others the run stops without an error."""
    now = generations.groupBy("document_id").agg(F.max("processing_generation").alias("_now"))
    return files.join(now, "document_id", "left").where(F.coalesce("processing_generation", F.lit(0)) >= F.coalesce("_now", F.lit(0))).drop("_now")


def ingest(
    spark: SparkSession, root: str, files: DataFrame, sections: DataFrame, chunker: Callable[[DataFrame], DataFrame], now: Column, dimension: int = 64, load=None,
    steps: list[tuple[Callable[[Column], Column], Column]] = (), generations: DataFrame | None = None,
) -> int:
    """Run the pipeline and commit ``chunks``, ``points``, ``outbox`` and
    ``statuses`` below ``root``; the version.

    ``files``: one live row a document (document_id, course_id, owner_id,
    title, mime_type, file_path, created_at, processing_generation, language,
    deleted_at); ``sections`` as the chunkers take them; ``load`` gives the
    embedding model.  Statuses: INDEXED with the number of chunks, or ERROR
    with its reason."""
    V.bootstrap(spark, root, dimension)
    todo = resolved(files.where("deleted_at IS NULL AND document_id IS NOT NULL"))
    if generations is not None:
        todo = current(todo, generations)
    todo = materialize(todo, "files")
    good = todo.where("error IS NULL")
    read = preprocessed(sections.join(good.select("document_id"), "document_id", "left_semi"), list(steps))
    made = materialize(embed(chunker(read), "embedding_input", dimension, load), "chunks")
    of = good.select("document_id", "course_id", language_or_default(F.col("language")).alias("language"))
    new = made.join(of, "document_id").select(
        "chunk_id", "document_id", "course_id", F.col("chunk_index").alias("sort_order"), "content", "embedding_input", "content_hash", F.col("path").alias("heading_path"), "page_number", "content_type", "language",
        now.alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    have = tables.manifest(spark, root)
    stored = {n: tables.read(spark, root, n) if n in have else spark.createDataFrame([], s) for n, s in (("chunks", CHUNKS), ("points", V.POINTS), ("outbox", EVENTS))}
    counts = made.groupBy("document_id").agg(F.count("*").alias("chunks"))
    done = todo.join(counts, "document_id", "left").select(
        "document_id", F.col("processing_generation").alias("generation"), F.coalesce("error", F.when(F.col("chunks").isNull(), "no text")).alias("error"), F.coalesce("chunks", F.lit(0)).cast("int").alias("chunks"))
    statuses = done.select("document_id", "generation", F.when(F.col("error").isNull(), "INDEXED").otherwise("ERROR").alias("status"), "error", "chunks")
    event = statuses.where("status = 'INDEXED'").select(
        F.sha1(F.concat_ws(":", "document_id", F.coalesce("generation", F.lit(0)).cast("string"))).alias("event_id"), F.lit("HEADING_GRAPH_PROJECT").alias("event_type"), F.lit("document").alias("aggregate_type"),
        F.col("document_id").alias("aggregate_id"), F.to_json(F.struct("chunks")).alias("payload"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"))
    points = V.upserted(stored["points"], V.points(made.withColumn("heading_path", F.col("path")), made, good), dimension)
    return tables.commit(spark, root, {
        "chunks": snapshot_replace(stored["chunks"], new, files, now), "points": V.without_stale(points, new), "outbox": replace_pending(stored["outbox"], event), "statuses": statuses})


def enriched(concepts: DataFrame, mentions: DataFrame, outbox: DataFrame, new_concepts: DataFrame, new_mentions: DataFrame, chunks: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Concepts, mentions and outbox after an enrichment of live documents
    with live chunks, to be committed as one version: mentions of the files'
    chunks are replaced, and a pending event of each gives way to a new one."""
    from foliant.operators.writes import replace_mentions, upsert_concepts

    alive = chunks.where("deleted_at IS NULL").join(docs.where("deleted_at IS NULL").select("document_id"), "document_id", "left_semi").select("chunk_id", "document_id")
    told = new_mentions.select("chunk_id").distinct().join(alive, "chunk_id").select("document_id").distinct()
    mine = new_mentions.join(alive.select("chunk_id"), "chunk_id", "left_semi")
    named = new_concepts.join(mine.select("concept_id").distinct(), "concept_id", "left_semi")
    event = told.select(F.sha1(F.concat(F.lit("concepts:"), "document_id")).alias("event_id"), F.lit("CONCEPT_GRAPH_PROJECT").alias("event_type"), F.lit("document").alias("aggregate_type"),
                        F.col("document_id").alias("aggregate_id"), F.lit("{}").alias("payload"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"))
    return {"concepts": upsert_concepts(concepts, named), "mentions": replace_mentions(mentions, mine, alive.join(told, "document_id", "left_semi")), "outbox": replace_pending(outbox, event)}
