"""Writes as algebra: old and new rows give the next snapshot.

Plain Parquet has no MERGE; a write is a function from frames to a frame, and
``foliant.sources.tables.commit`` makes the result the current version of a
table in one step.  All merges are one grouped pass over old and new rows,
marked by side, so they need a single shuffle on the key and combine hot keys
on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)


def snapshot_replace(old: DataFrame, new: DataFrame, docs: DataFrame, now) -> DataFrame:
    """Upsert a document's chunks and retire those it no longer has.

    New chunks enter only if their document is alive, take its course, and
    revive a row deleted before; live chunks of a document in ``new`` that are
    not in it get ``now`` as deletion time; other documents stay as they are.
    """
    living = docs.where("deleted_at IS NULL").select("document_id", F.col("course_id").alias("_course"))
    entering = new.join(living, "document_id").withColumn("course_id", F.col("_course")).withColumn("deleted_at", F.lit(None).cast("timestamp")).drop("_course")
    touched = entering.select("document_id").distinct().withColumn("_touched", F.lit(True))
    cols = old.columns
    order = F.struct(F.col("_new"), *[F.col(c) for c in ("created_at", "sort_order") if c in cols])
    merged = (
        _sides(old, entering.select(*[c for c in cols if c in entering.columns]))
        .groupBy(F.col("chunk_id").alias("_k")).agg(F.max_by(F.struct(*cols, "_new"), order).alias("r")).select("r.*")
    )
    retired = ~F.col("_new") & F.col("deleted_at").isNull() & F.coalesce("_touched", F.lit(False))
    return merged.join(touched, "document_id", "left").withColumn("deleted_at", F.when(retired, now).otherwise(F.col("deleted_at"))).select(*cols)


def soft_delete_chunks(chunks: DataFrame, docs: DataFrame, now) -> DataFrame:
    """Live chunks of deleted documents get ``now``; repeating changes nothing."""
    dead = docs.where("deleted_at IS NOT NULL").select("document_id").distinct().withColumn("_dead", F.lit(True))
    return chunks.join(dead, "document_id", "left").withColumn(
        "deleted_at", F.when(F.col("deleted_at").isNull() & F.coalesce("_dead", F.lit(False)), now).otherwise(F.col("deleted_at"))).select(*chunks.columns)


def upsert_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Greatest confidence, latest source; a confirmed edge stays confirmed."""
    return _sides(old, new).groupBy("chunk_id", "lo_id").agg(
        F.max("confidence").alias("confidence"),
        F.max_by("source", F.struct("_new", F.col("mapped_at"), "source")).alias("source"),
        F.when(F.bool_or(F.coalesce(F.col("provenance") == "confirmed", F.lit(False))), "confirmed").otherwise(F.max_by("provenance", F.struct("_new", F.col("mapped_at"), "provenance"))).alias("provenance"),
    )


def delete_inferred(mappings: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Edges of the given chunks leave unless they are confirmed."""
    confirmed = F.coalesce(F.col("provenance") == "confirmed", F.lit(False))
    gone = chunk_ids.select("chunk_id").distinct()
    return mappings.where(confirmed).unionByName(mappings.where(~confirmed).join(gone, "chunk_id", "left_anti"))


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """New label wins; a language once known is not lost."""
    return _sides(old, new).groupBy("concept_id").agg(
        F.max_by("label", F.struct("_new", "label")).alias("label"),
        F.coalesce(F.max(F.when(F.col("_new"), F.col("language"))), F.max(F.when(~F.col("_new"), F.col("language")))).alias("language"),
        F.max("updated_at").alias("updated_at"),
    )


def replace_mentions(old: DataFrame, new: DataFrame, chunks_of: DataFrame) -> DataFrame:
    """Mentions of the given chunks are replaced by the new ones."""
    kept = old.join(chunks_of.select("chunk_id").distinct(), "chunk_id", "left_anti")
    best = new.groupBy("chunk_id", "concept_id").agg(F.max("confidence").alias("confidence"))
    return kept.select("chunk_id", "concept_id", "confidence").unionByName(best)


def replace_relations(old: DataFrame, new: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Relations of the given chunks are replaced; a repeated relation of a
    chunk is written once.  No chunk: nothing changes."""
    key = ["chunk_id", "source_key", "relation_type", "target_key"]
    kept = old.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    entering = new.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    cols = old.columns
    once = entering.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min(F.struct("relation_id", *[c for c in cols if c != "relation_id"])).alias("r")).select(*(F.col(f"r.{c}") for c in cols))
    return kept.select(*cols).unionByName(once)


def replace_pending(events: DataFrame, new: DataFrame) -> DataFrame:
    """Append events; pending ones of the same type and aggregate give way."""
    key = ["event_type", "aggregate_id"]
    pending = F.col("status") == "PENDING"
    gone = new.select(*key).distinct()
    kept = events.where(~pending | pending.isNull()).unionByName(events.where(pending).join(gone, key, "left_anti"))
    return kept.unionByName(new.withColumns({"status": F.lit("PENDING"), "retry_count": F.lit(0)}).select(*events.columns))


# Event types of the outbox.
EVENT_TYPES = ["HEADING_GRAPH_PROJECT", "CONCEPT_GRAPH_PROJECT", "DOCUMENT_DELETED", "CONTENT_GENERATION_REQUESTED", "LESSON_PUBLISHED"]


def validated_events(events: DataFrame, types: list[str] = EVENT_TYPES) -> DataFrame:
    """Types in their normal form, and why an event is not accepted."""
    kind = F.upper(F.btrim("event_type"))
    why = (
        F.when(kind.isNull() | ~kind.isin(types), "unknown type")
        .when(F.coalesce(F.btrim("aggregate_id"), F.lit("")) == "", "no aggregate")
        .when(F.coalesce(F.col("retry_count"), F.lit(0)) < 0, "negative retries")
    )
    return events.withColumns({"event_type": kind, "error": why})


def current_jobs(jobs: DataFrame) -> DataFrame:
    """Each job once, and only those of their document's latest generation."""
    once = jobs.groupBy("document_id", "generation").agg(F.min("at").alias("first_at"), F.count("*").alias("deliveries"))
    latest = F.max("generation").over(Window.partitionBy("document_id"))
    return once.withColumn("latest", latest).where("generation = latest").drop("latest")
