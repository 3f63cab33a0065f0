"""Queries that run a stream over a directory to its end.

The input is written from the batch tables into the shared folder; the result
is what the stream wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.plans.mutations import _wired
from foliant.session import load, shared_dir
from foliant.sources import markdown
from foliant.streaming import outbox as O


def _run(s, stream, label):
    root = f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"
    q = O.write_batches(stream, f"{root}/out", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


def _written(s, df, label):
    path = f"{shared_dir(s)}/{label}-{uuid.uuid4().hex}"
    df.write.json(path)
    return path


def stream_jobs_once(s, d):
    """Every ingestion delivered twice; each job comes out once."""
    m = load(s, d, "documents_meta").where("document_id IS NOT NULL").select("document_id", F.col("processing_generation").alias("generation"), F.lit("PARSING").alias("stage"), F.to_timestamp(F.lit("2026-01-01")).alias("at"))
    path = _written(s, m.unionByName(m), "jobs")
    return _run(s, O.jobs_once(O.source(s, path, O.JOBS)), "jobs-once").select("job_id")


def stream_event_validation(s, d):
    e = load(s, d, "events").withColumn("event_type", _wired()).select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("aggregate_id"), F.col("props").alias("payload"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"), F.col("ts").alias("at"))
    path = _written(s, e, "events")
    good, _ = O.accepted_and_rejected(O.source(s, path))
    return _run(s, good, "accepted").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_document_status(s, d):
    m = load(s, d, "documents_meta").where("document_id IS NOT NULL").select("document_id", F.col("processing_generation").alias("generation"), F.explode(F.array(*(F.lit(x) for x in O.STAGES[1:]))).alias("stage"), "created_at")
    order = F.create_map(*(y for i, x in enumerate(O.STAGES) for y in (F.lit(x), F.lit(i))))
    jobs = m.select("document_id", "generation", "stage", (F.col("created_at") + F.make_interval(secs=order[F.col("stage")])).alias("at")).distinct()
    path = _written(s, jobs, "stages")
    return _run(s, O.document_status(O.source(s, path, O.JOBS, 1000)), "status").groupBy("document_id").agg(F.max_by("stage", F.struct("generation", "at")).alias("stage"), F.max("generation").alias("generation"))


def markdown_sections(s, d):
    """Document texts read as Markdown."""
    return markdown.sections(load(s, d, "documents"), "doc_id", "text").select("document_id", "ord", "element_type", "heading_level", F.md5("content").alias("content_md5"))


SQL = {
    "stream_jobs_once": "SELECT DISTINCT document_id || '-g' || processing_generation || ':PARSING' AS job_id FROM documents_meta WHERE document_id IS NOT NULL AND processing_generation >= 0",
    "stream_event_validation": """SELECT CASE event_id % 6 WHEN 0 THEN 'HEADING_GRAPH_PROJECT' WHEN 1 THEN 'CONCEPT_GRAPH_PROJECT' WHEN 2 THEN 'DOCUMENT_DELETED' WHEN 3 THEN 'CONTENT_GENERATION_REQUESTED'
ELSE 'LESSON_PUBLISHED' END AS event_type, count(*) AS n FROM events WHERE event_id % 6 < 5 GROUP BY 1""",
    "stream_document_status": "SELECT document_id, 'INDEXED' AS stage, max(processing_generation) AS generation FROM documents_meta WHERE document_id IS NOT NULL GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (stream_jobs_once, stream_event_validation, stream_document_status, markdown_sections)}
