"""Incremental ingestion: outbox events and document jobs as streams.

Delivery is at least once.  Jobs are deduplicated by their id inside a
watermark, results of an older generation are left out against the current
documents, and every batch is written with its id, so a batch that runs again
after a failure changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions.ids import job_id
from foliant.operators.writes import EVENT_TYPES, validated_events

EVENTS = "event_id string, event_type string, aggregate_id string, payload string, status string, retry_count int, at timestamp"
JOBS = "document_id string, generation int, stage string, at timestamp"
# Stages of a document, in order.
STAGES = ["PENDING", "PARSING", "CHUNKING", "EMBEDDING", "INDEXED"]


def source(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def jobs_once(jobs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each job once; repeats later than ``delay`` may come again."""
    named = jobs.withColumn("job_id", F.concat_ws(":", job_id(F.col("document_id"), F.col("generation")), "stage")).where("document_id IS NOT NULL AND generation >= 0")
    return named.withWatermark("at", delay).dropDuplicatesWithinWatermark(["job_id"])


def current_only(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Results whose generation is not behind that of their document."""
    now = documents.groupBy("document_id").agg(F.max("processing_generation").alias("_now"))
    return results.join(now, "document_id", "left").where(F.col("generation") >= F.coalesce("_now", F.lit(0))).drop("_now")


def accepted_and_rejected(events: DataFrame, types: list[str] = EVENT_TYPES) -> tuple[DataFrame, DataFrame]:
    checked = validated_events(events, types)
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    generation, stage = state.get if state.exists else (-1, -1)
    out = []
    rows = sorted((r for b in batches for r in zip(b["generation"], b["stage"], b["at"])), key=lambda r: (r[0], r[2]))
    for g, s, at in rows:
        if g < generation or s not in STAGES and s != "ERROR":
            continue
        if g > generation:
            generation, stage = int(g), -1
        n = len(STAGES) if s == "ERROR" else STAGES.index(s)
        if n > stage and stage < len(STAGES) - 1:
            stage = n
            out.append((key[0], generation, s, at))
    state.update((generation, stage))
    if out:
        yield pd.DataFrame(out, columns=["document_id", "generation", "stage", "at"])


def document_status(jobs: DataFrame) -> DataFrame:
    """Accepted changes of stage: forward only, within the latest generation."""
    return jobs.groupBy("document_id").applyInPandasWithState(_advance, "document_id string, generation int, stage string, at timestamp", "generation int, stage int", "append", GroupStateTimeout.NoTimeout)


def write_batches(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Write each batch to a directory of its number, then run ``then``: a
    repeated batch overwrites itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if then:
            then(df, batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
