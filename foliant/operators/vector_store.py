"""The vector collection as a versioned table: points with their payload.

A collection has one dimension, fixed when it is made.  Writes are functions
from frames to a frame, committed by ``sources.tables``; deletions and counts
name what they touch exactly.  Null ids are no points; of repeated ids the
last written row counts; an empty collection gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources import tables

POINTS = (
    "chunk_id string, vector array<float>, document_id string, document_name string, doc_type string, course_id string, owner_id string, content string, content_type string, heading_path array<string>, "
    "page_number int, chunk_index int, language string, content_hash string, uploaded_at timestamp"
)


def trimmed(c) -> F.Column:
    """Metadata without blanks at its ends; blank is none."""
    return F.nullif(F.btrim(c), F.lit(""))


def points(chunks: DataFrame, vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Points of chunks that have a vector; names, types, course and owner are
    those of the file."""
    of = files.select("document_id", F.col("title").alias("document_name"), "doc_type", trimmed("course_id").alias("course_id"), trimmed("owner_id").alias("owner_id"), F.col("created_at").alias("uploaded_at"))
    rows = chunks.drop("course_id", "owner_id", "vector", "document_name", "doc_type", "uploaded_at").join(vectors.where("vector IS NOT NULL").select("chunk_id", "vector"), "chunk_id").join(of, "document_id")
    names = [x.strip().split(" ")[0] for x in POINTS.split(", ")]
    missing = {n: F.lit(None) for n in names if n not in rows.columns}
    schema = rows.sparkSession.createDataFrame([], POINTS).schema
    return rows.withColumns(missing).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def bootstrap(spark: SparkSession, root: str, dimension: int, table: str = "points") -> bool:
    """Make the collection if there is none; true if it was made.  A
    collection of another dimension is an error."""
    if table in tables.manifest(spark, root):
        found = tables.read(spark, root, f"{table}_dimension").first()["dimension"]
        if found != dimension:
            raise ValueError(f"the collection has {found} dimensions, not {dimension}")
        return False
    tables.commit(spark, root, {table: spark.createDataFrame([], POINTS), f"{table}_dimension": spark.createDataFrame([(dimension,)], "dimension int")})
    return True


def upserted(old: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """The collection with new points in place of old ones of the same id; a
    vector of another length fails the job."""
    fits = F.assert_true(F.size("vector") == dimension, F.lit(f"vectors must have {dimension} elements"))
    checked = new.where("chunk_id IS NOT NULL").withColumn("vector", F.when(fits.isNull(), F.col("vector")))
    both = old.withColumn("_new", F.lit(0)).unionByName(checked.withColumn("_new", F.lit(1)))
    return both.groupBy(F.col("chunk_id").alias("_k")).agg(F.max_by(F.struct(*old.columns), F.struct("_new", "content_hash")).alias("r")).select("r.*")


def without_documents(stored: DataFrame, documents: DataFrame) -> DataFrame:
    """Points of the given documents leave."""
    return stored.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(*stored.columns)


def stale(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids of points whose document is among those of ``kept`` (document_id,
    chunk_id), while they are not: what an older snapshot left behind."""
    mine = stored.join(kept.select("document_id").distinct(), "document_id", "left_semi")
    return mine.join(kept.select("chunk_id").distinct(), "chunk_id", "left_anti").select("document_id", "chunk_id")


def without_stale(stored: DataFrame, kept: DataFrame) -> DataFrame:
    return stored.join(stale(stored, kept).select("chunk_id"), "chunk_id", "left_anti").select(*stored.columns)


def count(stored: DataFrame, condition=None) -> DataFrame:
    """Exact number of points, of those that meet a condition."""
    return (stored if condition is None else stored.where(condition)).agg(F.count("*").alias("points"))


def empty(spark: SparkSession) -> DataFrame:
    """The store that keeps nothing: reads are empty, what is written is lost."""
    return spark.createDataFrame([], POINTS)
