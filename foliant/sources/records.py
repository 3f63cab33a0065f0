"""JSON-lines sources: labelled questions, page lines, page metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "id string, question string, evidence array<struct<document:string,page:int>>"
PAGE_LINES = (
    "document_id string, page int, width double, height double, ord int, block_index int, text string, size double, bold boolean, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>, margin boolean"
)
PAGE_METRICS = "document_id string, page int, char_count int, line_count int, image_area_ratio double, drawing_count int, multi_column boolean, table_count int"


def read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the schema, and the lines that are none ``(line, file)``; blank
    lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.btrim("value") != "")
    made = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    names = [f.name for f in made.schema["r"].dataType.fields if f.name != "_bad"]
    return made.where(~bad).select(*(F.col(f"r.{n}") for n in names)), made.where(bad).select(F.col("value").alias("line"), "file")
