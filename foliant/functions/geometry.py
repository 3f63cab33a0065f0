"""Boxes on pages: unions, covered shares, column gutters.

A box is ``struct<x0:double,y0:double,x1:double,y1:double>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions tried for a gutter, over the middle of the page.
POSITIONS, LEFT, RIGHT = 33, 0.3, 0.7


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def union_box(b: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def clipped_share(b: Column, width: Column, height: Column) -> Column:
    """Share of the page that the part of a box on it covers."""
    w = F.greatest(F.lit(0.0), F.least(b["x1"], width) - F.greatest(b["x0"], F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least(b["y1"], height) - F.greatest(b["y0"], F.lit(0.0)))
    area = width * height
    return F.when(area > 0, w * h / area).otherwise(0.0)


def column_gutters(lines: DataFrame, least: int = 3, overlap: float = 0.5) -> DataFrame:
    """``(document_id, page, multi_column)``: is there an upright strip in the
    middle of the page that no line crosses, with lines on both sides that
    stand beside each other?"""
    at = F.col("width") * (LEFT + (RIGHT - LEFT) * F.col("i") / (POSITIONS - 1))
    tried = lines.select("document_id", "page", "width", "bbox", F.explode(F.sequence(F.lit(0), F.lit(POSITIONS - 1))).alias("i")).withColumn("at", at)
    left, right = F.col("bbox.x1") <= F.col("at"), F.col("bbox.x0") >= F.col("at")
    edge = lambda side, fn, c: fn(F.when(side, F.col(f"bbox.{c}")))
    per = tried.groupBy("document_id", "page", "i").agg(
        F.count_if(~left & ~right).alias("crossing"), F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"),
        edge(left, F.min, "y0").alias("lt"), edge(left, F.max, "y1").alias("lb"), edge(right, F.min, "y0").alias("rt"), edge(right, F.max, "y1").alias("rb"))
    shared = F.greatest(F.lit(0.0), F.least("lb", "rb") - F.greatest("lt", "rt"))
    shorter = F.least(F.col("lb") - F.col("lt"), F.col("rb") - F.col("rt"))
    ok = (F.col("crossing") == 0) & (F.col("n_left") >= least) & (F.col("n_right") >= least) & (shorter > 0) & (shared / F.when(shorter > 0, shorter) >= overlap)
    return per.groupBy("document_id", "page").agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("multi_column"))
