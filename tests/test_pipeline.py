from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import chunking as K
from foliant.operators import evaluation as E
from foliant.operators import ingest as I
from foliant.operators import pages as P
from foliant.operators import tools as T
from foliant.operators import vector_store as V
from foliant.sources import tables

T0 = datetime(2024, 1, 1)
FILES = "document_id string, course_id string, owner_id string, title string, mime_type string, file_path string, created_at timestamp, processing_generation int, language string, deleted_at timestamp"
SECTIONS = "document_id string, ord int, content string, element_type string, heading string, heading_level int, page_number int, is_toc boolean"


def test_runs_are_committed_whole_and_repeat(spark, tmp_path):
    root = str(tmp_path / "t")
    files = spark.createDataFrame([("a", "k", " o ", "A", "application/pdf", "a", T0, 1, "en", None), ("b", "k", None, "B", "video/mp4", "b.mp4", T0, 1, "fr", None), ("c", "k", None, "C", None, "c.md", T0, 1, None, None),
                                   ("old", "k", None, "O", None, "o.md", T0, 1, "vi", None), ("x", "k", None, "X", None, "x.md", T0, 1, "vi", T0)], FILES)
    rows = [(d, i, f"Text {i} of {d}. " * 9 + (" !" if i == 0 else ""), "paragraph", f"H{i}", 1, 1, False) for d in ("a", "b", "old", "x") for i in range(3)] + [("c", 0, " ", "paragraph", None, None, 1, False)]
    sections = spark.createDataFrame(rows, SECTIONS)
    newer = spark.createDataFrame([("old", 2), ("a", 1)], "document_id string, processing_generation int")
    steps = [(lambda c: F.replace(c, F.lit(" "), F.lit(" ")), F.contains("content", F.lit(" "))), (lambda c: F.lit(None).cast("string"), F.lit(True))]
    now = F.to_timestamp(F.lit("2024-02-01"))
    assert I.ingest(spark, root, files, sections, K.heading_chunks, now, 16, steps=steps, generations=newer) == 2
    got = {r.document_id: (r.status, r.error, r.chunks) for r in tables.read(spark, root, "statuses").collect()}
    assert got == {"a": ("INDEXED", None, 3), "b": ("ERROR", "unsupported type: video/mp4", 0), "c": ("ERROR", "no text", 0)}
    points = tables.read(spark, root, "points")
    assert {(r.document_id, r.owner_id, r.doc_type, len(r.vector)) for r in points.collect()} == {("a", "o", "pdf", 16)}
    assert not tables.read(spark, root, "chunks").where(F.contains("content", F.lit(" "))).count()
    first = sorted(r.chunk_id for r in points.collect())
    I.ingest(spark, root, files, sections.where("ord < 2"), K.heading_chunks, now, 16, steps=steps, generations=newer)
    again = tables.read(spark, root, "chunks")
    live = sorted(r.chunk_id for r in again.where("deleted_at IS NULL").collect())
    assert live == sorted(r.chunk_id for r in tables.read(spark, root, "points").collect()) and set(live) < set(first) and again.count() == 3
    assert [(r.aggregate_id, r.status) for r in tables.read(spark, root, "outbox").collect()] == [("a", "PENDING")]
    with pytest.raises(ValueError):
        V.bootstrap(spark, root, 32)
    with pytest.raises(Exception, match="16 elements"):
        V.upserted(points, points.withColumn("vector", F.slice("vector", 1, 3)), 16).collect()
    assert V.empty(spark).count() == 0 and V.count(V.empty(spark)).collect()[0].points == 0


def test_evidence_is_found_by_page(spark):
    ranked = spark.createDataFrame([("q", 1, "d", 1, 3, 1), ("q", 2, "d", 4, 4, 4), ("q", 7, "d", 9, 9, 9), ("r", 1, "e", 1, 1, 1), ("r", 2, "d", None, None, 5)], "query_id string, rank int, document_id string, page_start int, page_end int, page_number int")
    evidence = spark.createDataFrame([("q", "d", 3), ("q", "d", 4), ("q", "d", 9), ("r", "d", 5), ("s", "d", 1), ("s", "d", 1)], "query_id string, document_id string, page int")
    m = E.evidence_metrics(ranked, evidence).collect()[0]
    assert (m.questions, m.hit_1, m.hit_3, m.hit_6, m.recall_6, m.mrr_10, m.strict_6) == (3, 0.333, 0.667, 0.667, 0.556, 0.5, 0.667)
    paths = spark.createDataFrame([("q", "d", ["A", "B"], 1), ("q", "d", ["A"], 2), ("r", "d", [], 3)], "query_id string, document_id string, heading_path array<string>, rank int")
    want = spark.createDataFrame([("q", "d", ["A", "C"]), ("r", "d", ["A"])], "query_id string, document_id string, path array<string>")
    p = E.path_metrics(paths, want).collect()[0]
    assert (p.questions, p.recall_5, p.mrr_10) == (2, 0.5, 0.25)


def test_resampling_in_blocks_is_resampling(spark):
    rows = [(f"q{i}", float(i % 5 == 0), float(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, base double, other double")
    one, many = (E.paired_bootstrap(df, 800, block=b).collect()[0] for b in (1000, 40))
    d = sum(o - b for _, b, o in rows) / 300
    assert abs(one.difference - d) < 1e-12 and (one.won, one.lost) == (many.won, many.lost) == (80, 40)
    assert abs(one.low - many.low) < 0.02 and abs(one.high - many.high) < 0.02 and one.low < d < one.high
    assert many == E.paired_bootstrap(df.repartition(5), 800, block=40).collect()[0]
    exact = 2 * sum(__import__("math").comb(120, i) for i in range(41)) / 2**120
    assert abs(one.mcnemar_p - exact) < 1e-9 and E.paired_bootstrap(df.limit(0), 50).collect()[0].mcnemar_p == 1.0


def test_lines_images_and_ranges(spark):
    box = lambda y0, y1: (0.0, y0, 9.0, y1)
    spans = spark.createDataFrame([("d", 1, 100.0, 0, 0, "Big ", 20.0, 16, box(10.0, 20.0)), ("d", 1, 100.0, 0, 1, "b", 9.0, 2, box(10.0, 20.0)), ("d", 1, 100.0, 1, 0, "7", 9.0, 0, box(94.0, 99.0)), ("d", 1, 100.0, 2, 0, " ", 9.0, 0, box(1.0, 2.0))],
                                  "document_id string, page int, height double, ord int, span int, text string, size double, flags int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [(r.text, r.size, r.bold, r.italic, r.margin) for r in P.lines_of(spans).orderBy("ord").collect()] == [("Big b", 20.0, True, False, False), ("7", 9.0, False, False, True)]
    images = spark.createDataFrame([("d", 1, 0, 60), ("d", 1, 1, 50), ("d", 2, 0, 1), ("e", 1, 0, None)], "document_id string, page int, nth int, bytes int")
    assert {(r.document_id, r.page, r.nth) for r in P.images_within(images, 100).collect()} == {("d", 1, 0), ("e", 1, 0)}
    sec = spark.createDataFrame([("d", 0, None, "a"), ("d", 0, 9, "b"), ("d", 0, 4, " "), ("d", 0, 4, "c")], "document_id string, range_no int, page_number int, content string")
    inside, outside = P.placed_in_range(sec, spark.createDataFrame([("d", 0, 3, 5)], "document_id string, range_no int, first int, last int"))
    assert {(r.content, r.page_number) for r in inside.collect()} == {("a", 3), ("c", 4)} and [r.content for r in outside.collect()] == ["b"]


def test_tools_clamp_what_they_are_asked(spark):
    assert [T.clamped(v, 1, 3, 1) for v in (None, -5, 2, 99)] == [1, 1, 2, 3]
    long = T.shown(spark.createDataFrame([("x" * 1801,), ("y",), (None,)], "content string")).collect()
    assert [(len(r.content or ""), r.truncated) for r in long] == [(1800, True), (1, False), (0, None)]
