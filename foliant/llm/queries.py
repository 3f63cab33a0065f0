"""Queries of the llm problems and, where SQL can state a result, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import abuse, encoding, languages, near_duplicates, packing, scans, similar_vectors, splitting
from foliant.session import load, materialize


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members, near = similar_vectors.nearest(load(spark, d, "chunk_embeddings"), least=similar_vectors.LEAST)
    return similar_vectors.pairs(similar_vectors.neighbours(members, near))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    members, near = similar_vectors.nearest(load(spark, d, "chunk_embeddings"))
    return similar_vectors.neighbours(members, near)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.traces(scans.decisions(load(spark, d, "sections"), load(spark, d, "documents_meta")))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    sections = load(spark, d, "sections")
    return scans.repaired(sections, scans.decisions(sections, load(spark, d, "documents_meta")))


_models: dict[tuple, object] = {}


def _fitted(spark: SparkSession, fit: Callable[..., object], *tables: DataFrame) -> object:
    """A model fitted once for the files of its tables; later queries of the
    application take it from here.  Files are known by name, size and time."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for f in sorted(x for t in tables for x in t.inputFiles()):
        path = fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, fit.__module__, tuple(files))
    if key not in _models:
        _models[key] = fit(*tables)
    return _models[key]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    documents, metas, chunks, sections = (load(spark, d, t) for t in ("documents", "documents_meta", "chunks", "sections"))
    return languages.label_rows(documents, metas, chunks, sections, _fitted(spark, languages.fit, documents))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(_labelled(spark, d))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    documents, chunks, sections = (load(spark, d, t) for t in ("documents", "chunks", "sections"))
    return languages.segment_rows(documents, chunks, sections, _fitted(spark, languages.fit, documents))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(load(spark, d, "chunks"), words=3, threshold=0.5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs_of_records(*_near(spark, d), "chunk_id")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*_near(spark, d), "chunk_id")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(load(spark, d, "sections"), ["document_id", "ord"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_pieces(spark, d), ["document_id", "ord"])


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("n_pieces > 1").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(load(spark, d, "documents"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_spans(load(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    counts = materialize(encoding.token_counts(load(spark, d, "documents")), "token-counts")
    return packing.pack(counts, "doc_id", "n_tokens")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _scored(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    documents = load(spark, d, "documents")
    return abuse.score(documents, _fitted(spark, abuse.fit, documents, load(spark, d, "review_labels")), list(keys))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "doc_id").where("score >= 0.5").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d, "source"))


QUERIES = {
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_labels": p4_labels,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p7_spans": p7_spans,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
#: Results that SQL can state; p8_fill by its sums, which no packing changes.
SQL = {"p6_found": "SELECT DISTINCT document_id, ord FROM sections WHERE length(content) > 1500"}
