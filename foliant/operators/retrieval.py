"""Exact vector search, matching, mapping and evaluation of retrieval."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import vectors as V
from foliant.functions.text import outcome_code, unmarked


def payload_filter(
    doc_types: list[str] | None = None, document_ids: list[str] | None = None, language: str | None = None, course_id: str | None = None, owner_id: str | None = None,
    exclude_types: tuple[str, ...] = ("toc",), exclude_documents: list[str] | None = None, uploaded_after: datetime | None = None, uploaded_before: datetime | None = None, heading_contains: str | None = None,
) -> Column:
    """Conjunction of the given conditions; unknown values are not excluded,
    but do not meet a condition either.  Contents are left out unless
    ``exclude_types`` says otherwise, also where no condition is given."""
    c = F.lit(True)
    for name, given in (("doc_type", doc_types), ("document_id", document_ids)):
        if given:
            c = c & F.col(name).isin(given)
    for name, given in (("language", language), ("course_id", course_id), ("owner_id", owner_id)):
        if given is not None:
            c = c & (F.col(name) == given)
    for name, given in (("content_type", exclude_types), ("document_id", exclude_documents)):
        if given:
            c = c & ~F.coalesce(F.col(name).isin(list(given)), F.lit(False))
    if uploaded_after is not None:
        c = c & (F.col("uploaded_at") >= F.lit(uploaded_after))
    if uploaded_before is not None:
        c = c & (F.col("uploaded_at") < F.lit(uploaded_before))
    if heading_contains is not None:
        c = c & F.exists("heading_path", lambda h: F.contains(F.lower(h), F.lit(heading_contains.lower())))
    return c


def has_conditions(**given) -> bool:
    """Is any condition given?"""
    return any(v not in (None, [], ()) for v in given.values())


def search(points: DataFrame, hidden: DataFrame, query: list[float], k: int = 10, threshold: float = 0.0, **conditions) -> DataFrame:
    """The k visible points most similar to the query that meet the
    conditions.  Hidden documents leave before ranking, so k are found if
    there are k; if the look-up of hidden ones fails, so does the search."""
    if not 1 <= k <= 100 or not 0 <= threshold <= 1:
        raise ValueError("k must be 1 to 100 and threshold 0 to 1")
    seen = points.join(hidden.select("document_id").distinct(), "document_id", "left_anti").where(payload_filter(**conditions))
    return top_k(seen, query, k, threshold)


def top_k(rows: DataFrame, query: list[float], k: int = 10, threshold: float = 0.0, key: str = "chunk_id") -> DataFrame:
    """The k rows most similar to one vector, ranked; exact, one pass."""
    scored = rows.withColumn("score", V.cosine(F.col("vector"), F.lit([float(x) for x in query])))
    if threshold > 0:
        scored = scored.where(F.col("score") >= threshold)
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def rank_all(
    rows: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", within: tuple[str, ...] = (), most_broadcast: int = 10_000, block: int = 2_000,
) -> DataFrame:
    """The k best rows for each query, among those that agree in the columns
    ``within``; ranking is cut on the map side.

    Up to ``most_broadcast`` queries are broadcast.  More are cut into blocks
    of about ``block``; every row meets every block in a task of the two's."""
    asked = queries.select("query_id", *(F.col(c).alias(f"_{c}") for c in within), F.col("vector").alias("_q"))
    met = F.size("vector") == F.size("_q")
    for c in within:
        met = met & (F.col(c) == F.col(f"_{c}"))
    n = queries.count()
    if n <= most_broadcast:
        pairs = rows.join(F.broadcast(asked), met)
    else:
        blocks = math.ceil(n / block)
        placed = asked.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        spread = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = spread.join(placed, (spread["_b"] == placed["_b"]) & met)
    scored = pairs.select("query_id", key, V.cosine(F.col("vector"), F.col("_q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def resolve_outcomes(refs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome of each reference ``(ref, course_id)``: its id, ``course:code``,
    a code in any letter case, or the bare number of one.  The three readings
    are three joins on equal keys; of several outcomes the smallest id."""
    lo = outcomes.where("lo_id IS NOT NULL").select("lo_id", F.col("course_id").alias("_course"), F.col("code").alias("_code")).distinct()
    by_id = refs.join(lo.select("lo_id").distinct(), F.btrim("ref") == F.col("lo_id")).select("ref", "course_id", "lo_id", F.lit(0).alias("how"))
    named = F.when(F.contains("ref", F.lit(":")), F.btrim(F.split_part("ref", F.lit(":"), F.lit(1)))).otherwise(F.col("course_id"))
    coded = refs.select("ref", "course_id", named.alias("_course"), outcome_code(F.col("ref")).alias("_code")).join(lo, ["_course", "_code"]).select("ref", "course_id", "lo_id", F.lit(1).alias("how"))
    best = by_id.unionByName(coded).groupBy("ref", "course_id").agg(F.min(F.struct("how", "lo_id")).alias("m"))
    return refs.join(best, ["ref", "course_id"], "left").select("ref", "course_id", F.col("m.lo_id").alias("lo_id"))


def reranked(ranked: DataFrame, found: DataFrame, group: str = "lo_id", key: str = "chunk_id") -> DataFrame:
    """Ranked rows of each group in a new order: those that a search found, in
    the order of its finds, then the others in the old one.  Without finds the
    order stays."""
    sem = found.select(group, key, F.col("rank").alias("_sem"))
    order = Window.partitionBy(group).orderBy(F.col("_sem").isNull(), F.coalesce("_sem", "rank"), "rank")
    return ranked.join(sem, [group, key], "left").withColumn("rank", F.row_number().over(order)).drop("_sem")


def match_chapters(texts: DataFrame, profiles: DataFrame, strict: bool = False, within: tuple[str, ...] = ("course_id",)) -> DataFrame:
    """Best chapter of each text, accepted only if similar and clear enough.

    A text meets the profiles of its course (and of what else ``within``
    names) only; the join is on these columns, and Spark's size check decides
    how.  Without a second profile the runner-up is 0; of equals the greater
    code wins."""
    score, margin = (0.70, 0.08) if strict else (0.65, 0.05)
    met = texts.select("text_id", *within, F.col("vector").alias("_t")).join(profiles.select(*within, "code", F.col("vector").alias("_p")), list(within)).where(F.size("_t") == F.size("_p"))
    scored = met.select("text_id", *within, "code", V.cosine(F.col("_t"), F.col("_p")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("text_id", *within).orderBy(F.desc("score"), F.desc("code")))
    top = scored.withColumn("rank", rank).where("rank <= 2").groupBy("text_id", *within).agg(
        F.max(F.when(F.col("rank") == 1, F.col("code"))).alias("code"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"))
    ok = (F.col("score") >= score) & (F.col("score") - F.col("runner_up") >= margin)
    return top.withColumn("chapter", F.when(ok, F.col("code")))


# Words before the number of a chapter.
CHAPTER_WORDS = ["chương", "chuong", "chapter", "bài", "bai", "lecture", "tuần", "tuan", "buổi", "buoi", "unit"]
_NUMBER = rf"(?iu)(?:{'|'.join(CHAPTER_WORDS)})\s*[.:\-]?\s*0*(\d+)"


def chapter_numbers(paths: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapter of each chunk from numbers in its headings: the first number,
    in order of the path, that exists in its course."""
    found = paths.select("chunk_id", "course_id", F.posexplode(F.regexp_extract_all(F.array_join("heading_path", " "), F.lit(_NUMBER), 1)).alias("pos", "code"))
    hits = found.join(chapters.select("course_id", "code").distinct(), ["course_id", "code"])
    return hits.groupBy("chunk_id").agg(F.min_by("code", "pos").alias("chapter_code"))


def _chapter_order(code: Column) -> Column:
    """Chapters in order of their number, others by code."""
    return F.struct(F.coalesce(code.try_cast("int"), F.lit((1 << 31) - 1)), code)


def title_chapters(chunks: DataFrame, titles: DataFrame, least: int = 8) -> DataFrame:
    """Chapter whose title (``least`` characters or more) is contained in a
    chunk's heading path, marks and letter case aside; the longest title wins,
    of equals the first chapter.

    A title can only be contained where its first ``least`` characters are:
    distinct paths are cut into windows of that length and meet titles of the
    course on an equal window, so no title is compared with every path and
    none is lost."""
    keyed = titles.select("course_id", "code", unmarked("title").alias("title_key")).where(F.length("title_key") >= least).distinct().withColumn("window", F.substring("title_key", 1, least))
    path = F.array_join("heading_path", " ")
    paths = chunks.where("heading_path IS NOT NULL").select("course_id", path.alias("path")).distinct().withColumn("path_key", unmarked("path"))
    places = F.sequence(F.lit(1), F.length("path_key") - least + 1)
    windows = paths.where(F.length("path_key") >= least).select("course_id", "path", "path_key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("path_key", i, F.lit(least))))).alias("window"))
    hit = windows.join(keyed, ["course_id", "window"]).where(F.contains("path_key", F.col("title_key")))
    best = hit.groupBy("course_id", "path").agg(F.min_by("code", F.struct(-F.length("title_key"), _chapter_order(F.col("code")))).alias("chapter_code"))
    return chunks.where("heading_path IS NOT NULL").select("chunk_id", "course_id", path.alias("path")).join(best, ["course_id", "path"]).select("chunk_id", "chapter_code")


# Words that say nothing about an outcome.
STOP_WORDS = ["được", "các", "một", "của", "và", "cho", "trong", "với", "những", "này", "có", "để", "là", "về", "theo", "từ", "khi", "như", "hay", "phần", "mềm"]


def content_words(text: Column) -> Column:
    """Distinct words of more than three characters, stop words left out."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS)))


def place_chunks(chunks: DataFrame, sections: DataFrame, numbers: DataFrame, titles: DataFrame) -> DataFrame:
    """Chapter of each chunk ``(chunk_id, course_id, role, file_chapter, ...)``
    and where it comes from: the match of its section; nothing else for
    reference files, which number chapters their own way; the file's chapter;
    a chapter number in its headings, or else a title."""
    joined = (
        chunks.join(sections.select("chunk_id", F.col("chapter").alias("_section")), "chunk_id", "left")
        .join(numbers.select("chunk_id", F.col("chapter_code").alias("_number")), "chunk_id", "left").join(titles.select("chunk_id", F.col("chapter_code").alias("_title")), "chunk_id", "left"))
    reference = F.coalesce(F.col("role") == "reference", F.lit(False))
    code = F.when(F.col("_section").isNotNull(), F.col("_section")).when(reference, None).otherwise(F.coalesce("file_chapter", "_number", "_title"))
    source = F.when(F.col("_section").isNotNull(), "section").when(F.col("file_chapter").isNotNull(), "document").otherwise("chapter")
    return joined.withColumns({"chapter_code": code, "source": source}).where("chapter_code IS NOT NULL").drop("_section", "_number", "_title")


def map_outcomes(placed: DataFrame, chapter_outcomes: DataFrame, outcomes: DataFrame, least_words: int = 2) -> DataFrame:
    """Chunk to outcome through its chapter; surer if its headings share words
    with the outcome's statement."""
    linked = placed.join(chapter_outcomes, ["course_id", "chapter_code"]).join(outcomes, "lo_id")
    shared = F.coalesce(F.size(F.array_intersect("path_words", "outcome_words")) >= least_words, F.lit(False))
    rows = linked.select("chunk_id", "lo_id", F.when(shared, 0.7).otherwise(0.5).alias("confidence"), F.when(shared, F.concat("source", F.lit("+heading"))).otherwise(F.col("source")).alias("source"))
    return rows.groupBy("chunk_id", "lo_id").agg(F.max(F.struct("confidence", "source")).alias("m")).select("chunk_id", "lo_id", "m.confidence", "m.source")


def bounded_context(ranked: DataFrame, group: str, top_k_: int = 5, per_chunk: int = 2600, total: int = 8000) -> DataFrame:
    """The longest prefix of each group's ranked chunks within a budget of
    characters; the first chunk always stays."""
    by = Window.partitionBy(group).orderBy("rank")
    n = F.least(F.length("content"), F.lit(per_chunk))
    kept = ranked.where(F.length(F.btrim("content")) > 0).withColumns({"place": F.row_number().over(by), "run": F.sum(n).over(by)})
    return kept.where(((F.col("place") == 1) | (F.col("run") <= total)) & (F.col("place") <= top_k_)).withColumn("content", F.substring("content", 1, per_chunk))


def hit_metrics(first_hits: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """hit@1, hit@3, hit@6, recall@6 and MRR@10 over all questions."""
    at = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 3).alias(f"hit_{k}")
    rows = questions.join(first_hits, "query_id", "left").join(hits, "query_id", "left")
    return rows.agg(
        F.count("*").alias("questions"), at(1), at(3), at(6),
        F.round(F.avg(F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0))), 3).alias("recall_6"),
        F.round(F.avg(F.coalesce(F.when(F.col("first") <= 10, 1 / F.col("first")), F.lit(0.0))), 3).alias("mrr_10"))


def path_matches(path: Column, expected: Column) -> Column:
    """Does either path begin with the other?"""
    n = F.least(F.size(path), F.size(expected))
    return F.coalesce(F.slice(path, F.lit(1), F.greatest(n, F.lit(1))) == F.slice(expected, F.lit(1), F.greatest(n, F.lit(1))), F.lit(False))


def size_statistics(chunks: DataFrame, small: int = 200, large: int = 1500) -> DataFrame:
    """Counts and nearest-rank percentiles of chunk sizes by type."""
    n = F.length("content")
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length(content))").cast("int")
    return chunks.groupBy("content_type").agg(
        F.count("*").alias("chunks"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max(n).alias("longest"), F.count_if(n < small).alias("small"), F.count_if(n > large).alias("large"),
        F.count_if(F.col("page_end") > F.col("page_start")).alias("multi_page"))


def sections_of(chunks: DataFrame, window: int = 8) -> DataFrame:
    """``idx`` and ``section`` of each chunk: below a heading of the first
    level, or of the second where a document has a single first one; chunks
    that have no heading of that level form runs of ``window``."""
    doc = Window.partitionBy("document_id")
    root = F.when(F.size("heading_path") > 0, F.element_at("heading_path", 1))
    roots, depth = F.min(root).over(doc).eqNullSafe(F.max(root).over(doc)), F.max(F.size("heading_path")).over(doc)
    placed = chunks.withColumns({"idx": F.row_number().over(doc.orderBy("sort_order", "chunk_id")) - 1, "level": F.when(roots & (depth > 1), 2).otherwise(1)})
    label = F.when(F.size("heading_path") >= F.col("level"), F.concat(F.lit("h:"), F.try_element_at("heading_path", F.col("level").cast("int")))).otherwise(
        F.concat(F.lit("w:"), F.floor(F.col("idx") / window).cast("string")))
    return placed.withColumn("section", label).drop("level")


def section_texts(chunks: DataFrame, headings: int = 40, first: int = 3, longest: int = 2500, window: int = 8) -> DataFrame:
    """Representative text of each section of a document: its first distinct
    headings and the contents of its first chunks.  Only the headings and
    contents that count are collected, however long a section is."""
    rows = sections_of(chunks, window)
    part = ["document_id", "section"]
    heads = rows.select(*part, "idx", F.posexplode("heading_path")).select(*part, F.struct("idx", "pos").alias("at"), F.btrim("col").alias("h")).where("h <> ''").groupBy(*part, "h").agg(F.min("at").alias("at"))
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("at"))).where(F.col("n") <= headings)
    bodies = rows.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("idx"))).where(F.col("n") <= first)
    lines = heads.select(*part, F.lit(0).alias("what"), "n", F.col("h").alias("text")).unionByName(
        bodies.select(*part, F.lit(1).alias("what"), "n", F.btrim("content", F.lit(" \t\r\n")).alias("text")).where("text <> ''"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("what", "n", "text"))), lambda x: x["text"]), "\n")
    made = lines.groupBy(*part).agg(F.substring(text, 1, longest).alias("text"))
    return rows.groupBy(*part).agg(F.count("*").alias("chunks")).join(made, part, "left").withColumn("text", F.coalesce("text", F.lit("")))


def vector_of_first(rows: DataFrame, part: list[str], vectors: DataFrame) -> DataFrame:
    """The vector of the first chunk of each part that has one."""
    return rows.select(*part, "idx", "chunk_id").join(vectors.select("chunk_id", "vector"), "chunk_id").groupBy(*part).agg(F.min_by("vector", F.struct("idx", "chunk_id")).alias("vector"))
