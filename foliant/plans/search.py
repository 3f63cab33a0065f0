"""Queries of search, matching, mapping and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import vectors as V
from foliant.operators import evaluation as E
from foliant.operators import reads as R
from foliant.operators import retrieval as T
from foliant.plans import curriculum as K
from foliant.plans.store import CHUNKS_SQL, DOCS_SQL, chunks, docs
from foliant.session import load

WITH = f"WITH d AS {DOCS_SQL}, c AS {CHUNKS_SQL}, visible AS (SELECT * FROM d WHERE deleted_at IS NULL AND coalesce(lms_published, true))\n"
#: A fixed query vector of 64 elements.
QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]


#: The model of the fixed query vector; placements are made with it as well.
MODEL = "course-embed-64"


def _usable(s, d):
    """Usable vectors, one of each chunk and model, with their payload."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
    e = load(s, d, "chunk_embeddings").where((F.size("vector") == F.col("dimension")) & finite & F.exists("vector", lambda x: x != 0) & F.col("model").isNotNull())
    e = e.groupBy("chunk_id", "model").agg(F.min("vector").alias("vector"))
    c = chunks(s, d).where(R.alive()).select("chunk_id", "document_id", "course_id", F.lower("language").alias("language"), "content_type", "sort_order")
    return e.join(c, "chunk_id").join(R.hidden_documents(docs(s, d)), "document_id", "left_anti")


def _of_model(s, d):
    return _usable(s, d).where(F.col("model") == MODEL)


def _ranked(df):
    return df.select("chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_topk(s, d):
    return _ranked(T.top_k(_of_model(s, d), QUERY, 10))


def vector_topk_filtered(s, d):
    return _ranked(T.top_k(_of_model(s, d).where(T.payload_filter(language="en", exclude_types=("toc", "table"))), QUERY, 10))


def vector_threshold(s, d):
    return _ranked(T.top_k(_of_model(s, d), QUERY, 50, 0.2))


def _labelled(s, d):
    """The labelled vectors; the queries are those whose id is divisible by 50."""
    rows = load(s, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("vector"), "label")
    return rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector", F.col("label").alias("wanted"))


def rank_for_queries(s, d):
    rows, asked = _labelled(s, d)
    return T.rank_all(rows, asked, 6, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def unit_vectors(s, d):
    return _usable(s, d).select("chunk_id", "model", F.round(V.norm(F.col("vector")), 5).alias("norm"), F.round(V.norm(V.unit(F.col("vector"))), 6).alias("unit_norm"))


def _profiles(s, d):
    """Chapter profiles of each course and model: of a chapter that has
    outcomes, the vector of its smallest chunk id."""
    taught = K.links(s, d).where("course_id = chapter_course").select("course_id", F.col("chapter_code").alias("code")).distinct()
    rows = _usable(s, d).join(docs(s, d).select("document_id", F.col("chapter_code").alias("code")).where("code IS NOT NULL"), "document_id").join(taught, ["course_id", "code"], "left_semi")
    return rows.groupBy("course_id", "model", "code").agg(F.min_by("vector", "chunk_id").alias("vector"))


def _matched(s, d, strict):
    return T.match_chapters(_usable(s, d).withColumnRenamed("chunk_id", "text_id"), _profiles(s, d), strict, ("course_id", "model")).select(
        "text_id", "model", "code", F.round("score", 5).alias("score"), F.round("runner_up", 5).alias("runner_up"), "chapter")


def chapter_match(s, d):
    return _matched(s, d, False)


def chapter_match_strict(s, d):
    return _matched(s, d, True)


def _live(s, d):
    return chunks(s, d).where(R.alive()).where("document_id IS NOT NULL AND heading_path IS NOT NULL")


def section_texts(s, d):
    return T.section_texts(_live(s, d)).select("document_id", "section", "chunks", F.md5("text").alias("text_md5"))


def _files(s, d):
    return docs(s, d).where("course_id IS NOT NULL").select("document_id", F.col("course_id").alias("file_course"), "role", F.col("chapter_code").alias("file_chapter"))


def _placements(s, d):
    """Matches by content: each section of a reference file by itself, and a
    lecture without chapter as a whole; the vector of the first chunk stands
    for the text."""
    profiles = _profiles(s, d).where(F.col("model") == MODEL)
    rows = T.sections_of(_live(s, d)).select("document_id", "section", "idx", "chunk_id").join(_files(s, d), "document_id")
    of = _of_model(s, d)
    sections = rows.where("role = 'reference'")
    strict = T.match_chapters(T.vector_of_first(sections, ["document_id", "section", "file_course"], of).select(F.concat_ws("|", "document_id", "section").alias("text_id"), F.col("file_course").alias("course_id"), "vector"), profiles, True)
    by_section = sections.withColumn("text_id", F.concat_ws("|", "document_id", "section")).join(strict.where("chapter IS NOT NULL"), "text_id").select("chunk_id", "chapter")
    whole = rows.where("coalesce(role, '') <> 'reference' AND file_chapter IS NULL")
    by_file = T.match_chapters(T.vector_of_first(whole, ["document_id", "file_course"], of).select(F.col("document_id").alias("text_id"), F.col("file_course").alias("course_id"), "vector"), profiles)
    return by_section, by_file.where("chapter IS NOT NULL").select(F.col("text_id").alias("document_id"), F.col("chapter").alias("matched"), "score")


def document_chapters(s, d):
    """Chapters found for lectures that name none, as reports to their files."""
    return _placements(s, d)[1].select("document_id", F.col("matched").alias("chapter_code"), F.lit("content").alias("provenance"), F.round("score", 4).alias("confidence"))


def _mapped(s, d, matching):
    lo = load(s, d, "learning_outcomes").where("deleted_at IS NULL AND is_current AND lo_id IS NOT NULL").groupBy("lo_id").agg(F.max("statement_vi").alias("statement"))
    words = lo.select("lo_id", T.content_words(F.col("statement")).alias("outcome_words"))
    taught = K.links(s, d).where("course_id = chapter_course").select("course_id", "chapter_code", "lo_id").distinct()
    c = chunks(s, d).where(R.alive()).drop("course_id").join(_files(s, d), "document_id").select(
        "chunk_id", "document_id", F.col("file_course").alias("course_id"), "heading_path", T.content_words(F.array_join("heading_path", " ")).alias("path_words"), "role", "file_chapter")
    none = s.createDataFrame([], "chunk_id string, chapter string")
    if matching:
        none, whole = _placements(s, d)
        c = c.join(whole, "document_id", "left").withColumn("file_chapter", F.coalesce("file_chapter", "matched"))
    placed = T.place_chunks(c, none, T.chapter_numbers(c, K.chapters(s, d).where(R.alive())), T.title_chapters(c, K.titles(s, d)))
    return T.map_outcomes(placed.select("chunk_id", "course_id", "chapter_code", "path_words", "source"), taught, words)


def lo_mapping(s, d):
    """Outcomes of all chunks of files with a course, placed without a matcher
    (what a backfill does): by the file's chapter, else by the headings."""
    return _mapped(s, d, False)


def lo_mapping_placed(s, d):
    """``lo_mapping`` with placement by content: sections of reference files,
    which are placed by nothing else, and lectures that name no chapter."""
    return _mapped(s, d, True)


def backfill_documents(s, d):
    """Files a backfill would map: live, of a course, with live chunks."""
    n = chunks(s, d).where(R.alive()).groupBy("document_id").agg(F.count("*").alias("chunks"))
    return docs(s, d).where(R.alive()).where("course_id IS NOT NULL").join(n, "document_id").select("course_id", "document_id", "chunks")


def _mappings(s, d):
    return load(s, d, "chunk_lo_mappings").groupBy("chunk_id", "lo_id").agg(F.max("confidence").alias("confidence"))


def outcome_refs(s, d):
    """Outcomes asked for by id, by course and code, and by bare number."""
    lo = load(s, d, "learning_outcomes").where("lo_id IS NOT NULL AND course_id IS NOT NULL AND code IS NOT NULL").select("lo_id", "course_id", "code").distinct()
    forms = F.array(F.concat(F.lit(" "), "lo_id"), F.concat_ws(": ", "course_id", F.lower("code")), F.regexp_replace("code", r"^L\.O\.", ""), F.concat("code", F.lit(".99")))
    refs = lo.select("course_id", F.explode(forms).alias("ref")).distinct()
    return T.resolve_outcomes(refs, lo)


def _semantic(s, d, k=5):
    """Finds of a search for each outcome in its course; the vector of its
    surest chunk stands for the question."""
    best = R.chunks_for_outcomes(_mappings(s, d), chunks(s, d), docs(s, d), 20)
    v = _of_model(s, d).where(T.payload_filter())
    asked = best.join(v.select("chunk_id", "course_id", "vector"), "chunk_id").groupBy(F.col("lo_id").alias("query_id")).agg(F.min_by(F.struct("course_id", "vector"), "rank").alias("q")).select("query_id", "q.course_id", "q.vector")
    return best, T.rank_all(v, asked, min(100, max(5 * k, 20)), within=("course_id",)).withColumnRenamed("query_id", "lo_id")


def quiz_context(s, d):
    """For each outcome its best chunks within the budget of characters: found
    ones first, in the order of the search."""
    best, found = _semantic(s, d)
    rows = T.reranked(best, found).join(chunks(s, d).select("chunk_id", "content"), "chunk_id")
    return T.bounded_context(rows, "lo_id").select("lo_id", "chunk_id", "place", "run")


def quiz_context_unranked(s, d):
    """The same without a search, in the order of the mappings."""
    rows = R.chunks_for_outcomes(_mappings(s, d), chunks(s, d), docs(s, d), 20).join(chunks(s, d).select("chunk_id", "content"), "chunk_id")
    return T.bounded_context(rows, "lo_id").select("lo_id", "chunk_id", "place", "run")


def _evaluated(s, d):
    """Vectors of a query's label are relevant to it, itself left out."""
    rows, asked = _labelled(s, d)
    ranked = T.rank_all(rows, asked, 11, "vec_id").where("vec_id <> query_id").join(rows.select("vec_id", "label"), "vec_id")
    relevant = rows.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("relevant"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("rank", place), asked.select("query_id", "wanted").join(relevant, "wanted")


def retrieval_eval(s, d):
    ranked, of = _evaluated(s, d)
    hits = ranked.join(of, "query_id").where("label = wanted")
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first"))
    found = hits.where("rank <= 6").groupBy("query_id").agg(F.count("*").alias("found"))
    return T.hit_metrics(first, of, found)


def retrieval_paired(s, d):
    """Reciprocal ranks of the exact search against the same finds shuffled."""
    ranked, of = _evaluated(s, d)
    base = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.xxhash64("vec_id"))))

    def rr(r, name):
        return of.join(r, "query_id").groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("label") == F.col("wanted"), 1 / F.col("rank"))), F.lit(0.0)).alias(name))

    return E.paired_bootstrap(rr(base, "base").join(rr(ranked, "other"), "query_id"))


def path_eval(s, d):
    """Do a chunk's heading path and that of the one before agree?"""
    c = chunks(s, d).where("document_id IS NOT NULL")
    w = Window.partitionBy("document_id").orderBy("sort_order", "chunk_id")
    pairs = c.select("document_id", "heading_path", F.lag("heading_path").over(w).alias("before"))
    return pairs.where("before IS NOT NULL").groupBy("document_id").agg(F.count("*").alias("pairs"), F.count_if(T.path_matches(F.col("heading_path"), F.col("before"))).alias("agree"))


def chunk_stats(s, d):
    return T.size_statistics(chunks(s, d))


_E = f"""e0 AS (SELECT chunk_id, model, min(vector) AS vector FROM chunk_embeddings WHERE len(vector) = dimension AND model IS NOT NULL
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
e AS (SELECT e0.chunk_id, e0.model, CAST(e0.vector AS DOUBLE[]) AS vector, c.document_id, c.course_id, lower(c.language) AS language, c.content_type FROM e0 JOIN c ON c.chunk_id = e0.chunk_id
  WHERE c.deleted_at IS NULL AND (c.document_id IS NULL OR c.document_id NOT IN (SELECT document_id FROM d WHERE deleted_at IS NOT NULL OR lms_published IS FALSE))),
q AS (SELECT CAST({QUERY} AS DOUBLE[]) AS qv)"""
_TOP = "SELECT chunk_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank FROM (SELECT chunk_id, list_cosine_similarity(vector, qv) AS s FROM e, q WHERE model = 'course-embed-64' AND {w} ORDER BY s DESC, chunk_id LIMIT {k})"
_ASKED = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings WHERE embedding IS NOT NULL), a AS (SELECT vec_id AS query_id, vector AS qv, label AS wanted FROM v WHERE vec_id % 50 = 0),
r0 AS (SELECT query_id, wanted, vec_id, label, list_cosine_similarity(vector, qv) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(vector, qv) DESC, vec_id) AS rank FROM v, a)"""
_PROFILES = """p AS (SELECT e.course_id, e.model, d.chapter_code AS code, first(e.vector ORDER BY e.chunk_id) AS pv FROM e JOIN d ON d.document_id = e.document_id
  WHERE (e.course_id, d.chapter_code) IN (SELECT course_id, chapter_code FROM lk WHERE course_id = chapter_course) GROUP BY 1, 2, 3)"""
_BEST = """r{x} AS (SELECT *, row_number() OVER (PARTITION BY text_id, course_id, model ORDER BY score DESC, code DESC) AS rn FROM
  (SELECT t.text_id, t.course_id, t.model, code, list_cosine_similarity(t.vector, pv) AS score FROM {t} t JOIN p ON p.course_id = t.course_id AND p.model = t.model)),
b{x} AS (SELECT text_id, course_id, model, max(CASE WHEN rn = 1 THEN code END) AS code, max(CASE WHEN rn = 1 THEN score END) AS score, coalesce(max(CASE WHEN rn = 2 THEN score END), 0.0) AS runner_up FROM r{x} GROUP BY 1, 2, 3),
m{x} AS (SELECT *, CASE WHEN score >= {a} AND score - runner_up >= {b} THEN code END AS chapter FROM b{x})"""
_MATCH = "t AS (SELECT chunk_id AS text_id, * FROM e), {best} SELECT text_id, model, code, round(score, 5) AS score, round(runner_up, 5) AS runner_up, chapter FROM mx"
_OC = """m AS (SELECT chunk_id, lo_id, max(confidence) AS confidence FROM chunk_lo_mappings WHERE lo_id IS NOT NULL GROUP BY 1, 2),
oc AS (SELECT m.lo_id, m.chunk_id, c.content, row_number() OVER (PARTITION BY m.lo_id ORDER BY coalesce(v.role = 'reference', false), m.confidence DESC NULLS LAST, c.sort_order NULLS LAST, m.chunk_id) AS rank
FROM m JOIN c ON c.chunk_id = m.chunk_id JOIN visible v ON v.document_id = c.document_id WHERE c.deleted_at IS NULL)"""
_SECTIONS = """s0 AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sort_order NULLS FIRST, chunk_id) - 1 AS idx, count(DISTINCT heading_path[1]) OVER (PARTITION BY document_id) AS roots, max(len(heading_path)) OVER (PARTITION BY document_id) AS depth
  FROM c WHERE deleted_at IS NULL AND document_id IS NOT NULL AND heading_path IS NOT NULL), s1 AS (SELECT *, CASE WHEN roots <= 1 AND depth > 1 THEN 2 ELSE 1 END AS lvl FROM s0),
sx AS (SELECT *, CASE WHEN len(heading_path) >= lvl THEN 'h:' || heading_path[lvl] ELSE 'w:' || (idx // 8) END AS section FROM s1)"""
_EVAL = f"""{_ASKED}, r AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r0 WHERE rank <= 11 AND vec_id <> query_id),
rel AS (SELECT label AS wanted, count(*) - 1 AS relevant FROM v GROUP BY 1), o AS (SELECT query_id, a.wanted, relevant FROM a JOIN rel ON rel.wanted = a.wanted),
h AS (SELECT o.query_id, o.relevant, min(CASE WHEN r.label = o.wanted THEN rank END) AS first, count(CASE WHEN r.label = o.wanted AND rank <= 6 THEN 1 END) AS found FROM o LEFT JOIN r ON r.query_id = o.query_id GROUP BY 1, 2)"""
SQL = {
    "vector_topk": WITH + f", {_E} " + _TOP.format(w="true", k=10),
    "vector_topk_filtered": WITH + f", {_E} " + _TOP.format(w="language = 'en' AND coalesce(content_type NOT IN ('toc', 'table'), true)", k=10),
    "vector_threshold": WITH + f", {_E} " + _TOP.format(w="list_cosine_similarity(vector, qv) >= 0.2", k=50),
    "rank_for_queries": f"WITH {_ASKED} SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r0 WHERE rank <= 6",
    "unit_vectors": WITH + f", {_E} SELECT chunk_id, model, round(sqrt(list_dot_product(vector, vector)), 5) AS norm, round(1.0, 6) AS unit_norm FROM e",
    "chapter_match": WITH + f", {_E}, {K.CHAPTERS_SQL}, {_PROFILES}, " + _MATCH.format(best=_BEST.format(x="x", t="t", a=0.65, b=0.05)),
    "chapter_match_strict": WITH + f", {_E}, {K.CHAPTERS_SQL}, {_PROFILES}, " + _MATCH.format(best=_BEST.format(x="x", t="t", a=0.70, b=0.08)),
    "section_texts": WITH + f""", {_SECTIONS}, hd AS (SELECT document_id, section, trim(h) AS h, min(idx * 1000 + i) AS p FROM (SELECT document_id, section, idx, unnest(heading_path) AS h, generate_subscripts(heading_path, 1) AS i FROM sx) GROUP BY 1, 2, 3 HAVING trim(h) <> ''),
hn AS (SELECT *, row_number() OVER (PARTITION BY document_id, section ORDER BY p) AS n FROM hd), bn AS (SELECT document_id, section, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS h, row_number() OVER (PARTITION BY document_id, section ORDER BY idx) AS n FROM sx),
ln AS (SELECT document_id, section, 0 AS what, n, h FROM hn WHERE n <= 40 UNION ALL SELECT document_id, section, 1, n, h FROM bn WHERE n <= 3 AND h <> ''),
tx AS (SELECT document_id, section, substring(string_agg(h, chr(10) ORDER BY what, n), 1, 2500) AS text FROM ln GROUP BY 1, 2)
SELECT s.document_id, s.section, count(*) AS chunks, md5(coalesce(any_value(text), '')) AS text_md5 FROM sx s LEFT JOIN tx ON tx.document_id = s.document_id AND tx.section = s.section GROUP BY 1, 2""",
    "quiz_context": WITH + f""", {_OC}, {_E}, v AS (SELECT * FROM e WHERE model = 'course-embed-64' AND coalesce(content_type <> 'toc', true)),
a AS (SELECT lo_id, first(course_id ORDER BY rank) AS course_id, first(vector ORDER BY rank) AS qv FROM (SELECT oc.lo_id, oc.rank, v.course_id, v.vector FROM oc JOIN v ON v.chunk_id = oc.chunk_id WHERE rank <= 20) GROUP BY 1),
sr AS (SELECT a.lo_id, v.chunk_id, row_number() OVER (PARTITION BY a.lo_id ORDER BY list_cosine_similarity(v.vector, qv) DESC, v.chunk_id) AS sem FROM a JOIN v ON v.course_id = a.course_id),
rr AS (SELECT oc.lo_id, oc.chunk_id, oc.content, row_number() OVER (PARTITION BY oc.lo_id ORDER BY sem IS NULL, coalesce(sem, rank), rank) AS rank FROM oc LEFT JOIN (SELECT * FROM sr WHERE sem <= 25) sr ON sr.lo_id = oc.lo_id AND sr.chunk_id = oc.chunk_id WHERE rank <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY lo_id ORDER BY rank) AS place, sum(least(length(content), 2600)) OVER (PARTITION BY lo_id ORDER BY rank) AS run FROM rr WHERE length(trim(content)) > 0)
SELECT lo_id, chunk_id, place, run FROM k WHERE (place = 1 OR run <= 8000) AND place <= 5""",
    "quiz_context_unranked": WITH + f""", {_OC}, k AS (SELECT *, row_number() OVER (PARTITION BY lo_id ORDER BY rank) AS place, sum(least(length(content), 2600)) OVER (PARTITION BY lo_id ORDER BY rank) AS run
FROM oc WHERE rank <= 20 AND length(trim(content)) > 0) SELECT lo_id, chunk_id, place, run FROM k WHERE (place = 1 OR run <= 8000) AND place <= 5""",
    "outcome_refs": """WITH lo AS (SELECT DISTINCT lo_id, course_id, code FROM learning_outcomes WHERE lo_id IS NOT NULL AND course_id IS NOT NULL AND code IS NOT NULL), k AS (SELECT course_id, code, min(lo_id) AS lo_id FROM lo GROUP BY 1, 2)
SELECT DISTINCT ref, course_id, lo_id FROM (SELECT ' ' || lo_id AS ref, course_id, lo_id FROM lo UNION ALL SELECT course_id || ': ' || lower(code), course_id, lo_id FROM k UNION ALL SELECT regexp_replace(code, '^L\\.O\\.', ''), course_id, lo_id FROM k
UNION ALL SELECT code || '.99', course_id, NULL FROM k)""",
    "backfill_documents": WITH + "SELECT d.course_id, d.document_id, count(*) AS chunks FROM d JOIN c ON c.document_id = d.document_id WHERE d.deleted_at IS NULL AND d.course_id IS NOT NULL AND c.deleted_at IS NULL GROUP BY 1, 2",
    "retrieval_eval": f"""WITH {_EVAL} SELECT count(*) AS questions, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 3) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 3) AS hit_3,
round(avg(CASE WHEN first <= 6 THEN 1.0 ELSE 0 END), 3) AS hit_6, round(avg(coalesce(found * 1.0 / nullif(relevant, 0), 0)), 3) AS recall_6, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 3) AS mrr_10 FROM h""",
    "path_eval": WITH + """, p AS (SELECT document_id, heading_path AS h, lag(heading_path) OVER (PARTITION BY document_id ORDER BY sort_order NULLS FIRST, chunk_id) AS b FROM c WHERE document_id IS NOT NULL)
SELECT document_id, count(*) AS pairs, count(*) FILTER (h[1:greatest(least(len(h), len(b)), 1)] = b[1:greatest(least(len(h), len(b)), 1)]) AS agree FROM p WHERE b IS NOT NULL GROUP BY 1""",
    "chunk_stats": WITH + """SELECT content_type, count(*) AS chunks, CAST(quantile_disc(length(content), 0.5) AS INT) AS p50, CAST(quantile_disc(length(content), 0.95) AS INT) AS p95, max(length(content)) AS longest,
count(*) FILTER (length(content) < 200) AS small, count(*) FILTER (length(content) > 1500) AS large, count(*) FILTER (page_end > page_start) AS multi_page FROM c GROUP BY 1""",
}
# Placement of chunks: by section match, file, number or title, as the operator's docstring states it.
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'), lambda x: length(x) > 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_FILES = "fi AS (SELECT document_id, course_id AS file_course, role, chapter_code FROM d WHERE course_id IS NOT NULL)"
_HINTS = f"""{_SECTIONS}, sf AS (SELECT sx.document_id, section, idx, chunk_id, file_course, role, chapter_code FROM sx JOIN fi ON fi.document_id = sx.document_id),
ev AS (SELECT * FROM e WHERE model = 'course-embed-64'),
ts AS (SELECT document_id || '|' || section AS text_id, file_course AS course_id, any_value(model) AS model, first(vector ORDER BY idx, sf.chunk_id) AS vector FROM sf JOIN (SELECT chunk_id, model, vector FROM ev) v ON v.chunk_id = sf.chunk_id WHERE role = 'reference' GROUP BY 1, 2),
td AS (SELECT document_id AS text_id, file_course AS course_id, any_value(model) AS model, first(vector ORDER BY idx, sf.chunk_id) AS vector FROM sf JOIN (SELECT chunk_id, model, vector FROM ev) v ON v.chunk_id = sf.chunk_id WHERE coalesce(role, '') <> 'reference' AND chapter_code IS NULL GROUP BY 1, 2),
{_BEST.format(x="s", t="ts", a=0.70, b=0.08)}, {_BEST.format(x="d", t="td", a=0.65, b=0.05)},
hs AS (SELECT sf.chunk_id, ms.chapter FROM sf JOIN ms ON ms.text_id = sf.document_id || '|' || sf.section WHERE sf.role = 'reference' AND ms.chapter IS NOT NULL),
hd AS (SELECT text_id AS document_id, chapter, score FROM md WHERE chapter IS NOT NULL)"""
_NO_HINTS = "hs AS (SELECT '' AS chunk_id, '' AS chapter WHERE false), hd AS (SELECT '' AS document_id, '' AS chapter WHERE false)"
_MAPPED = rf"""{K.TITLES_SQL.replace("FROM c JOIN ti ON ti.course_id = c.course_id", "FROM c JOIN fi ON fi.document_id = c.document_id JOIN ti ON ti.course_id = fi.file_course")},
lw AS (SELECT lo_id, {_WORDS.format("max(statement_vi)")} AS ow FROM learning_outcomes WHERE deleted_at IS NULL AND is_current AND lo_id IS NOT NULL GROUP BY 1),
b AS (SELECT c.chunk_id, fi.file_course AS course_id, c.heading_path, fi.role, coalesce(fi.chapter_code, hd.chapter) AS file FROM c JOIN fi ON fi.document_id = c.document_id LEFT JOIN hd ON hd.document_id = c.document_id WHERE c.deleted_at IS NULL),
f AS (SELECT chunk_id, course_id, regexp_extract_all(array_to_string(heading_path, ' '), '{K.NUMBER_SQL}', 1) AS ns FROM b),
nu AS (SELECT f.chunk_id, first(ch.code ORDER BY i) AS number FROM (SELECT chunk_id, course_id, unnest(ns) AS code, generate_subscripts(ns, 1) AS i FROM f) f JOIN ch ON ch.live AND ch.course_id = f.course_id AND ch.code = f.code GROUP BY 1),
pl AS (SELECT b.chunk_id, b.course_id, CASE WHEN hs.chapter IS NOT NULL THEN hs.chapter WHEN role = 'reference' THEN NULL ELSE coalesce(file, number, tt.chapter_code) END AS chapter_code,
  CASE WHEN hs.chapter IS NOT NULL THEN 'section' WHEN file IS NOT NULL THEN 'document' ELSE 'chapter' END AS source, {_WORDS.format("array_to_string(heading_path, ' ')")} AS pw
  FROM b LEFT JOIN hs ON hs.chunk_id = b.chunk_id LEFT JOIN nu ON nu.chunk_id = b.chunk_id LEFT JOIN tt ON tt.chunk_id = b.chunk_id),
x AS (SELECT pl.chunk_id, lw.lo_id, source, coalesce(len(list_distinct(list_intersect(pw, ow))) >= 2, false) AS shared FROM pl JOIN (SELECT DISTINCT course_id, chapter_code, lo_id FROM lk WHERE course_id = chapter_course) l
  ON l.course_id = pl.course_id AND l.chapter_code = pl.chapter_code JOIN lw ON lw.lo_id = l.lo_id)
SELECT chunk_id, lo_id, CASE WHEN bool_or(shared) THEN 0.7 ELSE 0.5 END AS confidence, CASE WHEN bool_or(shared) THEN max(source) || '+heading' ELSE max(source) END AS source FROM x GROUP BY 1, 2"""
SQL["lo_mapping"] = WITH + f", {K.CHAPTERS_SQL}, {_FILES}, {_NO_HINTS}, {_MAPPED}"
SQL["lo_mapping_placed"] = WITH + f", {_E}, {K.CHAPTERS_SQL}, {_PROFILES}, {_FILES}, {_HINTS}, {_MAPPED}"
SQL["document_chapters"] = WITH + f", {_E}, {K.CHAPTERS_SQL}, {_PROFILES}, {_FILES}, {_HINTS} SELECT document_id, chapter AS chapter_code, 'content' AS provenance, round(score, 4) AS confidence FROM hd"
QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_filtered, vector_threshold, rank_for_queries, unit_vectors, chapter_match, chapter_match_strict, section_texts, document_chapters, lo_mapping, lo_mapping_placed,
    backfill_documents, outcome_refs, quiz_context, quiz_context_unranked,
    retrieval_eval, retrieval_paired, path_eval, chunk_stats)}
