"""Queries of the chunkers; not expressible in SQL, held to invariants by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import chunking as K
from foliant.operators.ordered import heading_paths
from foliant.operators.structural import StructuralConfig
from foliant.session import load

_SHOWN = ["chunk_id", "document_id", "chunk_index", "content_hash", "page_number", "part_index", "part_count", "content_type", "token_count"]


def _by(method: str):
    def query(s, d):
        return K.chunk(load(s, d, "sections"), method).select(*_SHOWN)

    return query


def structural_chunks(s, d):
    files = load(s, d, "documents_meta").select("document_id", "title", F.contains(F.lower(F.coalesce("mime_type", F.lit("pdf"))), F.lit("pdf")).alias("pdf"))
    return K.structural_chunks(load(s, d, "sections"), documents=files).select(*_SHOWN)


def slide_chunks_by_page(s, d):
    """Slides that are never put together over pages."""
    slides = load(s, d, "sections").where("element_type = 'slide'")
    return K.structural_chunks(slides, StructuralConfig(split_pages=True)).where("page_start = page_end OR page_start IS NULL").select(*_SHOWN)


def contents_flags(s, d):
    return K.contents_flags(K._once(load(s, d, "sections"))).select("document_id", "ord", "toc")


def section_paths(s, d):
    """Heading path of each section by the headings before it."""
    once = load(s, d, "sections").where("document_id IS NOT NULL AND ord IS NOT NULL").groupBy("document_id", "ord").agg(F.max("heading").alias("heading"), F.max("heading_level").alias("heading_level"))
    return heading_paths(once, levels=3).select("document_id", "ord", F.array_join("path", " > ").alias("path"))


def repaired_paragraphs(s, d):
    """Lines joined to paragraphs, words cut at line ends put together."""
    sec = load(s, d, "sections").where("content IS NOT NULL").select("document_id", "ord", "content").distinct()
    return sec.select("document_id", "ord", F.md5(text.dehyphenate(F.col("content"))).alias("text_md5"), text.word_count(F.col("content")).alias("words"))


def sentence_counts(s, d):
    sec = load(s, d, "sections").where("content IS NOT NULL").select("document_id", "ord", "content").distinct()
    return sec.select("document_id", "ord", F.size(text.sentences("content")).alias("sentences"))


def concept_keys(s, d):
    m = load(s, d, "documents_meta").where("title IS NOT NULL").select("title").distinct()
    return m.groupBy(text.concept_key(F.col("title")).alias("concept")).agg(F.count("*").alias("titles"))


_H = lambda n: f"last_value(CASE WHEN heading_level = {n} THEN heading END IGNORE NULLS) OVER w AS h{n}, last_value(CASE WHEN heading_level = {n} AND heading IS NOT NULL THEN ord END IGNORE NULLS) OVER w AS a{n}"
# A word closes a sentence if it ends with a mark, is no abbreviation, dotted number or ellipsis, and the next letter or digit is a capital or digit.
_ABBREVIATIONS = ", ".join(f"'{a}'" for a in sorted(text.ABBREVIATIONS))
_SENTENCES = rf"""w AS (SELECT document_id, ord, list_filter(regexp_split_to_array(content, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '') AS ws
  FROM (SELECT DISTINCT document_id, ord, content FROM sections WHERE content IS NOT NULL)),
k AS (SELECT row_number() OVER () AS row, * FROM w), t AS (SELECT row, document_id, ord, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM k),
f AS (SELECT *, regexp_extract(word, '[\p{{L}}\p{{N}}]') AS c, regexp_extract(word, '^(.*)[.!?…]["'')\]»]*$', 1) AS core, regexp_matches(word, '[.!?…]["'')\]»]*$') AS marked FROM t),
g AS (SELECT *, first_value(CASE WHEN c <> '' THEN c END IGNORE NULLS) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM f)"""
_TOC_NAMES = "(?i)^(?:mục lục|table of contents|contents|danh mục hình|danh mục bảng|list of figures|list of tables)\\s*[:.]?$"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
SQL = {
    "contents_flags": f"""WITH s AS (SELECT document_id, ord, max(content) AS content, max(heading) AS heading, max(is_toc) AS is_toc FROM sections WHERE document_id IS NOT NULL AND ord IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, list_filter(regexp_split_to_array(coalesce(content, ''), '\\r\\n|[\\n\\r]'), lambda v: trim(v) <> '') AS ls, row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS idx, count(*) OVER (PARTITION BY document_id) AS n FROM s),
y AS (SELECT *, coalesce(len(list_filter(ls, lambda v: regexp_matches(v, '\\.{{3,}}\\s*\\d+\\s*$'))) * 1.0 / nullif(len(ls), 0), 0) >= 0.4 OR coalesce(len(list_filter(ls, lambda v: regexp_matches(v, '(?:\\t| {{2,}})\\d+\\s*$'))) * 1.0 / nullif(len(ls), 0), 0) >= 0.5 AS e,
  coalesce(length(content) <= 60 AND regexp_matches(trim(content, {_BLANKS}), '{_TOC_NAMES}'), false) AS nc, coalesce(length(heading) <= 60 AND regexp_matches(trim(heading, {_BLANKS}), '{_TOC_NAMES}'), false) AS nh FROM x),
z AS (SELECT *, coalesce(is_toc, false) OR nc OR (e AND (idx < greatest(1.0, n * 0.2) OR nh)) AS b FROM y), r AS (SELECT *, sum(CASE WHEN b OR e THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ord) AS run FROM z)
SELECT document_id, ord, (b OR e) AND max(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, run ORDER BY ord) = 1 AS toc FROM r""",
    "sentence_counts": rf"""WITH {_SENTENCES}, n AS (SELECT row, count(*) FILTER (marked AND right(core, 1) <> '.' AND lower(core) NOT IN ({_ABBREVIATIONS}) AND NOT regexp_matches(core, '\b\d+(?:\.\d+)+$')
  AND (regexp_matches(ahead, '^\p{{N}}$') OR ahead <> lower(ahead) AND ahead = upper(ahead))) + 1 AS n FROM g GROUP BY 1)
SELECT document_id, ord, coalesce(n, 0) AS sentences FROM k LEFT JOIN n ON n.row = k.row""",
    "repaired_paragraphs": r"""SELECT document_id, ord, md5(trim(regexp_replace(regexp_replace(content, '(\p{Ll})-\r?\n(\p{Ll})', '\1\2', 'g'), '\s+', ' ', 'g'))) AS text_md5,
len(regexp_extract_all(content, '[\p{L}\p{N}\p{M}_]+')) AS words FROM (SELECT DISTINCT document_id, ord, content FROM sections WHERE content IS NOT NULL)""",
    "concept_keys": """SELECT substring(trim(regexp_replace(regexp_replace(replace(replace(strip_accents(lower(title)), 'đ', 'd'), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 120) AS concept, count(*) AS titles
FROM (SELECT DISTINCT title FROM documents_meta WHERE title IS NOT NULL) GROUP BY 1""",
    "section_paths": f"""WITH s AS (SELECT document_id, ord, max(heading) AS heading, max(heading_level) AS heading_level FROM sections WHERE document_id IS NOT NULL AND ord IS NOT NULL GROUP BY 1, 2),
x AS (SELECT document_id, ord, {_H(1)}, {_H(2)}, {_H(3)} FROM s WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT document_id, ord, concat_ws(' > ', h1, CASE WHEN a1 IS NULL OR a1 <= a2 THEN h2 END, CASE WHEN (a1 IS NULL OR a1 <= a3) AND (a2 IS NULL OR a2 <= a3) THEN h3 END) AS path FROM x""",
}
QUERIES = {
    "heading_chunks": _by("heading"), "structural_chunks": structural_chunks, "slide_chunks_by_page": slide_chunks_by_page, "contents_flags": contents_flags, "token_chunks": _by("token"), "sentence_chunks": _by("sentence"), "semantic_chunks": _by("semantic"),
    "section_paths": section_paths, "repaired_paragraphs": repaired_paragraphs, "sentence_counts": sentence_counts, "concept_keys": concept_keys,
}
