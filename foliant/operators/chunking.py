"""Chunkers: sections in document order to chunks for retrieval.

A file is cut where a chunker's state begins anew, and what crosses such a
border is decided on summaries, so results do not depend on how files are cut:

* heading: *stretches* of sections below one heading are packed by themselves;
  which short chunks join their neighbours follows from runs of lengths and
  paths (``_pairs``), without the texts;
* structural: parts below different top-level headings are never merged, so
  each is a group (see ``structural``); numbers and ids are given afterwards;
* token and sentence windows: one stretch at a time;
* semantic: distances within a stretch and to the next one, the percentile of
  a file over its distances.

A file has at most the bytes its source allows, and groups are parts of one.
Ids are name-based, so a rerun gives the same ids.  Null and blank contents
give no chunk; rows without document or place are none; repeated rows count
once; an empty table gives no chunks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.batches import map_groups
from foliant.functions.ids import chunk_uuid
from foliant.functions.text import nfc, split_sentences
from foliant.operators import structural as S
from foliant.operators.ordered import heading_paths
from foliant.operators.pages import toc_scores, toc_sections

#: The tokenizer by which structural, token and sentence chunks are measured.
TOKENIZER = os.environ.get("FOLIANT_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
VERSION = "2"


@dataclass(frozen=True)
class HeadingConfig:
    most: int = 1500
    least: int = 100
    overlap: int = 200

    def __post_init__(self):
        if not 0 <= self.overlap < self.most or self.least > self.most:
            raise ValueError("need least <= most and overlap < most")


# Fixed value: where sentences end for packing by characters.
_ENDS = re.compile(r"(?<=[.!?])\s+|(?<=\n)\n")


def pack_sentences(text: str, most: int, overlap: int) -> list[str]:
    """Sentences gathered up to ``most`` characters; the next piece begins
    with the last ``overlap`` characters, without a blank.  A longer sentence
    stays whole, and a text that fits is not touched."""
    if len(text) <= most:
        return [text]
    parts = _ENDS.split(text)
    # a piece is what is carried into it and a range of sentences
    pieces, carried, first, size = [], "", 0, 0
    for i, part in enumerate(parts):
        if size and size + len(part) > most:
            whole = carried + " ".join(parts[first:i])
            pieces.append(whole.strip())
            carried, first = whole[len(whole) - overlap :] if overlap else "", i
            size = min(overlap, len(whole)) + len(part)
        elif size:
            size += 1 + len(part)
        else:
            first, size = i, len(part)
    last = (carried + " ".join(parts[first:])).strip()
    return [p for p in (*pieces, last) if p] or [text]


def gathered(rows: list[dict], cfg: HeadingConfig) -> list[tuple[str, int | None]]:
    """Pieces of one stretch with their page: sections gathered until they
    exceed ``most``, then packed."""
    out: list[tuple[str, int | None]] = []
    now: list[dict] = []
    size = 0

    def flush() -> None:
        page = next((r["page_number"] for r in now if r["page_number"] is not None), None)
        out.extend((p, page) for p in pack_sentences("\n\n".join(r["content"] for r in now), cfg.most, cfg.overlap))

    for r in rows:
        if not (r["content"] or "").strip():
            continue
        size += len(r["content"]) + (2 if now else 0)
        now.append(r)
        if size > cfg.most:
            flush()
            now, size = [], 0
    if now:
        flush()
    return out


def windowed(rows: list[dict], counter: S.Counter, size: int, overlap: int, by: str) -> list[tuple[str, int | None]]:
    """Windows of ``size`` tokens over the text of one stretch: exact token
    windows, or whole sentences as far as they fit."""
    text = "\n\n".join(r["content"].strip() for r in rows if (r["content"] or "").strip())
    page = next((r["page_number"] for r in rows if r["page_number"] is not None and (r["content"] or "").strip()), None)
    if not text:
        return []
    if by == "token":
        spans = counter.tokenizer.encode(text, add_special_tokens=False).offsets
        starts = range(0, max(1, len(spans) - overlap), size - overlap)
        return [(p, page) for p in (text[spans[a][0] : spans[min(a + size, len(spans)) - 1][1]] for a in starts) if p.strip()]
    sents = split_sentences(text)
    counts = [counter.count(s) + 1 for s in sents]
    out, first = [], 0
    while first < len(sents):
        end, total = first + 1, counts[first]
        while end < len(sents) and total + counts[end] <= size:
            total += counts[end]
            end += 1
        out.append((" ".join(sents[first:end]), page))
        if end == len(sents):
            break
        back, begin = 0, end
        while begin - 1 > first and back + counts[begin - 1] <= min(overlap, size - counts[end]):
            begin -= 1
            back += counts[begin]
        first = begin
    return out


def _once(sections: DataFrame) -> DataFrame:
    columns = [c for c in ("content", "element_type", "heading", "heading_level", "page_number", "is_toc", "images", "blocks") if c in sections.columns]
    return sections.where("document_id IS NOT NULL AND ord IS NOT NULL").groupBy("document_id", "ord").agg(*(F.max(c).alias(c) for c in columns))


def _doc() -> Window:
    return Window.partitionBy("document_id").orderBy("ord")


def _slides(sections: DataFrame) -> Column:
    return F.bool_and(F.coalesce(F.col("element_type") == "slide", F.lit(False))).over(Window.partitionBy("document_id"))


def contents_flags(sections: DataFrame) -> DataFrame:
    """``toc``: sections of a table of contents, for the structural chunker.

    A section begins one if it is marked, if its whole text or its heading
    names contents or lists of figures or tables, or if most of its lines are
    entries and it stands in the first fifth; entries go on with one."""
    names = r"(?iu)^(?:mục lục|table of contents|contents|danh mục hình|danh mục bảng|list of figures|list of tables)\s*[:.]?$"
    lines = F.filter(F.split(F.coalesce("content", F.lit("")), r"\r\n|[\n\r]"), lambda x: F.btrim(x) != "")
    share = lambda pattern: F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(pattern))) / F.nullif(F.size(lines), F.lit(0)), F.lit(0.0))
    entries = (share(r"\.{3,}\s*\d+\s*$") >= 0.4) | (share(r"(?:\t| {2,})\d+\s*$") >= 0.5)
    named = lambda c: F.coalesce((F.length(c) <= 60) & F.btrim(c, F.lit(" \t\r\n")).rlike(names), F.lit(False))
    idx, n = F.row_number().over(_doc()) - 1, F.count("*").over(Window.partitionBy("document_id"))
    early = idx < F.greatest(F.lit(1.0), n * 0.2)
    begins = F.coalesce("is_toc", F.lit(False)) | named(F.col("content")) | (entries & (early | named(F.col("heading"))))
    marked = sections.withColumns({"_b": begins, "_e": entries})
    run = F.sum((~F.col("_b") & ~F.col("_e")).cast("int")).over(_doc())
    started = F.max(F.col("_b").cast("int")).over(Window.partitionBy("document_id", "_r").orderBy("ord"))
    return marked.withColumn("_r", run).withColumn("toc", (started == 1) & (F.col("_b") | F.col("_e"))).drop("_b", "_e", "_r")


def stretches(sections: DataFrame, detect: bool = True) -> DataFrame:
    """Sections with ``path``, ``kind`` (text, toc, slide) and the number of
    their stretch: consecutive ones of one path and kind; slides alone."""
    once = _once(sections)
    if detect:
        found = toc_sections(toc_scores(once.select("document_id", "ord", "content", "heading"))).select("document_id", "ord", F.lit(True).alias("_toc"))
        once = once.join(found, ["document_id", "ord"], "left").withColumn("is_toc", F.coalesce("is_toc", F.lit(False)) | F.coalesce("_toc", F.lit(False))).drop("_toc")
    decked = once.withColumn("slides", _slides(once))
    kind = F.when(F.col("slides"), "slide").when(F.coalesce("is_toc", F.lit(False)), "toc").otherwise("text")
    placed = heading_paths(decked).withColumn("kind", kind)
    # a slide's heading is its own, else the last one's, else its number
    titled = F.coalesce(F.nullif(F.col("heading"), F.lit("")), F.last(F.nullif(F.col("heading"), F.lit("")), ignorenulls=True).over(_doc().rowsBetween(Window.unboundedPreceding, -1)),
                        F.concat(F.lit("Slide "), F.row_number().over(_doc()).cast("string")))
    placed = placed.withColumn("path", F.when(F.col("kind") == "slide", F.array(titled)).when(F.col("kind") == "toc", F.array().cast("array<string>")).otherwise(F.col("path")))
    new = (F.col("kind") == "slide") | ~F.col("kind").eqNullSafe(F.lag("kind").over(_doc())) | ~F.col("path").eqNullSafe(F.lag("path").over(_doc()))
    return placed.withColumn("stretch", F.sum(new.cast("int")).over(_doc()))


def _pieces(placed: DataFrame, cut: Callable[[list[dict]], list[tuple[str, int | None]]]) -> DataFrame:
    """``(document_id, stretch, piece, content, page_number, path, kind)``."""
    def step(rows: list[dict]) -> list[tuple]:
        head = rows[0]
        return [(head["document_id"], head["stretch"], i, t, page, head["path"], head["kind"]) for i, (t, page) in enumerate(cut(rows))]

    schema = "document_id string, stretch bigint, piece int, content string, page_number int, path array<string>, kind string"
    return map_groups(placed.select("document_id", "stretch", "ord", "content", "page_number", "path", "kind"), ["document_id", "stretch"], ["ord"], schema, step)


def _pairs(pieces: DataFrame, cfg: HeadingConfig) -> DataFrame:
    """Short pieces joined to the next one below the same parent, once: of a
    run of pieces that could join their next, the first, third, ... do.
    Slides and contents stay alone."""
    order = Window.partitionBy("document_id").orderBy("stretch", "piece")
    n, after = F.length("content"), lambda c: F.lead(c).over(order)
    parent = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    can = (F.col("kind") == "text") & (after("kind") == "text") & (n < cfg.least) & (parent(F.col("path")) == parent(after("path"))) & (n + after(n) <= cfg.most)
    # one order serves all: how long the run before is, which pieces are taken in, numbers of what is left
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = pieces.withColumns({"can": F.coalesce(can, F.lit(False)), "row": F.row_number().over(order)})
    place = F.col("row") - F.coalesce(F.max(F.when(~F.col("can"), F.col("row"))).over(so_far), F.lit(0))
    joins = marked.withColumn("joins", F.col("can") & (place % 2 == 1)).withColumn("second", F.coalesce(F.lag("joins").over(order), F.lit(False)))
    parts = joins.withColumn("nth", F.sum((~F.col("second")).cast("int")).over(so_far) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "content"))), lambda x: x["content"]), "\n\n")
    first = F.min_by(F.struct("page_number", "path", "kind"), "row")
    return parts.groupBy("document_id", "nth").agg(text.alias("content"), first.alias("f")).select("document_id", "nth", "content", "f.*")


def _emitted(chunks: DataFrame, method: str) -> DataFrame:
    """Rows ``(document_id, nth, content, page_number, path, kind)`` as chunks;
    the heading path goes before the text for embedding."""
    crumb = F.array_join("path", " > ")
    of = Window.partitionBy("document_id", "path", "kind")
    return chunks.select(
        chunk_uuid(F.col("document_id"), F.lit(f"{method}-{VERSION}"), F.col("nth"), F.col("path"), F.col("content")).alias("chunk_id"), "document_id", F.col("nth").cast("int").alias("chunk_index"), "content",
        F.when(crumb == "", F.col("content")).otherwise(F.concat(crumb, F.lit("\n\n"), "content")).alias("embedding_input"), F.md5("content").alias("content_hash"), "path", "page_number",
        F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), (F.row_number().over(of.orderBy("nth")) - 1).alias("part_index"), F.count("*").over(of).cast("int").alias("part_count"),
        F.col("kind").alias("content_type"), F.lit(None).cast("int").alias("token_count"))


def heading_chunks(sections: DataFrame, cfg: HeadingConfig = HeadingConfig()) -> DataFrame:
    """Sections below one heading together, split when long, short ones joined
    to the next; one chunk or more a slide; contents apart."""
    return _emitted(_pairs(_pieces(stretches(sections), lambda rows: gathered(rows, cfg)), cfg), "heading")


def window_chunks(sections: DataFrame, by: str = "token", size: int = 375, overlap: int = 50, tokenizer: str = TOKENIZER) -> DataFrame:
    """Windows of tokens or of whole sentences below each heading."""
    pieces = _pieces(stretches(sections, detect=False), lambda rows: windowed(rows, _counter(tokenizer), size, overlap, by))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("stretch", "piece")) - 1
    return _emitted(pieces.withColumn("nth", nth), by)


_counters: dict[str, S.Counter] = {}


def _counter(path: str) -> S.Counter:
    """The counter of a tokenizer, once a Python worker."""
    if path not in _counters:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _counters[path] = S.Counter(path)
    return _counters[path]


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """A stand-in where no embedding model is configured: signed counts of
    hashed words, of length one."""
    import hashlib

    v = [0.0] * dim
    for w in re.findall(r"\w+|[^\w\s]", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / n for x in v]


def semantic_chunks(sections: DataFrame, embed: Callable[[str], list[float]] = hash_embedding, percentile: float = 0.95) -> DataFrame:
    """Sentences of a file cut where the distance to the next is above the
    percentile of the file's distances; headings play no part."""
    @F.pandas_udf("array<double>")
    def vectors(s: pd.Series) -> pd.Series:
        return s.map(embed)

    from foliant.functions.text import sentences
    from foliant.functions.vectors import dot

    once = _once(sections).where(F.length(F.btrim("content")) > 0)
    each = once.select("document_id", "ord", "page_number", F.posexplode(sentences("content")).alias("pos", "sentence")).withColumn("v", vectors("sentence"))
    order = Window.partitionBy("document_id").orderBy("ord", "pos")
    far = each.withColumn("far", 1 - dot(F.col("v"), F.lead("v").over(order))).drop("v")
    limit = far.where("far IS NOT NULL").groupBy("document_id").agg(F.percentile("far", percentile).alias("limit"))
    cut = F.coalesce(F.lag("far").over(order) > F.col("limit"), F.lit(False))
    numbered = far.join(limit, "document_id", "left").withColumn("nth", F.sum(cut.cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "sentence"))), lambda x: x["sentence"]), " ")
    page = F.min_by("page_number", F.when(F.col("page_number").isNotNull(), F.struct("ord", "pos")))
    made = numbered.groupBy("document_id", "nth").agg(text.alias("content"), page.alias("page_number"))
    return _emitted(made.select("document_id", "nth", "content", "page_number", F.array().cast("array<string>").alias("path"), F.lit("text").alias("kind")), "semantic")


_MADE = (
    "document_id string, top bigint, nth int, content string, embedding_input string, common array<string>, path array<string>, page_number int, page_start int, page_end int, "
    "content_type string, token_count int, images array<string>"
)


def structural_chunks(sections: DataFrame, cfg: S.StructuralConfig = S.StructuralConfig(), tokenizer: str = TOKENIZER, documents: DataFrame | None = None) -> DataFrame:
    """Chunks by structure; ``documents (document_id, title, pdf)`` gives the
    titles of decks and which files are PDFs (all, if it is not given)."""
    flagged = contents_flags(_once(sections))
    if not cfg.index_toc:
        flagged = flagged.where(~F.col("toc"))
    title = F.btrim(F.regexp_replace(nfc(F.coalesce("heading", F.lit(""))), r"(?U)\s+", " "))
    bare = F.regexp_replace(title, r"[.:]+$", "")
    words = F.size(F.split(title, " "))
    unlike = (F.length(title) > 200) | (words > 25) | (title.rlike(r"[.;,]$") & (words > 8))
    facts = documents.groupBy("document_id").agg(F.max("title").alias("deck_title"), F.bool_or("pdf").alias("pdf")) if documents is not None else None
    known = flagged.join(facts, "document_id", "left") if facts is not None else flagged.withColumns({"deck_title": F.lit(None).cast("string"), "pdf": F.lit(True)})
    for c, kind in (("images", "array<string>"), ("blocks", "array<struct<kind:string,text:string>>")):
        if c not in known.columns:
            known = known.withColumn(c, F.lit(None).cast(kind))
    placed = known.withColumns({"slides": _slides(known), "pdf": F.coalesce("pdf", F.lit(True)), "heading": F.when((bare != "") & ~(unlike & F.coalesce("pdf", F.lit(True))), bare), "content": nfc(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n"))})
    placed = heading_paths(placed)
    root = F.try_element_at("path", F.lit(1))
    new = ~F.col("slides") & ~root.eqNullSafe(F.lag(root).over(_doc()))
    placed = placed.withColumn("top", F.sum(new.cast("int")).over(_doc()))

    def step(rows: list[dict]) -> list[tuple]:
        counter, head = _counter(tokenizer), rows[0]
        with_paths = S.deck(rows, head["deck_title"], counter.count, 12) if head["slides"] else [(tuple(r["path"]), r) for r in rows]
        blocks = []
        for path, r in with_paths:
            given = r["blocks"] if head["slides"] else None
            body = [(b["kind"], b["text"] or "") for b in given] if given else [(r["element_type"] or "", r["content"] if r["content"].strip() != (r["heading"] or "") else "")]
            for i, (kind, text) in enumerate(body):
                kind = S.infer_kind(text, kind if kind in ("table", "list", "code") else "text")
                text = S.cleaned(text, kind, bool(r["pdf"]))
                shown = "toc" if r["toc"] else kind if text else "slide" if head["slides"] else kind
                blocks.append((path, S.Block(text, shown, r["page_number"], r["ord"] * 1000 + i, tuple(r["images"] or ()) if i == 0 else ())))
        out, before = [], None
        for i, c in enumerate(S.chunks_of(blocks, counter, cfg)):
            text, units = c.text(), c.units()
            page, pages, kinds = S.main_page(units), c.pages(), {u.block.kind for u in units}
            images = list(dict.fromkeys(x for u in units for x in u.block.images))
            out.append((head["document_id"], head["top"], i, text, S.embedding_input(c, before, text, counter, cfg), list(c.path), list(S.cited_path(c, page)), page, min(pages, default=None), max(pages, default=None),
                        kinds.pop() if len(kinds) == 1 else "mixed", counter.count(text), images))
            before = c
        return out

    rows = placed.select("document_id", "top", "ord", "content", "element_type", "heading", "page_number", "toc", "images", "blocks", "path", "slides", "deck_title", "pdf")
    made = map_groups(rows, ["document_id", "top"], ["ord"], _MADE, step)
    order = Window.partitionBy("document_id").orderBy("top", "nth")
    numbered = made.withColumn("nth", F.row_number().over(order) - 1)
    of = Window.partitionBy("document_id", "top", "common")
    return numbered.select(
        chunk_uuid(F.col("document_id"), F.lit(f"structural-{VERSION}"), F.col("nth"), F.col("common"), F.col("content")).alias("chunk_id"), "document_id", F.col("nth").cast("int").alias("chunk_index"), "content", "embedding_input",
        F.md5("content").alias("content_hash"), "path", "page_number", "page_start", "page_end", (F.row_number().over(of.orderBy("nth")) - 1).alias("part_index"), F.count("*").over(of).cast("int").alias("part_count"),
        "content_type", "token_count", "images")


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "heading": heading_chunks,
    "structural": structural_chunks,
    "token": lambda s: window_chunks(s, "token"),
    "sentence": lambda s: window_chunks(s, "sentence"),
    "semantic": semantic_chunks,
}


def chunk(sections: DataFrame, method: str = "heading") -> DataFrame:
    """Chunks of all documents by one of ``METHODS``."""
    return METHODS[method](sections)
