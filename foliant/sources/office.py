"""DOCX and PPTX sources, read as zipped XML from binary files.

A file that can not be read gives one row with its ``error`` and no section;
it never fails the job."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "document_id string, ord int, element_type string, heading string, heading_level int, content string, page_number int, error string"
# Name spaces of the formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Heading styles that carry no number.
_STYLES = {"title": 1, "tiêu đề": 1, "subtitle": 2}


def _style_level(style: str, outline: str | None) -> int:
    low = style.lower().strip()
    if low in _STYLES:
        return _STYLES[low]
    m = re.match(r"(?:heading|tiêu đề|titre|überschrift)\s*(\d+)", re.sub(r"(?<=[a-zà-ỹ])(?=\d)", " ", low))
    if m:
        return min(6, int(m[1]))
    return min(6, int(outline) + 1) if outline is not None and outline.isdigit() and int(outline) < 9 else 0


def docx(data: bytes) -> list[tuple]:
    """``(element_type, heading, level, content, page)`` in body order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
            n = s.find(f"{_W}name")
            names[s.get(f"{_W}styleId")] = n.get(f"{_W}val") if n is not None else s.get(f"{_W}styleId")
    body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, heading, level = [], None, 0
    text_of = lambda e: "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else t.text or "" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            text = text_of(e).strip()
            if not text:
                continue
            props = e.find(f"{_W}pPr")
            get = lambda tag: None if props is None or props.find(f"{_W}{tag}") is None else props.find(f"{_W}{tag}").get(f"{_W}val")
            style = names.get(get("pStyle"), get("pStyle") or "")
            n = _style_level(style, get("outlineLvl"))
            if n:
                heading, level = text, n
                out.append(("heading", heading, level, text, None))
            elif props is not None and props.find(f"{_W}numPr") is not None or style.lower().startswith("list"):
                out.append(("list", heading, level, text, None))
            else:
                out.append(("paragraph", heading, level, text, None))
        elif e.tag == f"{_W}tbl":
            rows = []
            for r in e.iter(f"{_W}tr"):
                rows.append([" ".join(text_of(c).split()) for c in r.findall(f"{_W}tc")])
            if any(any(r) for r in rows):
                lines = [" | ".join(r) for r in rows]
                lines.insert(1, " | ".join("---" for _ in rows[0]))
                out.append(("table", heading, level, "\n".join(lines), None))
    return out


def pptx(data: bytes) -> list[tuple]:
    """One section a slide: its title, blocks by place, and notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
    order = [rels[s.get(f"{_R}id")] for s in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
    out = []
    for page, target in enumerate(order, 1):
        name = "ppt/" + target.lstrip("/").removeprefix("ppt/")
        title, blocks = None, []
        for shape in ET.fromstring(z.read(name)).iter():
            if shape.tag not in (f"{_P}sp", f"{_P}graphicFrame"):
                continue
            off = next(shape.iter(f"{_A}off"), None)
            at = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (1 << 60, 0)
            rows = [" | ".join("".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")) for r in shape.iter(f"{_A}tr")]
            if rows:
                blocks.append((at, "\n".join(rows)))
                continue
            lines = []
            for p in shape.iter(f"{_A}p"):
                s = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
                pr = p.find(f"{_A}pPr")
                if s:
                    lines.append(("  " * int(pr.get("lvl", 0)) + "- " if pr is not None and int(pr.get("lvl", 0)) > 0 else "") + s)
            ph = next(shape.iter(f"{_P}ph"), None)
            if lines and title is None and ph is not None and ph.get("type") in ("title", "ctrTitle"):
                title = " ".join(lines)
            elif lines:
                blocks.append((at, "\n".join(lines)))
        blocks.sort(key=lambda b: b[0])
        if title is None and blocks:
            title = blocks[0][1].split("\n")[0]
        notes = ""
        rel = f"ppt/slides/_rels/{name.rsplit('/', 1)[1]}.rels"
        if rel in z.namelist():
            for r in ET.fromstring(z.read(rel)):
                if r.get("Type", "").endswith("/notesSlide"):
                    notes = " ".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ET.fromstring(z.read("ppt/notesSlides/" + r.get("Target").rsplit("/", 1)[1])).iter(f"{_A}p")).strip()
        content = "\n".join(x for x in [title or "", *(b for _, b in blocks if b != title), f"[Notes] {notes}" if notes else ""] if x)
        if content.strip():
            out.append(("slide", title, 1, content, page))
    return out


def read(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """Sections of all DOCX and PPTX files below a path; files above
    ``most_bytes`` are reported, not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(docx|pptx)$"))
    fits = files.where(F.col("length") <= most_bytes).select("path", "content")
    large = files.where(F.col("length") > most_bytes).select(
        F.col("path").alias("document_id"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in SCHEMA.split(", ")[1:-1])), F.lit("too large").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    made = docx(data) if p.lower().endswith("docx") else pptx(data)
                    rows += [(p, i, *m, None) for i, m in enumerate(made)]
                except Exception as e:  # noqa: BLE001 - a broken file is a row
                    rows.append((p, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            out = pd.DataFrame(rows, columns=names)
            for c in ("ord", "heading_level", "page_number"):
                out[c] = out[c].astype("Int32")
            yield out

    return fits.mapInPandas(run, SCHEMA).unionByName(large)


def pictures(data: bytes) -> list[tuple[str, int | None, bytes]]:
    """``(name, slide, content)`` of the pictures that a document or a deck
    shows: of a deck each with the first slide that shows it, in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    known = set(z.namelist())
    shown: dict[str, int | None] = {}
    for rel in sorted((n for n in known if re.fullmatch(r"(?:word|ppt/slides)/_rels/[^/]+\.rels", n)), key=lambda n: int("0" + re.sub(r"\D", "", n))):
        base = rel.split("/_rels/")[0]
        slide = int(re.sub(r"\D", "", rel) or 0) if base == "ppt/slides" else None
        for r in ET.fromstring(z.read(rel)):
            if r.get("Type", "").endswith("/image") and r.get("TargetMode") != "External":
                name = posixpath.normpath(posixpath.join(base, r.get("Target", "")))
                if name in known:
                    shown.setdefault(name, slide)
    return [(name.rsplit("/", 1)[1], slide, z.read(name)) for name, slide in shown.items()]


def read_pictures(spark: SparkSession, path: str, most_bytes: int = 256 << 20, most_image_bytes: int = 64 << 20) -> DataFrame:
    """``(document_id, page, nth, name, bytes, content)``: pictures of all DOCX
    and PPTX files below a path, one row each, in order as far as those of a
    file are within ``most_image_bytes``; a file that can not be read has none
    (its error is a row of ``read``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(docx|pptx)$") & (F.col("length") <= most_bytes)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for p, data in zip(pdf["path"], pdf["content"]):
                total = 0
                try:
                    found = pictures(data)
                except Exception:  # noqa: BLE001 - the sections of the file tell the error
                    continue
                for i, (name, slide, content) in enumerate(found):
                    total += len(content)
                    if total > most_image_bytes:
                        break
                    rows.append((p, slide, i, name, len(content), content))
            out = pd.DataFrame(rows, columns=["document_id", "page", "nth", "name", "bytes", "content"])
            out["page"] = out["page"].astype("Int32")
            yield out

    return files.mapInPandas(run, "document_id string, page int, nth int, name string, bytes bigint, content binary")
