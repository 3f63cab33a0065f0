from __future__ import annotations

import io
import zipfile

import pytest

from foliant.sources import markdown, office, records, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(files: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def a_docx() -> bytes:
    p = lambda t, style="", extra="": f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{extra}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = p("Intro", "H1") + p("Text here.") + p("item", extra='<w:numPr><w:ilvl w:val="0"/></w:numPr>') + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("Deep", extra='<w:outlineLvl w:val="2"/>')
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'})


def a_pptx() -> bytes:
    shape = lambda t, y, ph="", lvl=0: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p>{f"<a:pPr lvl=\"{lvl}\"/>" if lvl else ""}<a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f"<p:sld {A}><p:cSld><p:spTree>{shape('low', 900)}{shape('high', 100, lvl=1)}{shape('The title', 50, '<p:ph type=\"title\"/>')}</p:spTree></p:cSld></p:sld>"
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="slides/slide1.xml" Type="slide"/></Relationships>'
    return zipped({"ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel, "ppt/slides/slide1.xml": slide})


def test_markdown_blocks():
    text = "---\ntitle: x\n---\n# One\nPara\nmore\n\n- a\n  cont\n- b\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n~~~~py\n# no heading\n~~~\n~~~~\n## Two ##\nlast"
    assert [(k, h, n) for k, h, n, _ in markdown.parse(text)] == [
        ("heading", "One", 1), ("paragraph", "One", 1), ("list", "One", 1), ("table", "One", 1), ("code", "One", 1), ("heading", "Two", 2), ("paragraph", "Two", 2)]
    assert markdown.parse(None) == [] == markdown.parse("  \n")
    assert markdown.parse("```\nopen fence")[0][0] == "code"


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "b.md").write_text("")
    assert markdown.read(spark, str(tmp_path)).count() == 2


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(a_docx())
    (tmp_path / "b.pptx").write_bytes(a_pptx())
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = office.read(spark, str(tmp_path)).orderBy("document_id", "ord").collect()
    got = [(r.element_type, r.heading, r.heading_level, r.content) for r in rows if r.error is None]
    assert got == [
        ("heading", "Intro", 1, "Intro"), ("paragraph", "Intro", 1, "Text here."), ("list", "Intro", 1, "item"), ("table", "Intro", 1, "a | b\n--- | ---\n1 | 2"), ("heading", "Deep", 3, "Deep"),
        ("slide", "The title", 1, "The title\n  - high\nlow")]
    assert sum(r.error is not None for r in rows) == 1
    assert {r.error for r in office.read(spark, str(tmp_path), 10).collect()} >= {"too large"}


def test_tables_commit_together(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.range(3).withColumnRenamed("id", "x")
    assert tables.commit(spark, root, {"a": df, "b": df}) == 1
    assert tables.commit(spark, root, {"a": df.where("x > 0")}) == 2
    assert (tables.read(spark, root, "a").count(), tables.read(spark, root, "b").count(), tables.read(spark, root, "a", 1).count()) == (2, 3, 3)


def test_records(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "q", "evidence": [{"document": "d", "page": 2}]}\n\nnot json\n')
    good, bad = records.read(spark, str(tmp_path), records.QUESTIONS)
    rows = good.collect()
    assert len(rows) == 1 and rows[0].evidence[0].page == 2 and [(r.line, r.file) for r in bad.collect()] == [("not json", "q.jsonl")]


def test_objects_are_put_found_and_deleted(spark, tmp_path):
    from foliant.sources import objects

    root = str(tmp_path / "store")
    objects.put(spark, root, "a/one.pdf", b"1")
    objects.put(spark, root, "/a/one.pdf", b"22")
    objects.put(spark, root, "b.txt", b"x")
    objects.put(spark, root, "empty", b"")
    assert objects.exists(spark, root, "a/one.pdf") and not objects.exists(spark, root, "c")
    assert {(r.key, r.length) for r in objects.objects(spark, root).collect()} == {("a/one.pdf", 2), ("b.txt", 1)} and objects.exists(spark, root, "empty")
    files = spark.createDataFrame([("a/one.pdf",), ("gone",)], "storage_key string")
    assert {tuple(r) for r in objects.missing(files, objects.objects(spark, root)).collect()} == {("gone", "lost"), ("b.txt", "unknown")}
    assert objects.delete(spark, root, "b.txt") and not objects.delete(spark, root, "b.txt")
    for bad in ("", "..", "../x", "/"):
        with pytest.raises(ValueError):
            objects.path_of(root, bad)
    sizes = spark.createDataFrame([(1, 10, None), (300 << 20, 10, 1), (1, 9999, 1), (None, None, 99 << 20)], "size_bytes bigint, page_count int, image_bytes bigint")
    assert [r.error for r in objects.within_budget(sizes).collect()] == [None, "too many bytes", "too many pages", "too many image bytes"]


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "x"}\n\n{"id": \n{"id": "2", "question": "y", "more": 1}\n[1]\n')
    good, bad = records.read(spark, str(tmp_path), "id string, question string")
    assert sorted(map(tuple, good.collect())) == [("1", "x"), ("2", "y")] and sorted(r.line for r in bad.collect()) == ["[1]", '{"id": ']


@pytest.mark.parametrize("text, want", [
    ("````\n```\n# no\n````\n# A #\nx", ["code", "heading", "paragraph"]), ("| a |\n|---|\n| 1 |\n- x\n  y\n\ny", ["table", "list", "paragraph"]), ("~~~\nopen", ["code"]), ("---\na: 1\n---\n1. x\nz", ["list", "paragraph"]),
    ("a | b\nc", ["paragraph"]), ("\r\n# T\r\n\r\nx\ry", ["heading", "paragraph"]), ("", []), (None, []), ("    indented only", ["paragraph"])])
def test_blocks_of_markdown(text, want):
    assert [k for k, *_ in markdown.parse(text)] == want


def test_pictures_of_documents_and_decks(spark, tmp_path):
    rels = lambda *targets: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
        f'<Relationship Id="r{i}" Type="http://x/relationships/{kind}" Target="{t}"{mode}/>' for i, (kind, t, mode) in enumerate(targets)) + "</Relationships>"
    outside = ' TargetMode="External"'
    deck = zipped({"ppt/slides/_rels/slide10.xml.rels": rels(("image", "../media/b.png", ""), ("image", "../media/a.png", "")), "ppt/slides/_rels/slide2.xml.rels": rels(("image", "../media/a.png", ""), ("image", "http://x/y.png", outside), ("image", "../media/none.png", "")),
                   "ppt/media/a.png": "AAAA", "ppt/media/b.png": "BB", "ppt/media/unused.png": "C"})
    (tmp_path / "x.pptx").write_bytes(deck)
    (tmp_path / "y.docx").write_bytes(zipped({"word/_rels/document.xml.rels": rels(("image", "media/i.png", ""), ("styles", "styles.xml", "")), "word/media/i.png": "I"}))
    (tmp_path / "z.docx").write_bytes(b"broken")
    got = {(r.document_id.rsplit("/", 1)[1], r.page, r.nth, r.name, r.bytes, bytes(r.content)) for r in office.read_pictures(spark, str(tmp_path)).collect()}
    assert got == {("x.pptx", 2, 0, "a.png", 4, b"AAAA"), ("x.pptx", 10, 1, "b.png", 2, b"BB"), ("y.docx", None, 0, "i.png", 1, b"I")}
    assert {r.name for r in office.read_pictures(spark, str(tmp_path), most_image_bytes=4).collect()} == {"a.png", "i.png"}
