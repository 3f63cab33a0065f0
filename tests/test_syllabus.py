from __future__ import annotations

import pytest

from foliant.operators import syllabus as S

LINES = """Mã học phần (Course ID): XY1234
Tên học phần: Nhập môn kho dữ liệu (Introduction to Data Warehouses)
Số tín chỉ (Credits): 4
4.1. Mục tiêu (Goals)
L.O.1 - Biết kho dữ liệu
L.O.2 Biết lược đồ
L.O.1 Know data warehouses
L.O.2 Know schemas
4.2. Chuẩn đầu ra (Outcomes)
L.O.1 - Trình bày kho dữ liệu (bậc một)
(Present (all) warehouses)
L.O.1.1 Thiết kế lược đồ
hình sao
(Design a star
schema)
L.O.2.1 – Đánh giá truy vấn (Assess queries)
L.O.2.1 Lần hai
L.O.3 Không có bản dịch
5.3. Đánh giá
L.O.1: A.O.1 A.O.2
L.O.1.1 by A.O.1.1
7. Khác
L.O.9 ngoài mục"""
TABLES = {
    (2, 0): [["Loại hoạt động", "Mã"], ["TN - Thực hành nhóm", "A.O.1 - Bài nhóm (Group work)"], ["", "A.O.1.1 Thi giữa kỳ\n(Midterm)"], ["", "none"], ["x", "A.O.1 again"]],
    (3, 0): [["", "", ""], ["Buổi (Session)", "Nội dung (Content)", "Hoạt động"], ["Chương 1", "1 Tổng quan\nvề kho\n(1 Overview)\n1.1. Khái niệm", "L.O.1.1 [A.O.1, A.O.1.1] x L.O.1.1 [A.O.1]"]],
    (4, 0): [["Buổi Session", "Nội dung", "x"], ["", "1.2 khái niệm\n1.3 Lịch sử", "L.O.2.1 [A.O.1]"], ["5, 6", "Chương 2: Lược đồ\n(Chapter 2. Schemas)", "L.O.9 [ A.O.7 ]"], ["Ôn", "Ôn tập", ""], ["9", "Thi", None]],
}


def frames(spark):
    lines = spark.createDataFrame([("d", 1 + i // 14, i, t) for i, t in enumerate(LINES.split("\n"))] + [("d", 1, 99, None), ("e", 1, 0, "nothing here")], "document_id string, page int, ord int, text string")
    cells = spark.createDataFrame([("d", p, t, i, r) for (p, t), rows in TABLES.items() for i, r in enumerate(rows)], "document_id string, page int, table_no int, row_no int, cells array<string>")
    return lines, cells


@pytest.mark.parametrize("block, want", [
    ("Một\n(One (1) and\ntwo)", ("Một", "One (1) and two")), ("Một (a) hai (b (c) d)", ("Một (a) hai", "b (c) d")), ("Một\n(hai", ("Một (hai", None)), ("(tất cả)", ("(tất cả)", None)),
    ("x (a (b (c)))", ("x (a (b (c)))", None)), ("A\n (b c\n(d)", ("A (b c", "d")), (None, ("", None)), ("  một ​ hai ", ("một hai", None))])
def test_translations(block, want):
    assert S.translated(block) == want


def test_header_goals_and_outcomes(spark):
    lines, _ = frames(spark)
    head = {r.document_id: r for r in S.courses(lines).collect()}
    assert (head["d"].code, head["d"].title_vi, head["d"].title_en, head["d"].credits, head["d"].version) == ("XY1234", "Nhập môn kho dữ liệu", "Introduction to Data Warehouses", 4, None)
    assert head["e"].code is None
    assert sorted((r.code, r.statement_vi, r.statement_en) for r in S.goals(lines).collect()) == [("L.O.1", "Biết kho dữ liệu", "Know data warehouses"), ("L.O.2", "Biết lược đồ", "Know schemas")]
    lo = {r.code: r for r in S.outcomes(lines).collect()}
    assert sorted(lo) == ["L.O.1", "L.O.1.1", "L.O.2.1", "L.O.3"]
    assert (lo["L.O.1"].statement_vi, lo["L.O.1"].statement_en, lo["L.O.1"].bloom_level, lo["L.O.1"].parent_code) == ("Trình bày kho dữ liệu (bậc một)", "Present (all) warehouses", 1, None)
    assert (lo["L.O.1.1"].statement_vi, lo["L.O.1.1"].statement_en, lo["L.O.1.1"].bloom_level, lo["L.O.1.1"].parent_code) == ("Thiết kế lược đồ hình sao", "Design a star schema", 6, "L.O.1")
    assert (lo["L.O.2.1"].statement_vi, lo["L.O.2.1"].times, lo["L.O.3"].statement_en, lo["L.O.3"].page) == ("Đánh giá truy vấn", 2, None, 2)


def test_assessments_schedule_and_links(spark):
    lines, cells = frames(spark)
    ao = {r.code: (r.name_vi, r.name_en, r.activity, r.category, r.parent_code) for r in S.assessments(lines, cells).collect()}
    assert ao == {"A.O.1": ("Bài nhóm", "Group work", "TN", "group_quiz", None), "A.O.1.1": ("Thi giữa kỳ", "Midterm", None, "midterm", "A.O.1")}
    rows = S.schedule(cells)
    got = [(r.row_order, r.session_no, r.expected, r.chapter_code, r.title_vi, r.title_en, r.lo_codes, r.ao_codes) for r in rows.orderBy("row_order").collect()]
    assert got == [
        (1, 1, 1, "1", "Tổng quan về kho", "Overview)", ["L.O.1.1", "L.O.2.1"], ["A.O.1", "A.O.1.1"]), (2, 5, 2, "2", "Lược đồ", "Schemas", ["L.O.9"], ["A.O.7"]),
        (3, 7, 7, None, "Ôn tập", None, [], []), (4, 9, 8, None, "Thi", None, [], [])]
    ch = {r.code: (r.title, r.topics, r.page) for r in S.chapters(rows).collect()}
    assert ch == {"1": ("Tổng quan về kho", "Khái niệm; Lịch sử", 3), "2": ("Lược đồ", "", 4)}
    assert S.chapters(rows).where("code = '1'").select(S.topics_of("topics").alias("t")).collect()[0].t == ["Khái niệm", "Lịch sử"]
    assert {(r.chapter_code, r.lo_code) for r in S.chapter_links(rows).collect()} == {("1", "L.O.1.1"), ("1", "L.O.2.1"), ("2", "L.O.9")}
    pairs = {(r.lo_code, r.ao_code, r.row_order) for r in S.assessment_links(lines, cells, rows).collect()}
    assert pairs == {("L.O.1", "A.O.1", None), ("L.O.1", "A.O.2", None), ("L.O.1.1", "A.O.1.1", None), ("L.O.1.1", "A.O.1", 1), ("L.O.1.1", "A.O.1.1", 1), ("L.O.2.1", "A.O.1", 1), ("L.O.2.1", "A.O.1.1", 1), ("L.O.9", "A.O.7", 2)}


def test_findings(spark):
    lines, cells = frames(spark)
    got = {(r.document_id, r.issue, r.subject) for r in S.findings(lines, cells).collect()}
    mine = {(i, s) for d, i, s in got if d == "d"}
    assert mine == {
        ("course.syllabus_version_missing", ""), ("lo.duplicate_code", "L.O.2.1"), ("lo.missing_english", "L.O.3"), ("ref.unknown_lo", "2>L.O.9"), ("ref.unknown_lo", "L.O.9>A.O.7"), ("ref.unknown_ao", "L.O.9>A.O.7"),
        ("ref.unknown_ao", "L.O.1>A.O.2"), ("lo.orphan_parent", "L.O.2.1"), ("lo.not_taught", "L.O.3"), ("lo.not_assessed", "L.O.3"), ("goal.code_collision", "L.O.1"), ("lo.bloom_inferred", ""),
        ("session.unreadable_label", "Ôn"), ("session.number_mismatch", "5"), ("session.number_mismatch", "9")}
    assert {i for d, i, s in got if d == "e"} >= {"course.code_missing", "lo.section_missing", "session.table_missing", "chapter.none_extracted", "assessment.none_extracted"}


def test_twelve_chapters(spark):
    taught = {"1": "1.1", "2": "1.2", "3": "1.2", "4": "2.2", "5": "2.2", "6": "2.1", "7": "2.2", "8": "2.1", "9": "2.1", "10": "3", "11": "3", "12": "2.2"}
    rows = [["Buổi / Session", "Nội dung", "Hoạt động"]] + [[str(int(c) + 1), f"Chương {c}. Tên {c}\n(Chapter {c}: Name {c})\n{c}.1 Mục", f"Làm L.O.{lo} [A.O.1]"] for c, lo in taught.items()]
    cells = spark.createDataFrame([("d", 5 + i // 4, 0, i % 4 if i >= 4 else i, r) for i, r in enumerate(rows[:1] + [rows[0]] * 0 + rows[1:4])] + [("d", 6, 0, i, r) for i, r in enumerate([rows[0]] + rows[4:])], "document_id string, page int, table_no int, row_no int, cells array<string>")
    got = S.schedule(cells)
    assert {(r.chapter_code, r.lo_code) for r in S.chapter_links(got).collect()} == {(c, f"L.O.{lo}") for c, lo in taught.items()}
    assert [r.title_en for r in got.orderBy("row_order").collect()] == [f"Name {c}" for c in taught]
    empty = S.findings(spark.createDataFrame([], "document_id string, page int, ord int, text string"), cells.limit(0))
    assert empty.count() == 0
