from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.llm import scans as X

SECTIONS = "document_id string, ord int, content string, page_number int, element_type string, heading string, kind string"
METAS = "document_id string, title string, mime_type string"
CLEAN = "The window explains the method of the common register. The inner graph determines the distance of the in-memory method. "


def sections(spark, extra):
    rows = [(f"clean{i % 20}", i, CLEAN * 3, 1, "paragraph", None, None) for i in range(60)]
    return spark.createDataFrame(rows + extra, SECTIONS)


def test_all_kinds_of_traces(spark):
    scanned = (
        "Chapter 3. Introduction to the common graph\nThe wind0w explains the mcthod of the com-\nmon register. The inner graph deter¬\n"
        "12\nChapter 3. lntroduction to the c0mmon graph    12\nmines the distance of the in-\nmemory method.\n- 13 -")
    df = sections(spark, [("scan", 1, scanned, 12, "paragraph", None, None), ("scan", 1, scanned, 12, "paragraph", None, None), ("scan", 2, CLEAN, 13, "paragraph", None, None)])
    metas = spark.createDataFrame([("scan", "Introduction to the common graph", "application/pdf")], METAS)
    decided = X.decisions(df, metas)
    assert {tuple(r) for r in X.traces(decided).collect()} == {("scan", 1, k) for k in ("broken_word", "wrong_char", "running_line", "page_number")}
    text = {r.ord: r.content for r in X.repaired(df, decided).collect()}[1]
    assert text == "The window explains the method of the common register. The inner graph determines the distance of the in-memory method."


def test_clean_and_irregular_rows_have_no_traces(spark):
    rows = [("p", 1, None, 1, "paragraph", None, None), ("p", 2, " \n\t ", 1, None, None, None), ("p", 3, "The in-\nmemory method.\n21.", 3, "paragraph", None, None), ("s", 1, "7\n" + CLEAN, 7, "slide", None, None),
            ("w", 1, "7\n" + CLEAN, 7, "paragraph", None, None), (None, None, "word " * 30_000, None, None, None, None), ("t", 1, "| a |\n12\n15", 12, "table", None, None)]
    metas = spark.createDataFrame([("w", None, "text/markdown"), ("p", None, None), (None, "x", "application/pdf")], METAS)
    assert X.traces(X.decisions(sections(spark, rows), metas)).count() == 0
    empty = sections(spark, []).limit(0)
    assert X.traces(X.decisions(empty, metas.limit(0))).count() == 0


@pytest.mark.parametrize(("line", "page", "edge", "yes"), [
    ("- 3 -", 3, True, True), ("Page 9", 9, True, True), ("Trang 6 / 10", 6, True, True), ("xvii", 17, True, True), ("lO", 10, True, True), ("[18]", 18, True, True), ("6 |", 6, True, True),
    ("2/6", 2, False, True), ("57", 3, True, False), ("21.", 21, True, False), ("1. Item", 1, True, False), ("Example 16", 16, True, False), ("word", 1, True, False), ("mix", 9, True, False), ("13", None, True, True), ("13", None, False, False)])
def test_page_numbers(line, page, edge, yes):
    assert X.page_number(line, page, edge, False) is yes


def test_folding_ignores_confusions():
    same = ["Introduction to the common tree", "lntr0ducti0n to the cornrnon tr€e", "INTRODUCTION TO THE COMMON TREE", "Introductiori to tbe commori trcc"]
    assert len({X.folded(s) for s in same}) == 1
    assert X.folded("Introduction") != X.folded("Properties")


def test_anagram_hash_finds_corrections(spark):
    vocab = spark.createDataFrame([("register", 500), ("rcgister", 2), ("regi§ter", 1), ("window", 400), ("vvindow", 1), ("palnim", 3), ("other", 90), ("othre", 1)], "word string, n bigint")
    got = {r.word: r.right for r in X.corrections(vocab).collect()}
    assert got == {"rcgister": "register", "regi§ter": "register", "vvindow": "window"}
    assert X.corrections(vocab.where(F.lit(False))).count() == 0


def test_repair_keeps_lists_and_code():
    text = "One line\ngoes on.\n- item\n- other\nitem\n\ndef f(x):\n    return x\n"
    assert X.repair(text, []) == "One line goes on.\n- item\n- other item\n\ndef f(x):\n    return x"


def test_prose_lines_that_begin_like_code_are_read(spark):
    scanned = "The window explains the method and we\nreturn to both in a later part of the reg-\nister. The inner graph determines\nfrom the distance of the mcthod and the wind0w;\nthe method of the register."
    df = sections(spark, [("scan", 1, scanned, 12, "paragraph", None, None)])
    decided = X.decisions(df, spark.createDataFrame([("scan", None, "application/pdf")], METAS))
    assert {tuple(r) for r in X.traces(decided).collect()} == {("scan", 1, "broken_word"), ("scan", 1, "wrong_char")}
    assert X.repaired(df, decided).first().content == (
        "The window explains the method and we return to both in a later part of the register. The inner graph determines from the distance of the method and the window; the method of the register.")


@pytest.mark.parametrize(("text", "kind", "code"), [
    ("from the store if it is full. Our spanning", "paragraph", set()), ("while readers wait: Students hand in 14 pages\nclass of the same kind as the other one;", "list", set()),
    ("from os import path\nimport sys\ndef f(x):\n    if x in y and z and w:\n        return x\nText follows here.", None, {0, 1, 2, 3, 4}),
    ("int x = f(3);\nreturn x;", None, {0, 1}), ("return kezen", "code", {0}), ("| a word and one more word |\n|n the window of the room", None, {0})])
def test_code_needs_evidence(text, kind, code):
    assert X.code_lines(text.split("\n"), kind) == code
