from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.operators import curriculum as C
from foliant.operators import graph as G
from foliant.operators import pages as P
from foliant.operators import retrieval as T
from foliant.operators import writes as W
from foliant.operators.ordered import ranked
from foliant.streaming import outbox as O

T0 = datetime(2024, 1, 1)


def test_confirmed_mappings_are_sticky(spark):
    cols = "chunk_id string, lo_id string, confidence double, source string, provenance string, mapped_at timestamp"
    old = spark.createDataFrame([("c", "l", 0.9, "a", "confirmed", T0), ("d", "l", 0.5, "a", "inferred", T0)], cols)
    new = spark.createDataFrame([("c", "l", 0.2, "b", "inferred", T0), ("d", "l", None, "b", "inferred", T0)], cols)
    got = {r.chunk_id: (r.confidence, r.source, r.provenance) for r in W.upsert_mappings(old, new).collect()}
    assert got == {"c": (0.9, "b", "confirmed"), "d": (0.5, "b", "inferred")}
    assert [r.chunk_id for r in W.delete_inferred(old, old).collect()] == ["c"]


def test_relations_are_replaced_and_written_once(spark):
    cols = "relation_id string, chunk_id string, source_key string, relation_type string, target_key string"
    old = spark.createDataFrame([("1", "c", "a", "r", "b"), ("2", "d", "a", "r", "b")], cols)
    new = spark.createDataFrame([("4", "c", "x", "r", "y"), ("3", "c", "x", "r", "y"), ("5", "z", "x", "r", "y")], cols)
    of = spark.createDataFrame([("c",)], "chunk_id string")
    assert sorted(r.relation_id for r in W.replace_relations(old, new, of).collect()) == ["2", "3"]
    assert sorted(r.relation_id for r in W.replace_relations(old, new, of.limit(0)).collect()) == ["1", "2"]


def test_traversal_stops_at_the_limit(spark):
    rows = [("r1", "hold and wait", "deadlock", 1), ("r2", "deadlock", "starvation", 2), ("r3", "starvation", "livelock", 3)]
    rel = spark.createDataFrame(rows, "relation_id string, source_key string, target_key string, created_at int")
    two = G.reachable(rel, "deadlock", 2, 25).orderBy("rank").collect()
    assert [(r.relation_id, r.hop) for r in two] == [("r1", 1), ("r2", 1), ("r3", 2)]
    assert [r.relation_id for r in G.reachable(rel, "deadlock", 2, 1).collect()] == ["r1"]
    assert G.reachable(rel, "nothing like it", 2, 5).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bounded_ranges_equal_greedy_merging(spark, seed):
    rng = random.Random(seed)
    pages = sorted(rng.sample(range(60), 18))
    ranges = []
    for p in pages:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    greedy = [list(r) for r in ranges]
    while len(greedy) > 4:
        i = min(range(len(greedy) - 1), key=lambda k: greedy[k + 1][0] - greedy[k][1])
        greedy[i : i + 2] = [[greedy[i][0], greedy[i + 1][1]]]
    df = spark.createDataFrame([("d", p) for p in pages], "document_id string, page int")
    got = [[r.first, r.last] for r in P.bounded_ranges(P.page_ranges(df), 4).orderBy("first").select(F.col("first"), F.col("last")).toPandas().itertuples(index=False)]
    assert got == greedy


def test_pages_are_classed_by_text_then_images(spark):
    cols = "page int, char_count int, image_area_ratio double, drawing_count int, multi_column boolean, table_count int"
    rows = [(1, 40, 0.9, 5, False, 0), (2, 41, 0.0, 0, True, 2), (3, 39, 0.5, 0, True, 1), (4, 39, 0.01, 0, False, 0), (5, 0, 0.0, 1, False, 0), (6, 1, 0.0, 0, False, 0), (7, None, None, None, None, None)]
    got = {r.page: (r.status, r.reasons) for r in P.classify(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("text", []), 2: ("complex_layout", ["multi_column", "table_detected"]), 3: ("needs_ocr", ["image_page"]), 4: ("needs_ocr", ["no_text_layer"]),
                   5: ("needs_ocr", ["no_text_layer"]), 6: ("text", ["sparse_text"]), 7: ("empty", [])}


def test_page_sets_count_the_readers(spark):
    cols = "document_id string, page int, status string, attempts array<string>, parsed_by string, layout_aware boolean"
    rows = [("d", 1, "needs_ocr", ["a"], None, False), ("d", 2, "needs_ocr", ["a", "b"], None, False), ("d", 3, "needs_ocr", ["a", "b"], "b", True), ("d", 4, "complex_layout", ["a"], "a", False),
            ("d", 5, "complex_layout", ["a", "b"], "b", True), ("d", 6, "empty", ["a"], None, False), ("e", 1, "text", None, "a", None)]
    report = spark.createDataFrame(rows, cols)
    got = {(r.document_id, r.page): r.sets for r in P.page_sets(report).collect()}
    assert got == {("d", 1): ["needs_fallback", "unprocessed"], ("d", 2): ["no_text"], ("d", 3): [], ("d", 4): ["needs_fallback", "degraded"], ("d", 5): [], ("d", 6): [], ("e", 1): []}
    totals = spark.createDataFrame([("e", 3)], "document_id string, pages_total int")
    cov = {r.document_id: r for r in P.coverage(report, totals).collect()}
    assert (cov["d"].resolved, cov["d"].by_reader, cov["d"].unprocessed_pages, cov["d"].no_text_pages, cov["d"].complete) == (4, "a:1,b:2", "1", "2", False)
    assert (cov["e"].skipped, cov["e"].complete) == (2, False) and P.coverage(report).where("document_id = 'e'").collect()[0].complete


def test_contents_may_begin_after_the_third_section(spark):
    cols = "document_id string, ord int, content string, heading string"
    leaders = "One .... 1\nTwo .... 2"
    rows = [("d", i, "words " * 40, None) for i in range(8)] + [("d", 8, leaders, None), ("d", 9, leaders, None)] + [("e", i, "words " * 40, None) for i in range(9)] + [("e", 9, leaders, None)]
    rows += [("f", 0, "x" * 61 + " mục lục", "A"), ("f", 1, "Mục lục", "A"), ("f", 2, None, "Danh mục hình"), ("g", 0, None, None)]
    got = {(r.document_id, r.ord) for r in P.toc_sections(P.toc_scores(spark.createDataFrame(rows, cols))).collect()}
    assert got == {("d", 8), ("d", 9), ("f", 1), ("f", 2)}


def test_traversal_sees_only_what_a_reader_may(spark):
    rel = spark.createDataFrame([(f"r{i}", "a", "b", i, c, f, k) for i, (c, f, k) in enumerate([("c1", "d1", "k"), ("c2", "d1", "k"), ("c1", "d2", "k"), ("c1", "d3", "k"), ("c1", "d1", "other"), ("c9", "d1", "k")])],
                                "relation_id string, source_key string, target_key string, created_at int, chunk_id string, document_id string, course_id string")
    chunks = spark.createDataFrame([("c1", None), ("c2", T0)], "chunk_id string, deleted_at timestamp")
    docs = spark.createDataFrame([("d1", None, None), ("d2", T0, True), ("d3", None, False)], "document_id string, deleted_at timestamp, lms_published boolean")
    seen = G.course_relations(rel, chunks, docs, "k")
    assert [r.relation_id for r in seen.collect()] == ["r0"] and [r.degree for r in G.degrees(seen).collect()] == [1, 1]


def test_right_choices_take_their_place(spark):
    choices = spark.createDataFrame([(q, i, i == 2) for q in range(6) for i in range(4)] + [(9, 0, False), (9, 1, False)], "question_id int, choice int, correct boolean")
    targets = spark.createDataFrame([(q, q) for q in range(10)], "question_id int, target int")
    got = A.placed_choices(choices, targets).collect()
    assert {r.question_id: r.place for r in got if r.correct} == {q: q % 4 for q in range(6)}
    assert all(sorted(r.place for r in got if r.question_id == q) == [0, 1, 2, 3] for q in range(6))
    assert {r.choice: r.place for r in got if r.question_id == 9} == {0: 0, 1: 1}


def test_hidden_vector_does_not_take_a_place(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0]), ("c", [0.8, 0.2, 0.0])], "chunk_id string, vector array<double>")
    assert [r.chunk_id for r in T.top_k(df.where("chunk_id <> 'a'"), [1.0, 0.0, 0.0], 2).orderBy("rank").collect()] == ["b", "c"]


def test_search_leaves_hidden_ones_and_contents_out(spark):
    points = spark.createDataFrame([("a", "d1", [1.0, 0.0], "text", "o", T0, ["Index"]), ("b", "d2", [0.9, 0.1], None, "o", T0, ["The Tree"]), ("c", "d2", [0.8, 0.2], "toc", "o", T0, None), ("e", "d2", [0.1, 0.9], "text", None, None, ["tree"])],
                                   "chunk_id string, document_id string, vector array<double>, content_type string, owner_id string, uploaded_at timestamp, heading_path array<string>")
    hidden = spark.createDataFrame([("d1",), ("d1",)], "document_id string")
    ids = lambda **more: [r.chunk_id for r in T.search(points, hidden, [1.0, 0.0], 3, **more).orderBy("rank").collect()]
    assert ids() == ["b", "e"] and ids(exclude_types=()) == ["b", "c", "e"] and ids(owner_id="o") == ["b"] and ids(heading_contains="TREE") == ["b", "e"]
    assert ids(uploaded_after=T0) == ["b"] and ids(uploaded_before=T0) == [] and ids(exclude_documents=["d2"]) == [] and ids(threshold=0.5) == ["b"]
    assert T.has_conditions(a=None, b=[]) is False and T.has_conditions(a="x") is True
    for bad in ({"k": 0}, {"k": 101}, {"threshold": 2.0}):
        with pytest.raises(ValueError):
            T.search(points, hidden, [1.0, 0.0], **bad)


def test_many_queries_are_ranked_in_blocks(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "chunk_id int, vector array<double>")
    asked = rows.select(F.col("chunk_id").alias("query_id"), "vector")
    once = sorted(tuple(r) for r in T.rank_all(rows, asked, 5).collect())
    assert sorted(tuple(r) for r in T.rank_all(rows, asked, 5, most_broadcast=10, block=7).collect()) == once and len(once) == 300


def test_ambiguous_chapters_abstain_and_courses_stay_apart(spark):
    profiles = spark.createDataFrame([("k", "1", [1.0, 0.0]), ("k", "2", [0.99, 0.14]), ("j", "9", [1.0, 0.0])], "course_id string, code string, vector array<double>")
    texts = spark.createDataFrame([("t", "k", [1.0, 0.05]), ("u", "j", [0.0, 1.0]), ("v", "none", [1.0, 0.0])], "text_id string, course_id string, vector array<double>")
    got = {r.text_id: (r.code, r.chapter) for r in T.match_chapters(texts, profiles).collect()}
    assert got == {"t": ("1", None), "u": ("9", None)}
    assert T.match_chapters(texts, profiles.where("code = '1'")).collect()[0].chapter == "1"


def test_titles_are_found_inside_words_and_without_marks(spark):
    chunks = spark.createDataFrame([("a", "k", ["1.Quản lý rủi ro", "x"]), ("b", "k", ["(rui ro du an)"]), ("c", "k", ["Rủi"]), ("d", "j", ["Quản lý rủi ro"]), ("e", "k", None), ("f", "k", [])], "chunk_id string, course_id string, heading_path array<string>")
    titles = spark.createDataFrame([("k", "3", "Quản lý rủi ro"), ("k", "12", "Rủi ro dự án"), ("k", "2", "rủi ro dự án"), ("k", "1", "Rủi ro"), ("k", "7", None)], "course_id string, code string, title string")
    assert {r.chunk_id: r.chapter_code for r in T.title_chapters(chunks, titles).collect()} == {"a": "3", "b": "2"}


@pytest.mark.parametrize("seed", range(3))
def test_titles_equal_comparing_all(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    chunks = [(i, "k", [word() for _ in range(rng.randrange(4))]) for i in range(60)]
    titles = [("k", str(i), word() + word()) for i in range(25)]
    want = {}
    for i, _, path in chunks:
        met = [(-len(t), int(c)) for _, c, t in titles if len(t) >= 4 and t.lower().replace("é", "e") in " ".join(path).replace("é", "e")]
        if met:
            want[i] = str(min(met)[1])
    got = T.title_chapters(spark.createDataFrame(chunks, "chunk_id int, course_id string, heading_path array<string>"), spark.createDataFrame(titles, "course_id string, code string, title string"), 4)
    assert {r.chunk_id: r.chapter_code for r in got.collect()} == want


def test_searched_chunks_come_first(spark):
    ranked = spark.createDataFrame([("l", c, i + 1) for i, c in enumerate("abcd")] + [("m", "a", 1)], "lo_id string, chunk_id string, rank int")
    found = spark.createDataFrame([("l", "d", 1), ("l", "zz", 2), ("l", "b", 3)], "lo_id string, chunk_id string, rank int")
    got = sorted((r.lo_id, r.rank, r.chunk_id) for r in T.reranked(ranked, found).collect())
    assert got == [("l", 1, "d"), ("l", 2, "b"), ("l", 3, "a"), ("l", 4, "c"), ("m", 1, "a")]


def test_whole_ranking_of_one_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["x", None]), rng.randrange(7), i) for i in range(900)]
    got = {r.i: r.rank for r in ranked(spark.createDataFrame(rows, "k string, o int, i int").repartition(7), ["k"], [F.col("o").desc(), F.col("i").asc()]).collect()}
    for k in ("hot", "x", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))


def test_curriculum_rules(spark):
    lo = spark.createDataFrame([("k", "L.O.1", None, "a"), ("k", "L.O.1.1", "L.O.1", "b"), ("k", "L.O.2.1", "L.O.2", "c"), ("k", "L.O.3", None, "d")], "course_id string, code string, parent_code string, statement_vi string")
    ao = spark.createDataFrame([("k", "A.O.1", None), ("k", "A.O.2.1", "A.O.2")], "course_id string, code string, parent_code string")
    ch = spark.createDataFrame([("k", "1", "One"), ("k", "2", " ")], "course_id string, code string, title string")
    cl = spark.createDataFrame([("k", "1", "L.O.1.1"), ("k", "2", "L.O.9")], "course_id string, chapter_code string, lo_code string")
    la = spark.createDataFrame([("k", "L.O.1.1", "A.O.1"), ("k", "L.O.8", "A.O.9")], "course_id string, lo_code string, ao_code string")
    goals = spark.createDataFrame([("k", "L.O.1", "a "), ("k", "L.O.3", "other"), ("k", "L.O.7", "x")], "course_id string, code string, statement_vi string")
    courses = spark.createDataFrame([("k",), ("empty",)], "course_id string")
    got = sorted((r.course_id, r.issue, r.subject) for r in C.issues(courses, lo, ao, ch, cl, la, goals).collect())
    assert got == sorted([
        ("k", "ref.unknown_lo", "2>L.O.9"), ("k", "ref.unknown_lo", "L.O.8>A.O.9"), ("k", "ref.unknown_ao", "L.O.8>A.O.9"), ("k", "lo.orphan_parent", "L.O.2.1"), ("k", "assessment.orphan_parent", "A.O.2.1"),
        ("k", "lo.not_taught", "L.O.2.1"), ("k", "lo.not_taught", "L.O.3"), ("k", "lo.not_assessed", "L.O.2.1"), ("k", "lo.not_assessed", "L.O.3"), ("k", "chapter.title_missing", "2"),
        ("k", "goal.code_collision", "L.O.3"), ("k", "lo.bloom_inferred", ""), ("empty", "chapter.none_extracted", "")])


def test_old_generations_are_left_out(spark):
    docs = spark.createDataFrame([("d", 2)], "document_id string, processing_generation int")
    res = spark.createDataFrame([("d", 1), ("d", 2), ("e", 0)], "document_id string, generation int")
    assert {tuple(r) for r in O.current_only(res, docs).select("document_id", "generation").collect()} == {("d", 2), ("e", 0)}


def test_chapter_numbers_read_every_spelling(spark):
    paths = spark.createDataFrame([("a", "k", ["CHƯƠNG 03: Index"]), ("b", "k", ["Buoi: 4"]), ("c", "k", ["Lecture-9", "Tuần 3"]), ("d", "k", ["3.6 Index"])], "chunk_id string, course_id string, heading_path array<string>")
    chapters = spark.createDataFrame([("k", "3"), ("k", "4")], "course_id string, code string")
    assert {tuple(r) for r in T.chapter_numbers(paths, chapters).collect()} == {("a", "3"), ("b", "4"), ("c", "3")}
