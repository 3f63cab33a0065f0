from __future__ import annotations

import random

import pytest

from foliant.llm import splitting as S


@pytest.mark.parametrize("seed", range(20))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word", "a", " ", ". ", "\n", "\n\n", "é", "́", "漢字", "\r\n", "; "]) for _ in range(rng.randrange(1, 3000)))
    spans = S.spans(text, 150, 20)
    assert "".join(text[c:e] for _, c, e in spans) == text
    assert all(e - b <= 150 for b, _, e in spans) and all(c - b <= 20 for b, c, _ in spans)
    assert all(b >= p for (p, _, _), (b, _, _) in zip(spans, spans[1:]))
    if len(text) <= 150:
        assert len(spans) == 1


def test_strong_boundaries_come_first():
    text = "a" * 600 + ". " + "b" * 100 + "\n\n" + "c" * 900
    assert S.spans(text, 1500, 200)[0][2] == 704


def test_marks_stay_with_their_letter():
    text = "e" + "é" * 2000
    assert all(text[c] != "́" for _, c, _ in S.spans(text, 100, 10)[1:])
    assert S.spans("x" * 10_000, 100, 0)[1][1] > 0


def test_limits_are_checked():
    with pytest.raises(ValueError):
        S.spans("x", 10, 10)


def test_irregular_rows(spark):
    rows = [("d", 0, None, 1), ("d", 1, "", 2), ("d", 2, "x" * 1500, 3), ("d", 3, "x" * 1501, 4), ("d", 3, "x" * 1501, 4), (None, None, "word " * 20_000, 5)]
    df = spark.createDataFrame(rows, "document_id string, ord int, content string, piece int")
    made = S.split(df, ["document_id", "ord"])
    assert {tuple(r) for r in S.oversized(made, ["document_id", "ord"]).collect()} == {("d", 3), (None, None)}
    assert made.where("length(piece) > 1500").count() == 0
    assert S.split(df.limit(0), ["document_id", "ord"]).count() == 0
