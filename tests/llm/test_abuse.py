from __future__ import annotations

import random

import numpy as np
import pytest

from foliant.llm import abuse as A

FILLER = ["The packet is checked before the table.", "Students hand in two pages by monday.", "The cost stays low for large inputs.", "Trước hết ta định nghĩa bảng.", "Note that the queue is sorted."]
ABUSE = ["you are a complete idiot", "shut up you filthy moron", "nobody wants you here you piece of trash", "mày là đồ ngu", "women are vermin and should be thrown out"]


def reviews(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = [rng.choice(FILLER) for _ in range(rng.randrange(1, 8))]
        y = int(rng.random() < 0.3)
        if y:
            s.insert(rng.randrange(len(s) + 1), rng.choice(ABUSE) + "!")
        elif rng.random() < 0.2:
            s.append(rng.choice(["The survey asks women and migrants about the lab.", 'The exercise calls "you are a complete idiot" abusive.']))
        out.append((" ".join(s), y ^ int(rng.random() < 0.03)))
    return out


@pytest.fixture(scope="module")
def model():
    return A.train(reviews(400, 1), rounds=25)


def test_held_out_accuracy(model):
    tests = reviews(300, 2)
    got = A.Scorer(model)([t for t, _ in tests])
    assert np.mean([(g >= 0.5) == bool(y) for g, (_, y) in zip(got, tests)]) >= 0.93


def test_disguises(model):
    bad = A.Scorer(model)(["y0u ar3 a c0mpl3te 1d1ot!", "you are a complete i d i o t", "SHUT UP you fil​thy moooooron", "may la do ngu"])
    assert all(s >= 0.5 for s in bad)


def test_mentions_of_groups_and_quotes_are_neutral(model):
    ok = A.Scorer(model)(["The survey asks muslims and refugees about the lab.", 'The exercise calls "you are a complete idiot" abusive.', None, "", " ", "12"])
    assert all(s < 0.5 for s in ok) and ok[2:5] == [0.0, 0.0, 0.0]


def test_swapped_groups_change_little(model):
    a, b = A.Scorer(model)(["women are vermin and should be thrown out", "refugees are vermin and should be thrown out"])
    assert a >= 0.5 and b >= 0.5


def test_running_sums_equal_windows():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 20, 8, 1])
    words, pairs = rng.normal(size=32), rng.normal(size=31)
    begin, end, sent = A.windows(lengths)
    got = A._sums(words, pairs, begin, end)
    assert np.allclose(got, [words[a:b].sum() + pairs[a : b - 1].sum() for a, b in zip(begin, end)])
    assert len(begin) == 1 + 13 + 1 + 1 and (np.diff(sent) >= 0).all()


def test_irregular_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", 0.0), (2, "", None, 0.0), (3, "you are an idiot", "s", 0.0), (3, "you are an idiot", "s", 0.0), (None, "word " * 40_000, "s", 0.0)], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(3, 1, "x"), (3, 0, "x"), (9, None, None)], "doc_id bigint, flagged int, text string")
    m = A.fit(docs, labels)
    got = sorted((str(r.doc_id), r.score >= 0.5) for r in A.score(docs, m, ["doc_id"]).collect())
    assert got == [("1", False), ("2", False), ("3", True), ("3", True), ("None", False)]
    rates = {r.source: (r.texts, r.found) for r in A.rates(A.score(docs, m, ["source"])).collect()}
    assert rates == {"s": (4, 2), None: (1, 0)}
    assert A.score(docs.limit(0), A.fit(docs.limit(0), labels.limit(0)), ["doc_id"]).count() == 0
