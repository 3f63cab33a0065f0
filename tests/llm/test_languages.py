from __future__ import annotations

import numpy as np
import pytest

from foliant.llm import languages as G

SAMPLES = {
    "en": "The student reads the chapter about memory and writes a short summary before the next lecture begins in the large hall.",
    "fr": "Les étudiants lisent le chapitre sur la mémoire et rendent un court résumé avant le début du prochain cours dans la grande salle.",
    "de": "Die Studierenden lesen das Kapitel über den Speicher und schreiben eine kurze Zusammenfassung, bevor die nächste Vorlesung im großen Saal beginnt.",
    "vi": "Sinh viên đọc chương về bộ nhớ và viết một bản tóm tắt ngắn trước khi buổi học tiếp theo bắt đầu ở giảng đường lớn.",
}


@pytest.fixture(scope="module")
def model():
    return G.train([(t, k) for k, t in SAMPLES.items() for _ in range(5)] + [(SAMPLES["en"], "fr")], rounds=30)


def brute_posterior(emit, move):
    n = len(emit)
    paths = {(): 0.0}
    for t in range(n):
        paths = {(*p, y): s + emit[t, y] + (move[p[-1], y] if p else 0) for p, s in paths.items() for y in range(G.L)}
    z = np.logaddexp.reduce(list(paths.values()))
    post, moves = np.zeros((n, G.L)), np.zeros((G.L, G.L))
    for p, s in paths.items():
        for t, y in enumerate(p):
            post[t, y] += np.exp(s - z)
        for a, b in zip(p, p[1:]):
            moves[a, b] += np.exp(s - z)
    return post, z, moves


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 5, 1, 4])
    emit, move = rng.normal(size=(13, G.L)), rng.normal(size=(G.L, G.L))
    post, logz, moves = G.marginals(emit, move, lengths)
    at, total = 0, 0
    for k, n in enumerate(lengths):
        p, z, m = brute_posterior(emit[at : at + n], move)
        assert np.allclose(post[at : at + n], p) and np.isclose(logz[k] + np.log(G.L), z)
        total = total + m
        at += n
    assert np.allclose(moves, total)


def test_held_out_sentences(model):
    tests = {"en": "We define the graph first and return to the table later.", "fr": "On définit d'abord le graphe et on revient au tableau plus tard.",
             "de": "Zuerst wird der Graph definiert und später kehren wir zur Tabelle zurück.", "vi": "Trước hết ta định nghĩa đồ thị và sau đó quay lại bảng."}
    got = G.Tagger(model).describe(list(tests.values()))
    assert [G.LANGS[int(np.argmax(d[: G.L]))] for d in got] == list(tests)


def test_foreign_terms_do_not_count_and_segments_do(model):
    t = G.Tagger(model)
    d = t.describe([SAMPLES["vi"][:-1] + " (tiếng Anh: memory summary)."])[0]
    assert d[0] == sum(d[: G.L])
    both = SAMPLES["en"] + "\n" + SAMPLES["de"]
    segments = t.segments(both)
    assert [s[2] for s in segments] == ["en", "de"] and both[segments[1][0] : segments[1][1]] == SAMPLES["de"]
    assert all(0.5 < s[3] <= 1 for s in segments)


def test_windows_do_not_change_long_texts(model):
    t = G.Tagger(model)
    long = " ".join([SAMPLES["fr"]] * 60)
    d = t.describe([long, "", "12 34", SAMPLES["en"]])
    assert d[0][2] == sum(d[0][: G.L]) and sum(d[1]) == 0 == sum(d[2]) and d[3][1] > 0
    assert G.train([]).weights.shape == (G.DIM, G.L)


def test_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("EN",), ("vi_VN",), (" fr-FR ",), ("Mixed",), ("xx9",), ("",), (None,), ("unknown",)], "l string")
    assert [r.c for r in df.select(G.label_code(F.col("l")).alias("c")).collect()] == ["en", "vi", "fr", "mixed", None, None, None, None]


def test_irregular_rows(spark, model):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, " ", None, 1), (3, SAMPLES["en"], "EN", 1), (4, SAMPLES["en"], "fr", 1), (4, SAMPLES["en"], "fr", 1), (5, SAMPLES["vi"] + "\n" + SAMPLES["en"], "vi", 1), (6, "1 2 3", None, 1), (7, SAMPLES["de"], None, 1)], "doc_id bigint, text string, lang string, total int")
    metas = spark.createDataFrame([("d", "vi"), ("d", "fr"), ("e", "fr"), (None, None)], "document_id string, language string")
    chunks = spark.createDataFrame([("c", "??", SAMPLES["fr"])], "chunk_id string, language string, content string")
    secs = spark.createDataFrame([("d", 0, SAMPLES["vi"]), ("d", 0, SAMPLES["vi"]), ("d", 1, None)], "document_id string, ord int, content string")
    got = {tuple(r) for r in G.mislabelled(G.label_rows(docs, metas, chunks, secs, model)).collect()}
    assert got == {("documents", "4", "en"), ("documents", "5", "mixed"), ("documents", "7", "de"), ("chunks", "c", "fr"), ("documents_meta", "d", "vi")}
    e = [x.limit(0) for x in (docs, metas, chunks, secs)]
    assert G.mislabelled(G.label_rows(*e, G.fit(e[0]))).count() == 0


def test_sample_is_even_and_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(G, "train", lambda samples, **_: samples)
    monkeypatch.setattr(G, "FIT_ROWS", 80)
    rows = [(f"{SAMPLES[k]} {i}", k.upper() if i % 2 else k) for k, n in (("en", 400), ("fr", 15), ("de", 60)) for i in range(n)] + [(" ", "en"), (None, "en"), ("x", "??"), (SAMPLES["en"] * 400, "vi-VN")]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = G.fit(df.repartition(1))
    assert got == G.fit(df.repartition(6, "text"))
    assert {k: sum(x == k for _, x in got) for k in G.LANGS} == {"vi": 1, "en": 20, "fr": 15, "de": 20}
    assert max(len(t) for t, _ in got) == G.FIT_CHARS
    assert G.fit(df.limit(0)) == []
