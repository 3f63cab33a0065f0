from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import near_duplicates as D


def corpus(n, seed=0):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(500)}"
            if rng.random() < 0.2:
                w = w[5:] + w[:5]
        else:
            w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(4, 60))]
        texts.append(" ".join(w))
    return texts


def brute(rows, words, threshold):
    sets = []
    for k, t in rows:
        w = D.WORD.findall((t or "").lower())
        sets.append((k, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}))
    return {(min(a, b), max(a, b)) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if a != b and s and t and len(s & t) >= threshold * len(s | t)}


def found(spark, rows, words=3, threshold=0.5, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], "chunk_id string, content string, n int")
    members, links = D.near_duplicates(df, words=words, threshold=threshold, **more)
    return {tuple(r) for r in D.pairs_of_records(members, links, "chunk_id").collect()}, members, links


def test_against_brute_force(spark):
    rows = [(f"c{i:03d}", t) for i, t in enumerate(corpus(300))]
    want = brute(rows, 3, 0.5)
    got, members, links = found(spark, rows)
    assert got <= want and len(got) >= 0.97 * len(want)
    groups = {r.chunk_id: r.group_id for r in D.groups(members, links, "chunk_id").collect()}
    assert all(groups[a] == groups[b] for a, b in got)


def test_large_buckets_are_compared_in_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        w[i % 60] = f"y{i}"
        rows.append((f"c{i:02d}", " ".join(w)))
    rows += [(f"z{i}", t) for i, t in enumerate(corpus(40, 5))]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    made = D.sketches(df, "chunk_id", "content", 3)
    classes = made.groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "regs", "text")))
    pairs = lambda **more: {(r.a, r.b) for r in D.verify(D.candidates(classes, 0.5, **more), classes, 0.5, 3).collect()}
    large = pairs(block=10_000)
    assert pairs(block=7) >= large and len(large) >= 60 * 59 / 2


def test_boilerplate_is_banded_again(spark):
    rng = random.Random(4)
    shared = " ".join(f"b{k}" for k in range(26))
    rows = [(f"c{i:03d}", shared + " " + " ".join(f"o{i}x{k}" for k in range(36))) for i in range(150)]
    for i in range(0, 150, 3):
        w = rows[i][1].split()
        w[rng.randrange(30, 60)] = "new"
        rows.append((f"d{i:03d}", " ".join(w)))
    classes = D.sketches(spark.createDataFrame(rows, "chunk_id string, content string"), "chunk_id", "content", 3).groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "regs", "text")))
    got = {n: {(r.a, r.b) for r in D.verify(D.candidates(classes, 0.5, block=4, huge=n), classes, 0.5, 3).collect()} for n in (5, 16_384)}
    assert D._sized(D.band_keys(classes), None).where("size > 5").count() > 0
    assert got[5] == got[16_384] and len(got[5]) == 50


def test_hot_bands_take_another_way(spark, monkeypatch):
    monkeypatch.setattr(D, "_SAMPLE", 2)
    rows = [("c%03d" % i, " ".join([f"w{k}" for k in range(40)] + [f"u{i}"])) for i in range(80)] + [(f"z{i}", t) for i, t in enumerate(corpus(80, 6))]
    classes = D.sketches(spark.createDataFrame(rows, "chunk_id string, content string"), "chunk_id", "content", 3).groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "regs", "text")))
    keyed = D.band_keys(classes)
    hot = D._hot_bands(keyed)
    assert hot.count() > 0
    rows_of = lambda df: sorted(tuple(r) for r in df.select("band", "sig", "size").collect())
    assert rows_of(D._sized(keyed, hot).where("size > 1")) == rows_of(D._sized(keyed, None))


def test_estimate_is_near_the_similarity():
    s = D.Shingler(1)
    errors = []
    for k in range(20):
        a = " ".join(f"w{i}" for i in range(100))
        b = " ".join(f"w{i}" for i in range(k * 5, 100 + k * 5))
        owner, h = s([a, b])
        r = D.registers(owner, h, 2)
        est = D.estimate(r[:1], r[1:], np.array([100]), np.array([100]))[0]
        errors.append(est - (100 - k * 5) / (100 + k * 5))
    assert max(map(abs, errors)) < 0.12 and abs(sum(errors) / 20) < 0.03


def test_irregular_rows(spark):
    rows = [("a", None), ("b", ""), ("c", "one two"), ("d", "one two three"), ("e", "One, two: THREE!"), ("e", "One, two: THREE!"), (None, "one two three"), ("f", "x " * 50_000), ("g", "x " * 49_000), ("h", "é b c"), ("i", "é b c")]
    got, _, _ = found(spark, rows)
    assert {p for p in got if None not in p} == {("d", "e"), ("f", "g"), ("h", "i")}
    assert found(spark, [])[0] == set()
    assert found(spark, [("only", "one two three four")])[0] == set()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)] + [(100, 101, 1.0)], "a bigint, b bigint, similarity double")
    got = {r.sig: r.root for r in D.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[101] == 100
