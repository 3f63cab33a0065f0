from __future__ import annotations

import time
from pathlib import Path

import numpy as np

from foliant import session
from foliant.llm import similar_vectors as V

COLS = "chunk_id string, vector array<float>, model string, dimension int, sim int"


def data(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)


def run(spark, rows, policy=V.TreePolicy()):
    members, near = V.nearest(spark.createDataFrame(rows, COLS), policy)
    return V.neighbours(members, near, policy.k)


def brute(x, ids, k=10):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: {ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k] if j != i} for i in range(len(ids))}


def test_recall_against_brute_force(spark):
    x = data(1500, 16)
    ids = [f"c{i:05d}" for i in range(len(x))]
    policy = V.TreePolicy(leaf_rows=40, part_rows=300, part_queries=400, fit_rows=800, probes=128)
    got: dict = {}
    for r in run(spark, [(i, v.tolist(), "m", 16, 0) for i, v in zip(ids, x)], policy).collect():
        got.setdefault(r.chunk_id, set()).add(r.other)
    want = brute(x, ids)
    recall = np.mean([len(got.get(i, set()) & want[i]) / 10 for i in ids])
    assert recall >= 0.9 and all(len(v) == 10 and k not in v for k, v in got.items())


def test_copies_are_ranked_by_id(spark):
    x = data(60, 8, 3)
    rows = [(f"x{i:03d}", x[i].tolist(), "m", 8, 0) for i in range(60)] + [(f"copy{i:02d}", (x[0] * 4).tolist(), "m", 8, 0) for i in range(30)]
    got = run(spark, rows, V.TreePolicy(leaf_rows=10, part_rows=20)).collect()
    mine = sorted((r.rank, r.other) for r in got if r.chunk_id == "copy05")
    assert [o for _, o in mine] == [f"copy{i:02d}" for i in range(11) if i != 5]
    assert {r.other for r in got if r.chunk_id == "x000"} == {f"copy{i:02d}" for i in range(10)}


def test_irregular_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", [1.0, 0.0], "m", 2, 0), ("b", [0.9, 0.1], "m", 2, 0), ("b", [0.9, 0.1], "m", 2, 0), ("c", [1.0, 0.0], "other", 2, 0), ("d", None, "m", 2, 0), ("e", [1.0], "m", 2, 0), ("f", [0.0, 0.0], "m", 2, 0),
        ("g", [nan, 1.0], "m", 2, 0), ("h", [inf, 1.0], "m", 2, 0), ("i", [None, 1.0], "m", 2, 0), ("j", [1.0, 0.0], "m", None, 0), (None, [1.0, 0.0], "m", 2, 0), ("k", [1.0, 0.0], None, 2, 0), ("l", [1.0, 0.0, 0.0], "m", 3, 0)]
    got = {(r.chunk_id, r.other) for r in run(spark, rows).collect()}
    assert got == {("a", "b"), ("b", "a")}
    found = run(spark, rows)
    assert [tuple(r) for r in V.pairs(found).collect()] == [("a", "b")]
    assert run(spark, []).count() == 0


def test_queue_and_batch_meet_the_same_leaves():
    x = V._unit(data(900, 12, 7))
    tree = V.fit(x, 4000, V.TreePolicy(leaf_rows=60, branches=5))
    assert tree.leaves > 20 and sorted(v for v in tree.leaf if v >= 0) == list(range(tree.leaves))
    q = V._unit(data(80, 12, 8))
    for limit in (1, 7, tree.leaves):
        assert [list(map(int, v)) for v in tree.nearest(q, limit)] == tree.visit(q, limit)


def test_large_leaves_are_split_on_all_rows(spark):
    x = data(1200, 8, 5)
    ids = [f"c{i:05d}" for i in range(len(x))]
    rows = spark.createDataFrame([(i, v.tolist(), "m", 8, 0) for i, v in zip(ids, x)], COLS)
    policy = V.TreePolicy(leaf_rows=30, fit_rows=40, branches=4, part_rows=400, probes=64)
    classes = V._classes(V.usable(rows)).select("model", "dim", "cid", "vec")
    few = V.fit(V._unit(x[:40]), len(x), policy)
    trees = V.refine(classes, {("m", 8): few}, policy, sampled=200)[0]
    sizes = [r["count"] for r in V._in_leaves(classes, spark.sparkContext.broadcast(trees)).groupBy("leaf").count().collect()]
    assert sum(sizes) == len(x) and max(sizes) <= 120 and trees["m", 8].leaves > few.leaves // 2 and trees["m", 8].leaves >= 20
    bounded = V.refine(classes, {("m", 8): V.fit(V._unit(x[:40]), len(x), policy)}, V.TreePolicy(leaf_rows=30, fit_rows=40, branches=4, most_leaves=14), sampled=200)[0]
    assert bounded["m", 8].leaves <= 14
    got: dict = {}
    for r in run(spark, [(i, v.tolist(), "m", 8, 0) for i, v in zip(ids, x)], policy).collect():
        got.setdefault(r.chunk_id, set()).add(r.other)
    want = brute(x, ids)
    assert np.mean([len(got.get(i, set()) & want[i]) / 10 for i in ids]) >= 0.9


def test_rounds_find_the_same_and_leave_no_copies(spark, monkeypatch):
    x = data(1500, 16, 2)
    rows = spark.createDataFrame([(f"c{i:05d}", v.tolist(), "m", 16, 0) for i, v in enumerate(x)], COLS)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    turns: dict = {}

    def written(frames, label):
        frames = list(frames)
        turns.setdefault(label, []).append(len(frames))
        return session.written(frames, label)

    monkeypatch.setattr(V, "written", written)
    got = []
    for bound in (1_000_000, 0):
        policy = V.TreePolicy(leaf_rows=40, part_rows=300, part_queries=200, fit_rows=1500, probes=128, round_rows=bound)
        tables = set(shared.iterdir())
        members, near = V.nearest(rows, policy)
        assert {p.name.rpartition("-")[0] for p in set(shared.iterdir()) - tables} == {"vector-members", "near-vectors"}
        got.append({(r.chunk_id, r.other) for r in V.neighbours(members, near).collect()})
    assert turns["near-vectors"][0] == 1 and turns["near-vectors"][1] > 2
    assert got[0] == got[1] and len(got[0]) == 15_000


def test_shuffle_files_go_when_a_table_is_written(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    frames = (spark.range(1000).selectExpr(f"id % 7 + {n} AS k").groupBy("k").count() for n in range(3))
    table = session.written(frames, "counts")
    for _ in range(100):  # they are deleted behind the query
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and len(table.collect()) == 21


def test_pairs_need_only_the_similar(spark):
    x = data(600, 16, 4)
    rows = spark.createDataFrame([(f"c{i:05d}", v.tolist(), "m", 16, 0) for i, v in enumerate(x)], COLS)
    of = {least: V.nearest(rows, least=least) for least in (-2.0, V.LEAST)}
    found = [{tuple(r) for r in V.pairs(V.neighbours(members, near)).collect()} for members, near in of.values()]
    assert found[0] and found[0] == found[1]
    assert of[V.LEAST][1].agg({"sim": "min"}).first()[0] >= V.LEAST > of[-2.0][1].agg({"sim": "min"}).first()[0]
