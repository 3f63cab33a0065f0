from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from foliant.operators import references as R

T0 = datetime(2024, 1, 1)
REFS = "target string, key string, t timestamp, src_table string, src_field string, src_key string"


def brute(refs, vers):
    out = []
    for target, key, t, _, _, src in refs:
        mine = [(a, b) for g, k, a, b in vers if (g, k) == (target, key)]
        if t is not None and any(a is not None and a <= t and (b is None or b > t) for a, b in mine):
            kind = None
        elif not mine:
            kind = "missing"
        elif t is not None and all(a is not None and a > t for a, _ in mine):
            kind = "late"
        else:
            kind = "deleted"
        out.append((src, kind))
    return sorted(out, key=str)


def frames(spark, refs, vers):
    from pyspark.sql import functions as F

    r = spark.createDataFrame(refs, REFS)
    v = spark.createDataFrame(vers, "target string, key string, a timestamp, b timestamp").select(
        "target", "key", F.unix_micros("a").alias("start"), F.coalesce(F.unix_micros("b"), F.lit(R.FOREVER)).alias("stop"))
    return r, v


@pytest.mark.parametrize("policy", [
    R.SkewPolicy(), R.SkewPolicy(heavy_share=0.01, heavy_rows=5), R.SkewPolicy(heavy_share=0.01, heavy_rows=5, broadcast_steps=4, salts=3), R.SkewPolicy(heavy_share=0.01, heavy_rows=5, broadcast_steps=0)])
def test_all_paths_agree_with_brute_force(spark, policy):
    rng = random.Random(7)
    when = lambda: T0 + timedelta(hours=rng.randrange(200), minutes=rng.randrange(3))
    keys = ["hot"] * 60 + [f"k{i}" for i in range(30)]
    refs = [("x", rng.choice(keys), when() if rng.random() > 0.05 else None, "s", "f", f"r{i}") for i in range(300)]
    vers = []
    for k in [*set(keys[:80]), "hot", "hot", "hot", "hot", "hot"]:
        a = when() if rng.random() > 0.1 else None
        vers.append(("x", k, a, (a or T0) + timedelta(hours=rng.randrange(1, 60)) if rng.random() > 0.3 else None))
    r, v = frames(spark, refs, vers)
    got = sorted(((x.src_key, x.kind) for x in R.resolve(r, v, policy).collect()), key=str)
    assert got == brute(refs, vers)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(R.report(R.resolve(R.counted(r.unionByName(r)), v, policy))) == rows(R.report(R.resolve(r.unionByName(r), v, policy)))


def test_keys_and_irregular_rows(spark):
    chunks = spark.createDataFrame(
        [("c1", " D1\t", T0, None, 1), ("c2", "", T0, None, 2), ("c3", None, T0, None, 3), ("c1", " D1\t", T0, None, 1), (None, "d1", None, None, 4)],
        "chunk_id string, document_id string, created_at timestamp, deleted_at timestamp, kind int")
    maps = spark.createDataFrame([("C1 ", None, T0), (None, "l1", T0), ("c9", "L1", T0)], "chunk_id string, lo_id string, mapped_at timestamp")
    metas = spark.createDataFrame([("d1", T0, None)], "document_id string, created_at timestamp, deleted_at timestamp")
    los = spark.createDataFrame([("l1", T0 + timedelta(days=1), None)], "lo_id string, created_at timestamp, deleted_at timestamp")
    found = R.unresolved(R.resolve(R.references(chunks, maps), R.versions(metas, chunks, los)))
    rows = {tuple(r) for r in found.collect()}
    assert rows == {
        ("chunks", "document_id", "c2", "missing", "2024-01"), ("chunks", "document_id", None, "deleted", None),
        ("chunk_lo_mappings", "chunk_id", "c9|l1", "missing", "2024-01"),
        ("chunk_lo_mappings", "lo_id", "|l1", "late", "2024-01"), ("chunk_lo_mappings", "lo_id", "c9|l1", "late", "2024-01")}
    assert found.count() == len(rows)


def test_empty_tables(spark):
    r, v = frames(spark, [], [])
    assert R.unresolved(R.resolve(r, v)).count() == 0
    assert R.report(R.resolve(r, v)).count() == 0
