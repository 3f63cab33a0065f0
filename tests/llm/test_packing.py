from __future__ import annotations

import random

import pytest

from foliant.llm import packing as P


@pytest.mark.parametrize("seed", range(10))
def test_windows_hold_every_item_once(seed):
    rng = random.Random(seed)
    sizes = [min(100, int(rng.expovariate(1 / 20))) for _ in range(rng.randrange(1, 300))]
    w = P.windows(sizes, 100)
    assert sorted(i for x in w for i in x) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in x) <= 100 for x in w)


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 50) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in P.differencing(sizes, 20)]
    assert max(sums) - min(sums) <= 3


def test_irregular_rows(spark):
    rows = [(1, 0), (2, None), (3, 5000), (4, 2048), (5, 2049), (5, 2049), (None, 7), (6, 4096)] + [(100 + i, i % 300) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    out = P.pack(df, "doc_id", "n_tokens", 2048, 100).toPandas()
    assert (out.groupby("container")["n"].sum() <= 2048).all()
    assert out["n"].sum() == sum(n or 0 for _, n in rows)
    assert sorted(out[out.doc_id == 3][["part_no", "first", "n"]].itertuples(index=False, name=None)) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert (out[out.doc_id == 6]["n"] == 2048).all() and len(out[out.doc_id == 6]) == 2
    assert len(out[out.doc_id == 4]) == 1 and len(out[out.doc_id == 1]) == 1
    used = out.groupby("container").agg(s=("n", "sum"), u=("used", "first"))
    assert (used["s"] == used["u"]).all()
    assert P.pack(df.limit(0), "doc_id", "n_tokens").count() == 0
    with pytest.raises(ValueError):
        P.pack(df, "doc_id", "n_tokens", 0)


def test_same_containers_whatever_the_layout(spark):
    rows = [(i % 400, i * 37 % 900) for i in range(900)] + [(7, 500)] * 700 + [(None, 3)] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    one = sorted(map(tuple, P.pack(df.repartition(1), "doc_id", "n_tokens", 2048, 200).fillna(-1).collect()))
    assert one == sorted(map(tuple, P.pack(df.repartition(7, "n_tokens"), "doc_id", "n_tokens", 2048, 200).fillna(-1).collect()))
    assert len(one) == len(rows) and len({r[4] >> 24 for r in one if r[0] == 7 and r[3] == 500}) > 3
