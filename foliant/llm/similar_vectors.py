"""Problem 2: the k most similar vectors of every vector.

A hierarchical k-means tree per model: its upper levels are fitted on at most
``fit_rows`` vectors (those with the smallest hashes); leaves that hold more
than ``leaf_rows`` of all rows are split further, level by level, each by a
task that sees a bounded sample of the leaf's own rows, until leaves are small
or the tree has ``most_leaves``.  So leaves do not grow with the data up to
``most_leaves * leaf_rows`` vectors a model.  The tree is broadcast (bounded:
at most ``1.1 * most_leaves`` centres), and every vector is put into a leaf.

A query walks the tree best bin first: a priority queue holds the open nodes
by the greatest similarity that a leaf below can have, and the best is opened
next, until ``visits`` leaves were met.  With such keys leaves leave the queue
in the order of their own similarity, so for a batch of queries the outcome of
the queue is computed by one matrix product (``Tree.nearest``); the queue
itself is ``Tree.visit``, and both give the same leaves.  ``visits`` is
calibrated: for at most ``probes`` vectors the true neighbours are found by
brute force over all rows, and visits are widened until their mean recall
reaches ``recall``.

Leaves are gathered into parts of about ``part_rows`` vectors (a leaf above
that is cut into blocks, each in a part of its own), and a query is sent once
to each part it visits, so a part is one task with matrix products.  Parts
that many queries visit are salted by the visits seen in the fitted sample.
Where queries visit most parts, parts and their queries are gathered up to four
at a time, so that fewer copies are sent.

The search goes in rounds, each for a share of the queries, so that a round
sends about one copy of the index and half as many queries, however many parts
a query visits.  Tables and shuffle files are deleted when the next step has
its own, so disk holds a few copies of the vectors at a time.

Equal unit vectors are one class in all of this, so a group of copies of any
size is indexed and searched once and expanded only to its own rows.

Defined results: a row is usable if its vector has exactly ``dimension``
finite elements, not all zero; others have no neighbours and are nobody's.
Repeated rows count once; of an id with several vectors of one model the
smallest vector counts.  Equal similarities are ranked by the smaller id.
Fewer than k others give fewer neighbours; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import discard, written

LEAST = 0.88  # similarity of pairs


@dataclass(frozen=True)
class TreePolicy:
    """Bounds and targets; see the module."""

    k: int = 10
    fit_rows: int = 20_000
    probes: int = 256
    recall: float = 0.96
    leaf_rows: int = 150
    branches: int = 16
    most_leaves: int = 65_536
    part_rows: int = 32_768
    part_queries: int = 16_384
    round_rows: int = 1_000_000


@dataclass
class Tree:
    """Nodes of a model's tree; ``leaf[i]`` is -1 for inner nodes."""

    centres: list = field(default_factory=list)
    children: list = field(default_factory=list)
    leaf: list = field(default_factory=list)
    leaves: int = 0
    matrix: np.ndarray | None = None
    slack: np.ndarray | None = None

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def close(self) -> Tree:
        """Number the leaves and measure the nodes: ``slack`` is the greatest
        angle between a node and a leaf below it."""
        nodes = np.array(self.centres, np.float32)
        below: list = [None] * len(nodes)
        self.slack, self.leaves = np.zeros(len(nodes), np.float32), 0
        flat: list = []
        for n in range(len(nodes) - 1, -1, -1):  # children come after their parents
            below[n] = [x for c in self.children[n] for x in below[c]] or [n]
            self.slack[n] = np.arccos(np.clip((nodes[below[n]] @ nodes[n]).min(), -1, 1)) if self.children[n] else 0
        for n in range(len(nodes)):
            self.leaf[n] = -1
        for n in below[0] if len(nodes) else []:  # neighbours in the tree get neighbouring numbers
            self.leaf[n] = self.leaves
            self.leaves += 1
            flat.append(n)
        self.matrix = nodes[flat]
        return self

    def visit(self, q: np.ndarray, limit: int) -> list[list[int]]:
        """For each query, leaves best bin first, at most ``limit``."""
        nodes = np.array(self.centres, np.float32)
        out = []
        for row in np.clip(q @ nodes.T, -1, 1):
            hope = np.cos(np.maximum(np.arccos(row) - self.slack, 0))
            queue, found = [(0.0, 0, 0)], []
            while queue and len(found) < limit:
                node = heapq.heappop(queue)[2]
                if self.leaf[node] >= 0:
                    found.append(self.leaf[node])
                for c in self.children[node]:  # equal keys: inner nodes first, then by number
                    heapq.heappush(queue, (-float(row[c] if self.leaf[c] >= 0 else hope[c] + 1e-6), self.leaf[c], c))
            out.append(found)
        return out

    def nearest(self, q: np.ndarray, limit: int) -> np.ndarray:
        """The same leaves for a batch, best first (one row a query)."""
        n = min(limit, self.leaves)
        out = np.empty((len(q), n), np.int32)
        for at in range(0, len(q), 1024):
            sim = q[at : at + 1024] @ self.matrix.T
            if n == 1:
                out[at : at + 1024, 0] = sim.argmax(1)
                continue
            best = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n < self.leaves else np.tile(np.arange(n), (len(sim), 1))
            out[at : at + 1024] = np.take_along_axis(best, np.argsort(-np.take_along_axis(sim, best, 1), axis=1, kind="stable"), 1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``k`` clusters by direction; empty ones leave."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        a = (x @ c.T).argmax(1)
        order = np.argsort(a, kind="stable")
        first = np.flatnonzero(np.diff(a[order], prepend=-1))
        s = np.add.reduceat(x[order], first)
        empty = k - len(first)
        c = _unit(np.concatenate((s, x[rng.choice(len(x), empty)]))) if empty else _unit(s)
    return c[np.unique((x @ c.T).argmax(1))]


def _branches(rows: float, sampled: int, policy: TreePolicy) -> int:
    return min(policy.branches, math.ceil(rows / policy.leaf_rows), sampled // 8)


def fit(x: np.ndarray, rows: int, policy: TreePolicy) -> Tree:
    """A tree for ``rows`` vectors from the sample ``x`` of them."""
    rng = np.random.default_rng(0)
    tree = Tree()
    todo = deque([(tree.add(_unit(x.mean(0, keepdims=True))[0]), x)])
    scale = rows / len(x)
    while todo:
        node, own = todo.popleft()
        k = _branches(len(own) * scale, len(own), policy)
        if k < 2:
            continue
        c = _kmeans(own, k, rng)
        if len(c) < 2:
            continue
        a = (own @ c.T).argmax(1)
        for i in range(len(c)):
            child = tree.add(c[i])
            tree.children[node].append(child)
            todo.append((child, own[a == i]))
    return tree.close()


def _grown(tree: Tree, split: dict[int, np.ndarray]) -> Tree:
    """The tree with centres added below some of its leaves."""
    for node in [n for n in range(len(tree.leaf)) if tree.leaf[n] in split]:
        for c in split[tree.leaf[node]]:
            tree.children[node].append(tree.add(c))
    return tree.close()


def refine(classes: DataFrame, trees: dict, policy: TreePolicy, sampled: int = 2_048, rounds: int = 8) -> tuple[dict, DataFrame]:
    """The trees with large leaves split, and all rows in their leaves.

    Leaves that hold more than twice ``leaf_rows`` are split in one task each,
    which sees about ``sampled`` of the leaf's rows; the new centres are at
    most ``most_leaves`` a tree.  Trees that are fine are left as they are."""
    spark = classes.sparkSession
    placed = None
    for turn in range(rounds + 1):
        if placed is not None:
            discard(placed)
        placed = written([_in_leaves(classes, spark.sparkContext.broadcast(trees))], "leaves")
        if turn == rounds:
            break
        counts = placed.groupBy("model", "dim", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * policy.leaf_rows)
        room = {s: policy.most_leaves - t.leaves for s, t in trees.items()}
        large = [r for r in counts.orderBy(F.desc("n")).limit(policy.most_leaves).collect() if room[r.model, r.dim] > 0]  # bounded by the leaves of a tree
        if not large:
            break
        sizes = spark.sparkContext.broadcast({(r.model, r.dim, r.leaf): r.n for r in large})
        share = F.broadcast(spark.createDataFrame([(r.model, r.dim, r.leaf, min(1.0, sampled / r.n)) for r in large], "model string, dim int, leaf int, share double"))
        some = placed.join(share, ["model", "dim", "leaf"]).where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).drop("share")

        def centres(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            m, dim, leaf = (k.as_py() for k in key)
            x = _matrix(table.column("vec"), dim)
            k = _branches(sizes.value[m, dim, leaf], len(x), policy)
            c = _kmeans(x, k, np.random.default_rng(leaf)) if k >= 2 else x[:0]
            return pa.table([pa.array([m] * len(c), pa.string()), pa.array([dim] * len(c), pa.int32()), pa.array([leaf] * len(c), pa.int32()), pa.array([v.tobytes() for v in c], pa.binary())], names=["model", "dim", "leaf", "centre"])

        made = defaultdict(lambda: defaultdict(list))
        new = written([some.groupBy("model", "dim", "leaf").applyInArrow(centres, "model string, dim int, leaf int, centre binary")], "centres")
        for r in sorted(new.collect()):  # bounded by the leaves of a tree
            made[r.model, r.dim][r.leaf].append(np.frombuffer(r.centre, np.float32))
        discard(new)
        grew = False
        for space, by_leaf in made.items():
            split = {}
            for leaf, cs in by_leaf.items():
                if len(cs) >= 2 and room[space] >= len(cs) - 1:
                    split[leaf] = cs
                    room[space] -= len(cs) - 1
            if split:
                trees[space] = _grown(trees[space], split)
                grew = True
        if not grew:
            break
    return trees, placed


def usable(rows: DataFrame) -> DataFrame:
    """``(model, chunk_id, vector)`` of the rows that count, once each."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        rows.where((F.size("vector") == F.col("dimension")) & finite & F.exists("vector", lambda x: x != 0))
        .where(F.col("chunk_id").isNotNull() & F.col("model").isNotNull())
        .groupBy("model", "chunk_id").agg(F.min("vector").alias("vector"))
    )


def _classes(rows: DataFrame) -> DataFrame:
    """``(model, dim, chunk_id, cid, vec)``: unit vectors and their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = b.take(pa.array(np.flatnonzero(lengths == dim)))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                raw = [v.tobytes() for v in (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)]
                names = [f"{m}|".encode() for m in part.column(0).to_pylist()]
                cids = [int.from_bytes(hashlib.blake2b(m + u, digest_size=8).digest(), "little", signed=True) for m, u in zip(names, raw)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([dim] * len(raw), pa.int32()), part.column(1), pa.array(cids, pa.int64()), pa.array(raw, pa.binary())], names=["model", "dim", "chunk_id", "cid", "vec"])

    return rows.select("model", "chunk_id", "vector").mapInArrow(run, "model string, dim int, chunk_id string, cid bigint, vec binary")


def _matrix(column, dim: int) -> np.ndarray:
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), dim)


def _by_space(batch: pa.RecordBatch):
    """Row numbers of each ``(model, dim)`` of a batch."""
    spaces = defaultdict(list)
    for i, s in enumerate(zip(batch.column("model").to_pylist(), batch.column("dim").to_pylist())):
        spaces[s].append(i)
    return spaces.items()


def _in_leaves(classes: DataFrame, trees) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (m, dim), own in _by_space(b):
                part = b.take(pa.array(own))
                leaves = trees.value[m, dim].nearest(_matrix(part.column("vec"), dim), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*part.select(["model", "dim", "cid", "vec"]).columns, pa.array(leaves, pa.int32())], names=["model", "dim", "cid", "vec", "leaf"])

    return classes.select("model", "dim", "cid", "vec").mapInArrow(run, "model string, dim int, cid bigint, vec binary, leaf int")


def _calibrate(index: DataFrame, samples: dict, trees: dict, policy: TreePolicy) -> dict:
    """Leaves to visit in each space, from brute force for a few vectors."""
    spark = index.sparkSession
    probes = spark.sparkContext.broadcast({s: (ids[: policy.probes], x[: policy.probes]) for s, (ids, x) in samples.items()})
    k = policy.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (m, dim), own in _by_space(b):
                part = b.take(pa.array(own))
                ids, q = probes.value[m, dim]
                cid = part.column("cid").to_numpy(zero_copy_only=False)
                leaf = part.column("leaf").to_numpy(zero_copy_only=False)
                sim = q @ _matrix(part.column("vec"), dim).T
                sim[ids[:, None] == cid[None, :]] = -2
                n = min(k, sim.shape[1])
                best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                qs = np.repeat(np.arange(len(ids)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(qs)), pa.array([dim] * len(qs), pa.int32()), pa.array(qs, pa.int32()), pa.array(leaf[best].ravel(), pa.int32()),
                     pa.array(np.take_along_axis(sim, best, 1).ravel(), pa.float32())], names=["model", "dim", "q", "leaf", "sim"])

    near = index.mapInArrow(run, "model string, dim int, q int, leaf int, sim float").where("sim > -2")
    rank = F.row_number().over(Window.partitionBy("model", "dim", "q").orderBy(F.desc("sim"), "leaf"))
    ranks = defaultdict(list)
    visits = {}
    order = {s: np.argsort(t.nearest(samples[s][1][: policy.probes], t.leaves), axis=1) for s, t in trees.items()}  # place of each leaf
    for r in near.withColumn("rank", rank).where(F.col("rank") <= k).select("model", "dim", "q", "leaf").collect():  # at most k rows a probe
        ranks[r.model, r.dim].append(order[r.model, r.dim][r.q, r.leaf])
    for s, t in trees.items():
        met = np.sort(ranks[s]) if ranks[s] else np.array([0])
        visits[s] = int(met[min(len(met) - 1, math.ceil(policy.recall * len(met)) - 1)]) + 1
    return visits


def _parts(counts: list, seen: dict, sizes: dict, rows: int) -> tuple[dict, list[int], list[float]]:
    """``(space, leaf)`` to its first part and number of blocks: runs of leaves
    of about ``rows`` vectors, large leaves in blocks.  And of each part its
    vectors and expected queries, from the leaves ``seen`` in each space."""
    parts_of: dict = {}
    held: list[int] = []
    last = None
    for r in counts:
        s = (r.model, r.dim)
        blocks = math.ceil(r.n / rows)
        if blocks > 1 or s != last or held[-1] + r.n > rows:
            held.append(0)
        parts_of[s, r.leaf] = (len(held) - 1, blocks)
        held += [0] * (blocks - 1)
        if blocks > 1:
            held[-blocks:] = [rows] * blocks
        else:
            held[-1] += r.n
        last = s
    met = [0.0] * len(held)
    for s, found in seen.items():
        for leaves in found:
            for p, blocks in {parts_of[s, v] for v in leaves if (s, v) in parts_of}:
                for j in range(blocks):
                    met[p + j] += sizes[s] / len(found)
    return parts_of, held, met


def nearest(rows: DataFrame, policy: TreePolicy = TreePolicy(), least: float = -2.0) -> tuple[DataFrame, DataFrame]:
    """``members (model, chunk_id, cid)`` and ``near (cid, other, sim)``: for
    each class the k + 2 most similar other classes that were found, without
    those below ``least``."""
    spark = rows.sparkSession
    base = written([_classes(usable(rows))], "unit-vectors")
    members = written([base.select("model", "chunk_id", "cid")], "vector-members")
    classes = written([base.groupBy("model", "dim", "cid").agg(F.first("vec").alias("vec"))], "vector-classes")
    discard(base)
    sizes = {(r.model, r.dim): r.n for r in classes.groupBy("model", "dim").agg(F.count("*").alias("n")).collect()}
    # by hash, from the counts: no task ranks a model; the cut is exact and on the driver
    space = F.concat_ws("|", "model", F.col("dim").cast("string"))
    share = F.create_map(*(x for (m, dim), n in sizes.items() for x in (F.lit(f"{m}|{dim}"), F.lit(min(1.0, 1.1 * policy.fit_rows / n + 64 / n))))) if sizes else None
    if share is None:
        return members, spark.createDataFrame([], "cid bigint, other bigint, sim float")
    hashed = classes.withColumn("draw", F.pmod(F.xxhash64("cid"), F.lit(1 << 40)))
    drawn = hashed.where(F.col("draw") < F.element_at(share, space) * (1 << 40)).toPandas().sort_values(["draw", "cid"])
    samples = {}
    for (m, dim), g in drawn.groupby(["model", "dim"], sort=False):
        g = g.head(policy.fit_rows)
        samples[m, int(dim)] = (g["cid"].to_numpy(), _matrix(g["vec"], int(dim)))
    trees, index = refine(classes, {s: fit(x, sizes[s], policy) for s, (_, x) in samples.items()}, policy)
    discard(classes)
    shared = spark.sparkContext.broadcast(trees)
    visits = _calibrate(index, samples, trees, policy)

    counts = index.groupBy("model", "dim", "leaf").agg(F.count("*").alias("n")).orderBy("model", "dim", "leaf").collect()  # at most most_leaves rows a space
    seen = {s: trees[s].nearest(x[:2_048], visits[s]).tolist() for s, (_, x) in samples.items()}
    total, gathered = sum(sizes.values()), 1
    while True:
        parts_of, held, met = _parts(counts, seen, sizes, gathered * policy.part_rows)
        if gathered == 4 or sum(met) <= 8 * total or len(held) < 4 * spark.sparkContext.defaultParallelism:
            break
        gathered *= 2
    queries = gathered * policy.part_queries
    copies = sum(n * max(1, math.ceil(m / queries)) for n, m in zip(held, met))
    rounds = math.ceil(copies / total) if copies + sum(met) > max(2 * total, policy.round_rows) else 1
    salts = [max(1, round(m / queries / rounds) if rounds > 1 else math.ceil(m / queries)) for m in met]
    places = F.broadcast(spark.createDataFrame([(*s, leaf, first, salts[first : first + blocks]) for (s, leaf), (first, blocks) in parts_of.items()], "model string, dim int, leaf int, first int, salts array<int>"))
    where = {}  # of each space, by leaf: first part and blocks, an empty leaf has none
    for (s, leaf), place in parts_of.items():
        where.setdefault(s, np.zeros((2, trees[s].leaves), np.int64))[:, leaf] = place
    plan = spark.sparkContext.broadcast((where, np.array(salts, np.int64), visits))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, once in each part they visit, with the leaves there."""
        where, salt_of, limit = plan.value
        for b in (x.slice(at, 2_048) for x in batches for at in range(0, x.num_rows, 2_048)):
            for s, own in _by_space(b):
                q = b.take(pa.array(own))
                cids = q.column("cid").to_numpy(zero_copy_only=False)
                leaves = shared.value[s].nearest(_matrix(q.column("vec"), s[1]), limit[s])
                first, blocks = where[s]
                who = np.repeat(np.arange(len(q)), leaves.shape[1])
                nth = np.tile(np.arange(leaves.shape[1]), len(q))
                flat = leaves.ravel()
                times = blocks[flat]  # an empty leaf is in no part, a cut one in several
                who, nth, leaf = np.repeat(who, times), np.repeat(nth, times), np.repeat(flat, times)
                part = first[leaf] + (np.arange(len(leaf)) - np.repeat(np.cumsum(times) - times, times))
                by = np.lexsort((nth, part, who))
                who, part, leaf = who[by], part[by], leaf[by]
                new = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                ends = np.append(new, len(leaf)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[new].astype(np.int32)), pa.array(((cids[who[new]] >> 7) // rounds % salt_of[part[new]]).astype(np.int32)), *q.take(pa.array(who[new])).select(["cid", "vec"]).columns, lists],
                    names=["part", "salt", "cid", "vec", "leaves"])

    keep = policy.k + 2
    floor = max(np.float32(-2), np.nextafter(np.float32(least), np.float32(-3)))  # finds must be above

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        names = ["cid", "other", "sim"]
        if not x.num_rows or not q.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float32()))], names=names)
        dim = x.column("dim")[0].as_py()
        xs, qs = _matrix(x.column("vec"), dim), _matrix(q.column("vec"), dim)
        xc, qc, leaf = x.column("cid").to_numpy(), q.column("cid").to_numpy(), x.column("leaf").to_numpy()
        rows_of = {int(leaf[r[0]]): r for r in np.split(np.argsort(leaf, kind="stable"), np.flatnonzero(np.diff(np.sort(leaf))) + 1)}
        lists = q.column("leaves").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        asked, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(qc)), lengths)
        nth = np.arange(len(asked)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # the best so far of each query; a leaf touches only queries it improves,
        # which are few once the nearest leaves of all have been seen
        top = np.full((len(qc), keep), floor, np.float32)
        at_row = np.zeros((len(qc), keep), np.int64)
        for near in (nth < 4, nth >= 4):
            some, of = asked[near], who[near]
            order = np.argsort(some, kind="stable")
            some, of = some[order], of[order]
            bounds = np.append(np.flatnonzero(np.diff(some, prepend=-1)), len(some))
            for a, z in zip(bounds, bounds[1:]):
                rows_ = rows_of[int(some[a])]
                for begin in range(a, z, 2048):
                    w = of[begin : min(z, begin + 2048)]
                    sim = qs[w] @ xs[rows_].T
                    better = sim.max(1) > top[w, 0]
                    w, sim = w[better], sim[better]
                    if not len(w):
                        continue
                    own_row, own_column = np.nonzero(qc[w][:, None] == xc[rows_][None, :])
                    sim[own_row, own_column] = -2
                    n = min(keep, len(rows_))
                    best = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n < len(rows_) else np.tile(np.arange(n), (len(w), 1))
                    both = np.concatenate((top[w], np.take_along_axis(sim, best, 1)), axis=1)
                    which = np.concatenate((at_row[w], rows_[best]), axis=1)
                    chosen = np.argsort(-both, axis=1, kind="stable")[:, keep - 1 :: -1]  # the worst of the best goes first
                    top[w], at_row[w] = np.take_along_axis(both, chosen, 1), np.take_along_axis(which, chosen, 1)
        ok = top > floor
        ends = np.append(0, np.cumsum(ok.sum(1))).astype(np.int32)
        some = np.flatnonzero(np.diff(ends))
        ends = np.append(0, ends[some + 1]).astype(np.int32)
        others, sims = xc[at_row[ok]], top[ok]
        return pa.table([pa.array(qc[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(others)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sims, pa.float32()))], names=names)

    # index rows in their part, once for each salt
    block = F.pmod("cid", F.size("salts"))
    placed = index.join(places, ["model", "dim", "leaf"]).select(
        (F.col("first") + block).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.element_at("salts", (block + 1).cast("int")) - 1)).alias("salt"), "dim", "leaf", "cid", "vec")

    def found(turn: int) -> DataFrame:
        left = placed.groupBy("part", "salt")
        asking = index.where(F.pmod(F.shiftright("cid", 7), F.lit(rounds)) == turn)
        right = asking.mapInArrow(ask, "part int, salt int, cid bigint, vec binary, leaves array<int>").groupBy("part", "salt")
        partial = left.cogroup(right).applyInArrow(search, "cid bigint, other array<bigint>, sim array<float>")
        # a query has one list of at most ``keep`` finds for each part it visits
        lists = partial.groupBy("cid").agg(F.collect_list(F.arrays_zip((F.transform("sim", lambda x: -x)).alias("d"), "other")).alias("c"))
        best = F.slice(F.array_sort(F.flatten("c")), 1, keep)
        return lists.select("cid", F.explode(best).alias("f")).select("cid", F.col("f.other").alias("other"), (-F.col("f.d")).alias("sim")).where(F.col("sim") >= least)

    near = written((found(turn) for turn in range(rounds)), "near-vectors")
    discard(index)
    return members, near


def neighbours(members: DataFrame, near: DataFrame, k: int = 10, least: float = -2.0) -> DataFrame:
    """``(chunk_id, other, sim, rank)``: up to k others of every row, those
    below ``least`` left out after ranking."""
    first = F.row_number().over(Window.partitionBy("cid").orderBy("chunk_id"))
    ids = members.select("cid", "chunk_id").distinct().withColumn("n", first).where(F.col("n") <= k + 1)
    ids = written([ids.groupBy("cid").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))], "class-ids")
    own = ids.select("cid", F.col("ids"), F.lit(1.0).cast("float").alias("sim"))
    others = near.join(ids.withColumnRenamed("cid", "other"), "other").select("cid", "ids", "sim")
    # at most 1 + k + 2 lists of at most k + 1 ids a class
    lists = own.unionByName(others).groupBy("cid").agg(F.collect_list(F.struct((-F.col("sim")).alias("d"), "ids")).alias("c"))
    flat = F.array_sort(F.flatten(F.transform("c", lambda e: F.transform(e["ids"], lambda x: F.struct(e["d"].alias("d"), x.alias("id"))))))
    ranked = lists.select("cid", F.slice(flat, 1, 2 * k + 2).alias("c"))
    top = F.slice(F.filter("c", lambda e: e["id"] != F.col("chunk_id")), 1, k)
    return members.join(ranked, "cid").select("model", "chunk_id", F.posexplode(top)).select(
        "model", "chunk_id", F.col("col.id").alias("other"), (-F.col("col.d")).alias("sim"), (F.col("pos") + 1).alias("rank")
    ).where(F.col("sim") >= least)


def pairs(found: DataFrame, least: float = LEAST) -> DataFrame:
    """Unordered pairs at or above ``least`` with one among the other's nearest."""
    return found.where(F.col("sim") >= least).select(
        F.least("chunk_id", "other").alias("chunk_a"), F.greatest("chunk_id", "other").alias("chunk_b")).distinct()
