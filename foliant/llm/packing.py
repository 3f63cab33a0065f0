"""Problem 8: fill containers of fixed capacity with items, by differencing.

Items are dealt to groups of about ``group_items`` by a hash of key and size
(a bound on a task's work; the waste it costs is under one container a group),
so a rerun on another layout gives the same containers.  Repeated rows are
counted first and dealt ``COPIES`` at a time, so a repeated row is no skew.
In a group, multiway differencing merges the two partial partitions with the
widest spread, largest sums of one onto the smallest of the other, which ends
in windows of nearly equal sums; if one exceeds the capacity, the number of
windows rises by one.

Only an item larger than the capacity is divided: into full containers of its
own and a rest that is packed like any other item.

Defined results: null and empty texts are items of size 0 and are assigned to
a window too; repeated rows are packed each; rows with a null key are packed
like others; an empty table gives no containers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows of a group have ids below this.
STRIDE = 1 << 24
#: Copies of a row that are dealt together.
COPIES = 64


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers in ``k`` windows with sums as equal as the method makes them."""
    # a partial partition: its non-empty windows as sums, largest first, and
    # their nodes; a node is an item, or from len(sizes) on a pair of nodes
    n = len(sizes)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    made = 0
    items = np.array(sizes, np.int64)
    heap = [(-s, i, items[i : i + 1], np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        if len(a) < len(b):
            a, an, b, bn = b, bn, a, an
        over = len(a) + len(b) - k
        if over > 0:  # the smallest `over` of a receive the largest of b, in opposite order
            low = len(a) - over
            left[made : made + over], right[made : made + over] = an[low:][::-1], bn[:over]
            a, an = np.concatenate((a[:low], a[low:][::-1] + b[:over])), np.concatenate((an[:low], np.arange(n + made, n + made + over)))
            b, bn = b[over:], bn[over:]
            made += over
        sums, nodes = np.concatenate((a, b)), np.concatenate((an, bn))
        order = np.lexsort((-nodes, -sums))
        sums, nodes = sums[order], nodes[order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), stamp, sums, nodes))
        stamp += 1
    out: list[list[int]] = []
    lefts, rights = left.tolist(), right.tolist()
    for node in heap[0][3].tolist() if heap else []:
        own, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                own.append(x)
            else:
                todo += (lefts[x - n], rights[x - n])
        out.append(own)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest windows that differencing can fill.

    The count rises from the lower bound whenever the capacity is exceeded.
    How far the fullest window is above the mean hardly changes with the count,
    so the first rise goes to the count at which it would fit, and from there
    down as long as it fits, or up until it does."""
    total = sum(sizes)

    def fill(k: int) -> tuple[list[list[int]], int]:
        out = differencing(sizes, k)
        return out, max((sum(sizes[i] for i in w) for w in out), default=0)

    least = max(1, math.ceil(total / capacity))
    out, fullest = fill(least)
    if fullest <= capacity:
        return out
    above = fullest - total / least
    k = max(least + 1, math.ceil(total / (capacity - above)) if above < capacity else 0)
    out, fullest = fill(k)
    if fullest > capacity:
        while fullest > capacity:
            k += 1
            out, fullest = fill(k)
        return out
    while k - 1 > least:
        fewer, fullest = fill(k - 1)
        if fullest > capacity:
            break
        out, k = fewer, k - 1
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int = 2048, group_items: int = 4096) -> DataFrame:
    """``(key, part_no, first, n, container, used)`` for each part of each item:
    ``first`` its offset in the item, ``n`` its size, ``used`` the filled part
    of its container."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = dict(items.dtypes)[key]
    groups = max(1, math.ceil(items.count() / group_items))
    # equal rows in runs of at most COPIES; a run's place depends on nothing but its content
    once = items.groupBy(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("int").alias(size)).agg(F.count("*").alias("c"))
    runs = once.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / COPIES).cast("bigint"))))
    copies = F.least(F.col("c") - F.col("run") * COPIES, F.lit(COPIES)).cast("int")
    at = F.xxhash64(F.col(key), F.col(size), F.col("run"))
    dealt = runs.select(F.col(key), size, copies.alias("copies"), at.alias("at")).withColumn("grp", F.pmod(F.col("at"), F.lit(groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at").reset_index(drop=True)
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])]
        base = int(pdf["grp"].iloc[0]) * STRIDE
        keys, rows, loose, at = pdf[key].tolist(), [], [], 0
        for i, total in enumerate(pdf[size].tolist()):
            full = total // capacity if total > capacity else 0
            for p in range(full):
                rows.append((keys[i], p, p * capacity, capacity, base + at, capacity))
                at += 1
            rest = total - full * capacity
            if rest or not full:
                loose.append((i, full, full * capacity, rest))
        for w in windows([x[3] for x in loose], capacity) if loose else []:
            used = sum(loose[j][3] for j in w)
            rows += [(keys[loose[j][0]], *loose[j][1:], base + at, used) for j in w]
            at += 1
        out = pd.DataFrame(rows, columns=[key, "part_no", "first", "n", "container", "used"])
        out[key] = out[key].astype(pdf[key].dtype)
        return out

    # a group is small in bytes and long in time: partitions must not be coalesced by size
    spark = items.sparkSession
    tasks = min(groups, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(tasks, "grp").groupBy("grp").applyInPandas(fill, f"`{key}` {kind}, part_no int, first int, n int, container bigint, used int")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers by number of parts, with their mean fill."""
    per = packed.groupBy("container").agg(F.count("*").alias("parts"), F.sum("n").alias("used"))
    return per.groupBy("parts").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.avg(F.col("used") / capacity), 6).alias("mean_fill")
    )
