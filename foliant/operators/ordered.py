"""Ordered operators that never need a whole key in one task.

A key's rows are cut into blocks by their place; a block carries its state to
the next ones through one summary row, and only summaries of a key meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize


def carry_forward(df: DataFrame, key: str, order: str, columns: list[str], block: int = 4096) -> DataFrame:
    """The last known value of each column up to each row, as ``last_<column>``.
    ``order`` is an integer; rows without one come first."""
    at = F.floor(F.coalesce(F.col(order), F.lit(-1)) / block)
    df = df.withColumn("_block", at)
    inner = Window.partitionBy(key, "_block").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = df.groupBy(key, "_block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce(F.col(order), F.lit(-1)))).alias(f"_{c}") for c in columns))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), *(F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in columns))
    local = df.select("*", *(F.last(c, ignorenulls=True).over(inner).alias(f"last_{c}") for c in columns))
    out = local.join(carried, local[key].eqNullSafe(carried["_key"]) & (local["_block"] == carried["_b"]), "left")
    return out.select(*[c for c in df.columns if c != "_block"], *(F.coalesce(f"last_{c}", f"_{c}").alias(f"last_{c}") for c in columns))


def heading_paths(sections: DataFrame, key: str = "document_id", order: str = "ord", levels: int = 6, block: int = 4096) -> DataFrame:
    """Breadcrumb of each section: of every level the last heading, unless one
    of a higher level came later."""
    marked = sections
    for n in range(1, levels + 1):
        here = (F.col("heading_level") == n) & F.col("heading").isNotNull()
        marked = marked.withColumn(f"h{n}", F.when(here, F.struct(F.col(order).alias("at"), F.col("heading").alias("title"))))
    names = [f"h{n}" for n in range(1, levels + 1)]
    carried = carry_forward(marked, key, order, names, block)
    parts = []
    for n in range(1, levels + 1):
        mine, above = F.col(f"last_h{n}"), [F.col(f"last_h{k}.at") for k in range(1, n)]
        stands = mine.isNotNull()
        for a in above:
            stands = stands & (a.isNull() | (a <= mine["at"]))
        parts.append(F.when(stands, mine["title"]))
    return carried.withColumn("path", F.array_compact(F.array(*parts))).drop(*names, *(f"last_{n}" for n in names))


def next_value(df: DataFrame, key: str, order: str, value: str, block: int = 4096) -> DataFrame:
    """The value of the next row of the key, as ``next_<value>``: by ``order``
    (an integer, nulls last), then value; null for the last row."""
    last = 1 << 40
    at = F.floor(F.coalesce(F.col(order).cast("long"), F.lit(last * block)) / block)
    df = df.withColumn("_block", at)
    inner = Window.partitionBy(key, "_block").orderBy(F.col(order).asc_nulls_last(), value)
    firsts = df.groupBy(key, "_block").agg(F.min(F.struct(F.coalesce(F.col(order).cast("long"), F.lit(last * block)).alias("o"), F.col(value).alias("v"))).alias("_f"))
    after = Window.partitionBy(key).orderBy("_block")
    follow = firsts.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), F.lead("_f.v").over(after).alias("_next"))
    local = df.withColumn("_mine", F.lead(value).over(inner))
    out = local.join(follow, local[key].eqNullSafe(follow["_key"]) & (local["_block"] == follow["_b"]), "left")
    return out.withColumn(f"next_{value}", F.coalesce("_mine", "_next")).drop("_mine", "_next", "_key", "_b", "_block")


def ranked(df: DataFrame, key: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Place of each row within its key, from 1, as ``name``.

    Rows are sorted into ranges of key and order, so a key with any share of
    all rows is spread over many tasks; a row's place is its place within its
    task and key plus the key's rows in the tasks before, of which there is
    one summary a key and task.  ``order`` must end with something unique."""
    by = [*(F.col(k).asc_nulls_first() for k in key), *order]
    stamped = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("_at", 33)
    parts = stamped.groupBy(*(F.col(k).alias(f"_{k}") for k in key), task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*(f"_{k}" for k in key)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = task == F.col("_task")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return stamped.join(parts, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
