"""Problem 1: references to records that do not exist (yet, or any more).

A reference made at time ``t`` resolves if some version of its target was
created at or before ``t`` and not deleted by then.  With ``end`` the deletion
time of a version (infinity if it lives), that is an as-of question::

    resolves(t)  <=>  max(end over versions with created_at <= t) > t

so no pairs of reference and version are ever formed.  References are split by
skew:

* they are pre-aggregated per key and month; keys with at least
  ``heavy_rows`` references, or ``heavy_share`` of all where that is more, are
  *heavy*: at most ``1 / heavy_share`` keys, and no other key has more rows
  than a small part of a task;
* heavy keys are resolved against a broadcast step function, those with the
  shortest histories first, as long as all steps together are at most
  ``broadcast_steps``, without a shuffle;
* the other heavy keys are cut into salted (key, hour) cells, each seeded with
  the running state at its start;
* all other keys are shuffled once, references together with versions, and
  resolved by one running maximum per key.

The report needs no single references: those of equal target, key, time and
origin are counted first, and the counts are resolved.

Definitions for irregular input: a null reference is no reference; an empty
key (after trimming) is one and is ``missing``; a reference without time can
not resolve, and is ``missing`` or ``deleted``; a version without created_at
never makes a reference resolve, but its key exists and it is not ``late``.
Repeated rows of either side change nothing in ``unresolved``; in ``report``
every referring row counts.  Empty tables give empty results, extra columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import utc_month

#: Micros of a timestamp that no real one reaches: the end of a living version.
FOREVER = 1 << 62
HOUR = 3_600_000_000


@dataclass(frozen=True)
class SkewPolicy:
    """heavy_share: share of all references from which a key is heavy;
    heavy_rows: rows below which no key is; broadcast_steps: steps that are
    broadcast at most, of all heavy keys together; salts: parts of a heavy cell."""

    heavy_share: float = 0.00001
    heavy_rows: int = 20_000
    broadcast_steps: int = 200_000
    salts: int = 32


def norm_key(c) -> F.Column:
    """Keys compare in lower case without surrounding blanks or tabs."""
    return F.lower(F.btrim(c, F.lit(" \t")))


def references(chunks: DataFrame, mappings: DataFrame) -> DataFrame:
    """All references as ``(target, key, t, src_table, src_field, src_key)``."""
    text = F.lit(None).cast("string")
    of_chunks = chunks.where(F.col("document_id").isNotNull()).select(
        F.lit("documents_meta").alias("target"),
        norm_key(F.col("document_id")).alias("key"),
        F.col("created_at").alias("t"),
        F.lit("chunks").alias("src_table"),
        F.lit("document_id").alias("src_field"),
        F.coalesce(F.col("chunk_id"), text).alias("src_key"),
    )
    chunk, lo = norm_key(F.col("chunk_id")), norm_key(F.col("lo_id"))
    both = F.array(
        F.struct(F.lit("chunks").alias("target"), chunk.alias("key"), F.lit("chunk_id").alias("src_field")),
        F.struct(F.lit("learning_outcomes").alias("target"), lo.alias("key"), F.lit("lo_id").alias("src_field")),
    )
    of_mappings = mappings.select(
        F.explode(both).alias("r"),
        F.col("mapped_at").alias("t"),
        F.concat(F.coalesce(chunk, F.lit("")), F.lit("|"), F.coalesce(lo, F.lit(""))).alias("src_key"),
    ).where(F.col("r.key").isNotNull()).select(
        "r.target", "r.key", "t", F.lit("chunk_lo_mappings").alias("src_table"), "r.src_field", "src_key"
    )
    return of_chunks.unionByName(of_mappings)


def versions(documents_meta: DataFrame, chunks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """All target versions as ``(target, key, start, stop)``; times in micros."""
    def one(df: DataFrame, target: str, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(
            F.lit(target).alias("target"),
            norm_key(F.col(key)).alias("key"),
            F.unix_micros("created_at").alias("start"),
            F.coalesce(F.unix_micros("deleted_at"), F.lit(FOREVER)).alias("stop"),
        )

    return reduce(DataFrame.unionByName, [
        one(documents_meta, "documents_meta", "document_id"),
        one(chunks, "chunks", "chunk_id"),
        one(outcomes, "learning_outcomes", "lo_id"),
    ])


def _kind(known, undated, seen, reach, at) -> F.Column:
    """Null if the reference resolves, else why not."""
    return (
        F.when(F.coalesce(known, F.lit(0)) == 0, "missing")
        .when(at.isNull(), "deleted")
        .when(reach > at, F.lit(None))
        .when((F.coalesce(seen, F.lit(0)) == 0) & (undated == 0), "late")
        .otherwise("deleted")
    )


def _running(rows: DataFrame, part: list[str]) -> DataFrame:
    """Resolve references (``is_ref``) by a running maximum over the versions
    before them; ``rows`` may hold seed rows with the state at the start."""
    before = Window.partitionBy(*part).orderBy(F.col("at").asc_nulls_first(), "is_ref").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*part)
    return (
        rows.withColumns({"reach": F.max("stop").over(before), "seen": F.sum("dated").over(before)})
        .withColumns({"known": F.sum("n").over(whole), "undated": F.sum(F.col("n") - F.col("dated")).over(whole)})
        .where("is_ref = 1")
        .withColumn("kind", _kind(F.col("known"), F.col("undated"), F.col("seen"), F.col("reach"), F.col("at")))
    )


_OUT = ["src_table", "src_field", "src_key", "t", "refs", "kind"]


def _ref_rows(refs: DataFrame, *more: str) -> DataFrame:
    return refs.select(
        "target", "key", *more, F.unix_micros("t").alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("stop"),
        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("dated"), "src_table", "src_field", "src_key", "t", "refs",
    )


def _version_rows(vers: DataFrame, *more: str) -> DataFrame:
    """One row for each distinct start of a key (partial aggregation first)."""
    return vers.groupBy("target", "key", *more, "start").agg(F.max("stop").alias("stop")).select(
        "target", "key", *more, F.col("start").alias("at"), F.lit(0).alias("is_ref"),
        F.when(F.col("start").isNotNull(), F.col("stop")).alias("stop"),
        F.lit(1).cast("long").alias("n"), F.col("start").isNotNull().cast("long").alias("dated"),
    )


def heavy_keys(refs: DataFrame, policy: SkewPolicy) -> list[tuple[str, str]]:
    """Keys with very many rows: a list of at most ``1 / heavy_share`` entries,
    whatever the input's size."""
    per_month = refs.groupBy("target", "key", utc_month(F.col("t")).alias("month")).agg(F.count("*").alias("n"))
    per_key = per_month.groupBy("target", "key").agg(F.sum("n").alias("n"))
    total = refs.count()
    least = max(policy.heavy_rows, math.ceil(total * policy.heavy_share))
    return [(r.target, r.key) for r in per_key.where(F.col("n") >= least).collect()]


def counted(refs: DataFrame) -> DataFrame:
    """References of equal target, key, time and origin as one row with their
    number, counted in each task first."""
    return refs.groupBy("target", "key", "t", "src_table", "src_field").agg(F.count("*").alias("refs")).withColumn("src_key", F.lit(None).cast("string"))


def resolve(refs: DataFrame, vers: DataFrame, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Every reference row (or counted row) with its ``kind`` (null where it
    resolves) and the references it stands for."""
    spark = refs.sparkSession
    if "refs" not in refs.columns:
        refs = refs.withColumn("refs", F.lit(1).cast("long"))
    heavy = heavy_keys(refs, policy)
    light_refs, light_vers = refs, vers
    parts = []
    if heavy:
        # at most 1 / heavy_share rows
        hot = F.broadcast(spark.createDataFrame(heavy, "target string, key string"))
        light_refs, light_vers = (x.join(hot, ["target", "key"], "left_anti") for x in (refs, vers))
        hot_refs, hot_vers = (x.join(hot, ["target", "key"], "left_semi") for x in (refs, vers))
        steps = hot_vers.groupBy("target", "key", "start").agg(F.max("stop").alias("stop"))
        sizes = {(r.target, r.key): r.n for r in steps.groupBy("target", "key").agg(F.count("*").alias("n")).collect()}  # at most 1 / heavy_share rows
        short, total = [], 0
        for k in sorted(heavy, key=lambda k: (sizes.get(k, 0), k)):
            total += sizes.get(k, 0)
            if total > policy.broadcast_steps:
                break
            short.append(k)
        known = set(short)
        for some, how in ((short, _by_steps), ([k for k in heavy if k not in known], _by_cells)):
            if some:
                mine = F.broadcast(spark.createDataFrame(some, "target string, key string"))
                parts.append(how(
                    hot_refs.join(mine, ["target", "key"], "left_semi"), hot_vers.join(mine, ["target", "key"], "left_semi"), policy
                ))
    rows = _ref_rows(light_refs).unionByName(_version_rows(light_vers), allowMissingColumns=True)
    parts.append(_running(rows, ["target", "key"]).select(*_OUT))
    return reduce(DataFrame.unionByName, parts)


def _by_steps(refs: DataFrame, vers: DataFrame, policy: SkewPolicy) -> DataFrame:
    steps = (
        vers.groupBy("target", "key", "start").agg(F.max("stop").alias("stop"))
        .groupBy("target", "key").agg(F.collect_list(F.struct("start", "stop")).alias("steps"))
    )
    at = F.unix_micros("t")
    seen = F.filter("steps", lambda s: s["start"] <= at)
    undated = F.size(F.filter("steps", lambda s: s["start"].isNull()))
    joined = refs.join(F.broadcast(steps), ["target", "key"], "left").withColumn("seen", seen)
    kind = _kind(
        F.when(F.col("steps").isNull(), 0).otherwise(F.size("steps")), undated,
        F.size("seen"), F.array_max(F.transform("seen", lambda s: s["stop"])), at,
    )
    return joined.withColumn("kind", kind).select(*_OUT)


def _by_cells(refs: DataFrame, vers: DataFrame, policy: SkewPolicy) -> DataFrame:
    cell = lambda c: F.floor(F.coalesce(c, F.lit(0)) / HOUR)
    refs = refs.withColumns({"cell": cell(F.unix_micros("t")), "salt": F.pmod(F.xxhash64("src_key", "t"), F.lit(policy.salts))})
    vers = vers.withColumn("cell", cell(F.col("start")))
    # state of each cell, over at most one row for every hour and key
    by_cell = _version_rows(vers, "cell").groupBy("target", "key", "cell").agg(
        F.max("stop").alias("stop"), F.sum("n").alias("n"), F.sum("dated").alias("dated"))
    cells = by_cell.unionByName(refs.select("target", "key", "cell").distinct(), allowMissingColumns=True).groupBy("target", "key", "cell").agg(
        F.max("stop").alias("stop"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dated"), F.lit(0)).alias("dated"))
    earlier = Window.partitionBy("target", "key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("target", "key")
    mine = Window.partitionBy("target", "key").orderBy("cell").rowsBetween(Window.currentRow, Window.currentRow)
    # versions of other cells count as known there; those before it as seen
    seeds = cells.select(
        "target", "key", "cell", F.lit(None).cast("long").alias("at"), F.lit(-1).alias("is_ref"),
        F.max("stop").over(earlier).alias("stop"),
        (F.sum("n").over(whole) - F.sum("n").over(mine)).alias("n"),
        F.coalesce(F.sum("dated").over(earlier), F.lit(0)).alias("dated"),
        (F.sum(F.col("n") - F.col("dated")).over(whole)).alias("undated_all"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(policy.salts - 1))).alias("salt")
    fixed = seeds.unionByName(_version_rows(vers, "cell"), allowMissingColumns=True).select("*", every)
    rows = _ref_rows(refs, "cell", "salt").unionByName(fixed.withColumn("salt", F.col("salt").cast("long")), allowMissingColumns=True)
    part = ["target", "key", "cell", "salt"]
    before = Window.partitionBy(*part).orderBy(F.col("at").asc_nulls_first(), "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumns({
            "reach": F.max("stop").over(before), "seen": F.sum("dated").over(before),
            "known": F.sum("n").over(Window.partitionBy(*part)), "undated": F.max("undated_all").over(Window.partitionBy(*part)),
        })
        .where("is_ref = 1")
        .withColumn("kind", _kind(F.col("known"), F.col("undated"), F.col("seen"), F.col("reach"), F.col("at")))
        .select(*_OUT)
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """Distinct unresolved references, the result of ``p1_found``."""
    return resolved.where(F.col("kind").isNotNull()).select(
        "src_table", "src_field", "src_key", "kind", utc_month(F.col("t")).alias("ref_month")
    ).distinct()


def report(resolved: DataFrame) -> DataFrame:
    """References and orphans of every kind per table, field and month."""
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("refs"))), F.lit(0)).alias(k)
    return (
        resolved.groupBy("src_table", "src_field", utc_month(F.col("t")).alias("ref_month"))
        .agg(F.sum("refs").alias("refs"), count("missing"), count("late"), count("deleted"))
        .withColumn("orphan_share", F.round((F.col("missing") + F.col("late") + F.col("deleted")) / F.col("refs"), 6))
    )
