"""Versioned tables of Parquet files: several tables change in one step.

A commit writes each table to a directory of its own version and then a small
manifest; the manifest's rename is the commit.  Readers take the greatest
manifest, so they see all tables of a commit or none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, root: str) -> int:
    """Greatest committed version, 0 without any."""
    _, fs, p = _fs(spark, f"{root}/_manifests")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)


def manifest(spark: SparkSession, root: str, at: int | None = None) -> dict[str, str]:
    at = version(spark, root) if at is None else at
    if not at:
        return {}
    lines = spark.read.text(f"{root}/_manifests/{at:010d}.json", wholetext=True).collect()  # one small file
    return json.loads(lines[0].value)


def read(spark: SparkSession, root: str, table: str, at: int | None = None) -> DataFrame:
    return spark.read.parquet(manifest(spark, root, at)[table])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> int:
    """Write the tables as the next version; others keep theirs.  Fails if
    another commit took the number in the meantime."""
    at = version(spark, root) + 1
    state = manifest(spark, root)
    for name, df in tables.items():
        path = f"{root}/{name}/v{at}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(path)
        state[name] = path
    jvm, fs, target = _fs(spark, f"{root}/_manifests/{at:010d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"version {at} was committed by someone else")
    return at
