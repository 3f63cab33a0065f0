"""Files of an object store: put, get, list, exists, delete, through the
Hadoop file systems that Spark is configured with.

Keys are relative to a root and may not leave it.  A put replaces the object
in one step.  Links with a signature are the store's own business."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_of(root: str, key: str) -> str:
    clean = posixpath.normpath(key.strip().lstrip("/"))
    if clean in ("", ".") or clean.startswith(".."):
        raise ValueError(f"no key of the store: {key!r}")
    return f"{root.rstrip('/')}/{clean}"


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, root: str, key: str, data: bytes) -> str:
    path = path_of(root, key)
    jvm, fs, target = _open(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(draft)
    out.write(bytearray(data))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{key} was not written")
    return path


def exists(spark: SparkSession, root: str, key: str) -> bool:
    _, fs, p = _open(spark, path_of(root, key))
    return fs.exists(p)


def delete(spark: SparkSession, root: str, key: str) -> bool:
    """True if there was something; deleting twice is no error."""
    _, fs, p = _open(spark, path_of(root, key))
    return fs.exists(p) and fs.delete(p, True)


def objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(key, length, modified, content)`` of all objects; the content is
    read only where it is selected.  Spark lists no files without bytes:
    ``exists`` knows empty objects, this list does not."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rooted = F.regexp_replace("path", rf"^.*?{root.rstrip('/').split(':')[-1].lstrip('/')}/", "")
    return df.where(~F.endswith("path", F.lit(".part"))).select(rooted.alias("key"), "length", F.col("modificationTime").alias("modified"), "content")


def missing(files: DataFrame, stored: DataFrame, key: str = "storage_key") -> DataFrame:
    """Files whose object is not there, and objects that no file names."""
    keys = stored.select(F.col("key").alias(key))
    lost = files.select(key).join(keys, key, "left_anti").select(key, F.lit("lost").alias("state"))
    return lost.unionByName(keys.join(files.select(key), key, "left_anti").select(key, F.lit("unknown").alias("state")))


def within_budget(files: DataFrame, most_bytes: int = 256 << 20, most_pages: int = 2_000, most_image_bytes: int = 64 << 20) -> DataFrame:
    """Files with the limit they exceed in ``error``: bytes, pages, or bytes of
    images; unknown sizes exceed none.  A deadline is the cluster's: tasks
    that take too long are ended by ``spark.task`` and speculation settings."""
    over = lambda c, most, name: F.when(F.coalesce(F.col(c), F.lit(0)) > most, name) if c in files.columns else F.lit(None)
    return files.withColumn("error", F.coalesce(over("size_bytes", most_bytes, "too many bytes"), over("page_count", most_pages, "too many pages"), over("image_bytes", most_image_bytes, "too many image bytes")))
