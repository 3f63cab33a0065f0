"""Session-level helpers: table loading and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="foliant-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a frame that reads it.

    Lineage ends at the written files, so a lost executor costs a re-read and
    not a recomputation; unlike a cached frame, nothing lives on one executor.
    The files are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def written(frames: Iterable[DataFrame], label: str) -> DataFrame:
    """As ``materialize``, for tables that come in several frames of one schema
    (at least one): they are written one after another, and the shuffle files
    of each are deleted as soon as it is there."""
    path, schema = "", None
    for df in frames:
        spark = df.sparkSession
        if schema is None:
            path, schema = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", df.schema
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
        before = spark.conf.get(CLEANUP_KEY, "false")
        spark.conf.set(CLEANUP_KEY, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` or ``written`` that
    nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def utc_month(ts) -> F.Column:
    """``yyyy-MM`` of a timestamp in UTC, whatever the session time zone is."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")
