"""Python steps over Arrow batches, with columns as plain lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_columns(df: DataFrame, schema: str, start: Callable[[], Callable[..., list | None]], rows: int = 2048) -> DataFrame:
    """``mapInArrow`` for functions over columns.

    ``start()`` is called once per task and returns ``step(*columns)``, which
    gets up to ``rows`` rows as one list per input column and returns one list
    per output column.  Memory is bounded by a batch, not by a partition.
    A ``finish`` attribute of ``step``, if any, is called at the end of the
    task and returns columns once more.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()

        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = step(*(c.to_pylist() for c in batch.slice(at, rows).columns))
                if out is not None and len(out[0]):
                    yield made(out)
        if hasattr(step, "finish"):
            out = step.finish()
            if out is not None and len(out[0]):
                yield made(out)

    return df.mapInArrow(run, struct)


def map_groups(df: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """``step`` on the rows of each group of equal keys, in order, as dicts; it
    returns rows of ``schema``.

    Rows are dealt by key, sorted in each task and streamed, so a task holds
    one group at a time, and many small groups cost no call each."""
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key, out = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if mine != key and held:
                    out += step(held)
                    held = []
                key = mine
                held.append(row)
                if len(out) >= 2048:
                    yield made()
                    out = []
        if held:
            out += step(held)
        if out:
            yield made()

    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, struct)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer tasks than there are cores (few or small
    files), dealt to all of them; larger scans stay as they are.  Only for
    scans: it plans the frame."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
