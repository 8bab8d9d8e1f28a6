"""Tables and cut points shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; an own one only in local mode, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="portrisk-work-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


#: Bytes of an Arrow batch on its way to Python. A task holds some copies of one in the JVM and in Python; Spark's bound is 64 MB.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends Arrow batches of about BATCH_BYTES (one row at least) to Python, unless it has a bound of its own.

    Spark reads the bound when a plan runs, which may be after the operator has returned, so it stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, lost executors recompute nothing.

    The reread table has a size that Spark knows, so later joins are planned by it. A task holds a row group
    while it writes; row_group makes it smaller for tables of wide rows.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{uuid.uuid4().hex}"
    bound_batches(spark)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sampled(key: Column, n: int, sample: int) -> Column:
    """True for about sample of n rows, by all 64 bits of a hash of key; for all of them if n is no larger."""
    if sample >= n:
        return F.lit(True)
    return F.xxhash64(key) < F.lit(sample_limit(n, sample))


def sample_limit(n: int, sample: int) -> int:
    """The signed 64-bit number that sample of n hashes lie below."""
    return (sample << 64) // n - (1 << 63)


#: Rows of a table that may be broadcast: at 16 bytes a key, 16 MB. Larger sides are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a table of counted size, no hint for a larger one. Count a table that was cut."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sorted_chunks(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """A stream that is sorted by key, cut where the key changes: about a batch at a time, groups whole."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        same = np.ones(len(batch) - 1, dtype=bool)
        for k in key:
            v = batch.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        begins = np.flatnonzero(~same) + 1
        if rest and any(rest[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in key):
            yield pa.Table.from_batches(rest)
            rest = []
        if len(begins):
            yield pa.Table.from_batches([*rest, batch.slice(0, begins[-1])])
            rest = [batch.slice(begins[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Groups of equal key of a stream that is sorted by it."""
    for part in sorted_chunks(batches, key):
        same = np.ones(len(part) - 1, dtype=bool)
        for k in key:
            v = part.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        edges = [0, *(np.flatnonzero(~same) + 1).tolist(), len(part)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            yield part.slice(x, y - x)
