"""What several corpus operators share: texts, shared folders and checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.session import checkpointed

#: A side of a join is broadcast up to this many rows of a few numbers each (a few megabytes).
BROADCAST_ROWS = 100_000

#: Rows of a few numbers each that a written part holds at least, where there are more parts than cores.
PART_ROWS = 50_000

#: White space of the word rule: space and the six controls from tab to carriage return.
SPACE = r"[ \t-\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column) -> Column:
    """Words between white space, as an array."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, because it is longer than all of them."""
    return "_" * (1 + max(map(len, df.columns)))


def materialized(df: DataFrame) -> tuple[DataFrame, int]:
    """A reliable checkpoint and its row count."""
    kept = checkpointed(df)
    return kept, kept.count()


def checked_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` for a join: broadcast when its counted rows are few, else joined as Spark plans it."""
    return F.broadcast(df) if rows <= limit else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        checkpointed(spark.range(0))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def bound_once(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once per row.

    A lambda variable keeps the optimizer from copying a costly expression into every place, or into a
    lambda that runs once per element, when it merges projections or pushes filters down.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the writes made inside go as soon as their output is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, rows: int | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back; its shuffle files are freed.

    With ``rows``, an upper bound of its counted rows, it is written in no more parts than these need, one per core at least.
    ``options`` are the writer's.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))
    with freed_shuffles(spark):
        df.write.options(**(options or {})).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of ``text`` each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right")))
        yield batch.slice(low, high - low)
        low = high
