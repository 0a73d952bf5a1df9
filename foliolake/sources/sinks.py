"""Sinks: canonical JSON lines, metric tables, write-once artifacts and all-or-nothing outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_lines(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One JSON object per row with keys in sorted order."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")
    return rows.select(text) if order is None else rows.orderBy(order).select(text)


def write_manifest(rows: DataFrame, path: str, order: str = "task_index") -> None:
    """Manifest lines in task order, as sorted part files; an existing target is refused."""
    canonical_lines(rows, order).write.mode("errorifexists").text(path)


def write_metrics(tables: list[DataFrame], path: str) -> None:
    """Metric rows of different shapes as JSON lines and CSV under one header.

    Columns keep the order in which they are first seen; a row lacks what its kind does not measure.
    """
    merged = union_metrics(tables)
    merged.write.mode("errorifexists").json(f"{path}/jsonl")
    merged.write.mode("errorifexists").csv(f"{path}/csv", header=True)


def union_metrics(tables: list[DataFrame]) -> DataFrame:
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged


def write_once(new: DataFrame, stored: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(artifacts to add, conflicts): equal content is kept as it is, different content is an error."""
    n = new.select(key, F.col("sha256").alias("new_sha256"))
    s = stored.select(key, F.col("sha256").alias("stored_sha256"))
    joined = n.join(s, key, "left")
    add = new.join(joined.where("stored_sha256 IS NULL").select(key), key, "left_semi")
    conflict = joined.where("stored_sha256 <> new_sha256").select(
        key, F.lit("existing artifact differs from regenerated content").alias("problem")
    )
    return add, conflict


def commit_output(
    spark: SparkSession, rows: DataFrame, path: str, check: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Write, check what was written, then mark it complete.

    The marker row appears only after the checks pass, and readers ask for it with ``is_complete``;
    a failed or half-written output is never taken for a finished one. An existing target is refused.
    Problems are written beside the data, all of them, and the error names their number and place.
    """
    rows.write.mode("errorifexists").parquet(f"{path}/data")
    if check is not None:
        check(spark.read.parquet(f"{path}/data")).write.mode("errorifexists").parquet(f"{path}/problems")
        count = spark.read.parquet(f"{path}/problems").count()
        if count:
            raise ValueError(f"output check failed: {count} problems in {path}/problems")
    spark.range(1).select(F.lit("complete").alias("status")).write.mode("errorifexists").json(f"{path}/committed")


def is_complete(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("status string").json(f"{path}/committed").isEmpty()
    except Exception as error:  # the marker does not exist
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def write_files(rows: DataFrame, root: str) -> int:
    """Write ``path, content`` rows as binary files below ``root`` and return how many there are.

    Each task writes its own files, first under a name of their own, then moved, so a file is whole or absent and
    a task that is run again leaves the same files. ``root`` is a folder or URI that all executors reach.
    """
    from foliolake.sources.headers import open_filesystem

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, target)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return rows.select("path", F.col("content").cast("binary")).mapInArrow(written, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
