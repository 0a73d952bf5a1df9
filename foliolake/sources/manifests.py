"""Manifest, metadata, asset and catalogue scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake import schemas
from foliolake.constants import MANIFEST_SCHEMA_VERSION
from foliolake.session import checkpointed


#: Splits whose line counts are broadcast; a table of more is joined as Spark plans it.
BROADCAST_SPLITS = 200_000


def _numbered_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_place``: the number of the line in its split, in the order in which the scan reads."""
    before, last = 0, None
    for batch in batches:
        file, block = batch.column("file"), batch.column("_block")
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        n = batch.num_rows
        if not n:
            continue
        if last != (file[0].as_py(), block[0].as_py()):
            before = 0
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        sizes = np.diff(np.append(starts, n))
        places = np.arange(n) - np.repeat(starts, sizes) + 1
        places[: sizes[0]] += before
        last, before = (file[n - 1].as_py(), block[n - 1].as_py()), int(places[-1])
        yield pa.record_batch([*batch.columns, pa.array(places)], names=[*batch.schema.names, "_place"])


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their true line numbers: ``file, line_no, value``.

    Files are read in splits, so even one huge file is read in parallel. A first scan counts the lines of each
    split; in the second one lines are numbered where they are read and meet the number of lines before their
    split, one row per split of some hundred megabytes. The text itself is never shuffled while there are fewer
    than ``BROADCAST_SPLITS`` splits.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value"
    )
    splits = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpointed(splits.select("file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    small = placed.count() <= BROADCAST_SPLITS
    numbered = lines.mapInArrow(_numbered_inside, "file string, _block bigint, value string, _place bigint")
    joined = numbered.join(F.broadcast(placed) if small else placed, ["file", "_block"])
    return joined.select("file", (F.col("_before") + F.col("_place")).cast("bigint").alias("line_no"), "value")


def empty_files(listed: DataFrame, lines: DataFrame) -> DataFrame:
    """Manifest files without a single line, which is an error.

    ``listed`` names the expected files; Spark's own scans pass over empty files without a row.
    """
    return listed.select("file").join(lines.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit("dataset manifest must contain at least one record").alias("message")
    )


def read_samples(lines: DataFrame) -> DataFrame:
    """Typed sample records in manifest order columns; validate first, a typed read coerces."""
    record = F.from_json("value", schemas.SAMPLES, {"mode": "PERMISSIVE"})
    return lines.select("file", "line_no", record.alias("r")).select("file", "line_no", "r.*")


def read_dataset_metadata(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Dataset descriptions, one row per file."""
    return spark.read.schema(schemas.DATASET_METADATA).json(paths, multiLine=True).withColumn(
        "file", F.col("_metadata.file_path")
    )


def metadata_file_problems(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, message`` of dataset descriptions that are no JSON, no object, or of another version."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    # Only a whole number counts; true and "1" are no versions.
    version = F.when(F.schema_of_variant(F.try_variant_get("doc", "$.schema_version", "variant")) == "BIGINT", F.try_variant_get("doc", "$.schema_version", "bigint"))
    message = F.when(F.col("doc").isNull(), F.lit("invalid dataset metadata JSON")).when(
        ~is_object, F.lit("dataset metadata root must be an object")
    ).when(~version.eqNullSafe(F.lit(MANIFEST_SCHEMA_VERSION)), F.lit(f"dataset metadata schema_version must be {MANIFEST_SCHEMA_VERSION}"))
    return raw.select("file", message.alias("message")).where("message IS NOT NULL")


def read_asset_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Assets of source manifests with their index in the list."""
    raw = spark.read.schema(schemas.ASSET_MANIFEST).json(paths, multiLine=True)
    listed = raw.select(F.col("_metadata.file_path").alias("file"), "schema_version", F.posexplode("scores").alias("line_no", "s"))
    return listed.select("file", "schema_version", "line_no", "s.*")


def asset_manifest_problems(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files whose root is not a mapping, whose version is wrong, or whose list is empty."""
    raw = spark.read.schema(schemas.ASSET_MANIFEST).json(paths, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    problem = F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), F.lit("schema_version must be 1")).when(
        F.coalesce(F.size("scores"), F.lit(0)) < 1, F.lit("scores must be a nonempty list")
    )
    return raw.select("file", problem.alias("message")).where("message IS NOT NULL")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Works of a catalogue with the upstream columns beside them."""
    raw = spark.read.schema(schemas.CATALOGUE).json(path, multiLine=True)
    return raw.select("upstream.*", F.explode("scores").alias("s")).select(
        "repository", "commit", "source_file_rights_basis", "s.*"
    )
