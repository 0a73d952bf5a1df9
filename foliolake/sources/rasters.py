"""Raster files: listing, bytes, hashes, sizes, pixels, and sample bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.constants import CLASSES
from foliolake.operators.raster import gray_from_image
from foliolake.operators.skew import dealt_join


def list_files(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Files below ``root`` (``path`` only; contents are never read)."""
    return _binary(spark, root, pattern).select("path")


def _binary(spark: SparkSession, root: str | Sequence[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def raster_sources(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Sorted listing; an input without files is refused."""
    files = list_files(spark, root, pattern)
    if files.isEmpty():
        raise ValueError(f"input contains no {pattern} files: {root}")
    return files.orderBy("path")


def stored_artifacts(spark: SparkSession, root: str, pattern: str = "*", with_hash: bool = True) -> DataFrame:
    """``path`` (below ``root``), PNG ``width, height`` from the header and, if asked, ``sha256``."""
    base = root.rstrip("/") + "/"
    size = lambda at: F.when(
        F.hex(F.substring("content", 2, 3)) == "504E47", F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    )
    columns = [F.substring_index("path", base, -1).alias("path"), size(17).alias("width"), size(21).alias("height")]
    if with_hash:
        columns.append(F.sha2("content", 256).alias("sha256"))
    return _binary(spark, root, pattern).select(*columns)


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return _binary(spark, root, pattern).select("path", F.sha2("content", 256).alias("sha256"))


def read_scanlines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scanlines of PNG or JPEG files keyed by file path."""
    images = spark.read.format("image").load(paths)
    return gray_from_image(images.withColumn("page_id", F.col("image.origin")))


def load_samples(samples: DataFrame, scanlines: DataFrame, masks: bool = True) -> DataFrame:
    """Sample bundles as scanlines with one array column per role.

    ``scanlines`` is keyed by artifact path. Without ``masks`` their paths never enter the join, so
    mask rows are not looked up at all. A page with very many lines is dealt over tasks by its lines.
    """
    roles = {"input": F.col("input_path"), "clean": F.col("clean_target_path")}
    if masks:
        roles |= {f"mask_{c}": F.col("mask_paths")[c] for c in CLASSES}
    wanted = samples.select(
        "sample_id", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), p.alias("path")) for r, p in roles.items()]))
    )
    rows = dealt_join(scanlines.withColumnRenamed("page_id", "path"), wanted, ["path"], deal=F.col("y"))
    return rows.groupBy("sample_id", "y").pivot("role", list(roles)).agg(F.first("values"))


class SampleTable:
    """Samples in manifest order with length, index, slice and iteration."""

    def __init__(self, samples: DataFrame):
        self.samples = samples

    def __len__(self) -> int:
        return self.samples.count()

    def __getitem__(self, index: int | slice):
        if isinstance(index, slice):
            start, stop, step = index.indices(len(self))
            at = F.col("_index")
            return self._indexed().where((at >= start) & (at < stop) & ((at - start) % step == 0)).drop("_index")
        position = index if index >= 0 else len(self) + index
        found = self._indexed().where(F.col("_index") == position).drop("_index").first()
        if found is None:
            raise IndexError(index)
        return found

    def _indexed(self) -> DataFrame:
        """Positions by line number; ``line_no`` counts from 1 in one manifest file without gaps."""
        return self.samples.withColumn("_index", F.col("line_no") - 1)

    def __iter__(self):
        return self.samples.orderBy("line_no").toLocalIterator()
