"""A data source that reads the sizes of raster files from their headers.

``spark.read.format("raster_headers").option("suffixes", ".png,.jpg").load(root)`` after
``register(spark)`` gives one row per file: path, format, width, height, bytes. Files are listed once on the driver,
like any Spark file source, and dealt over partitions; a task opens each file and reads its first bytes. Only where a
JPEG or TIFF header points further does it seek there, so contents are never read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, format string, width int, height int, bytes bigint"
SUFFIXES = ".png,.jpg,.jpeg,.tif,.tiff"
#: Files of a partition.
FILES = 256
_HEAD = 64


def png_size(head: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", head[16:24]) if head[1:4] == b"PNG" and len(head) >= 24 else None


def jpeg_size(file) -> tuple[int, int] | None:
    """Width and height of the first frame header; segments before it are skipped."""
    at = 2
    while True:
        file.seek(at)
        head = file.read(9)
        if len(head) < 9 or head[0] != 0xFF:
            return None
        if 0xC0 <= head[1] <= 0xCF and head[1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[5:9])
            return width, height
        at += 2 + struct.unpack(">H", head[2:4])[0]


def tiff_size(file, head: bytes) -> tuple[int, int] | None:
    """Width and height tags of the first directory."""
    order = "<" if head[:2] == b"II" else ">"
    file.seek(struct.unpack(f"{order}I", head[4:8])[0])
    count = file.read(2)
    if len(count) < 2:
        return None
    entries = file.read(12 * struct.unpack(f"{order}H", count)[0])
    tags = {}
    for k in range(0, len(entries) - 11, 12):
        tag, kind = struct.unpack(f"{order}HH", entries[k : k + 4])
        tags[tag] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", entries[k + 8 : k + (10 if kind == 3 else 12)])[0]
    return (tags[256], tags[257]) if 256 in tags and 257 in tags else None


def image_size(file) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) of an open file; nulls for what is not an image header."""
    head = file.read(_HEAD)
    if head[:4] == b"\x89PNG":
        kind, size = "png", png_size(head)
    elif head[:2] == b"\xff\xd8":
        kind, size = "jpeg", jpeg_size(file)
    elif head[:4] in (b"II*\0", b"MM\0*"):
        kind, size = "tiff", tiff_size(file, head)
    else:
        kind, size = None, None
    return (kind, *(size or (None, None)))


def open_filesystem(uri: str):
    """The file system of a path or URI (local, HDFS, S3, GCS …) and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", SUFFIXES).split(","))
        self.files = int(options.get("filesPerPartition", FILES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = open_filesystem(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.is_file and f.path.lower().endswith(self.suffixes))
        return [_Files(names[k : k + self.files]) for k in range(0, len(names), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = open_filesystem(self.root)
        for path in partition.paths:
            with system.open_input_file(path) as file:
                yield (path, *image_size(file), file.size())


class RasterHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterHeaders)


def read_headers(spark: SparkSession, root: str, suffixes: str = SUFFIXES) -> DataFrame:
    """Sizes of all files below ``root`` with one of the suffixes; ``raster_sources`` refuses an empty input."""
    register(spark)
    return spark.read.format("raster_headers").option("suffixes", suffixes).load(root)
