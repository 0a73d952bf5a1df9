"""Raster forms and the conversions between them.

* scanline: ``page_id, y, values array<int>``, dense (every row has the page's width). Storage form.
* byte line: the same levels less 128 as ``array<tinyint>``. The form in which bands are shuffled.
* pixel: ``page_id, y, x, v``. Only inside a stage; ``x`` starts at 0.
* run: ``page_id, y, x0, x1``, half open. Masks at scale, since ink is sparse.

Keys are ``(page_id, y)`` or finer, so one huge page is spread over the cluster like any other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "page_id"


def byte_line(values: Column) -> Column:
    """Levels 0..255 as bytes (level - 128), a quarter of what integers take in a shuffle or a file."""
    return F.transform(values, lambda v: (v - 128).cast("tinyint"))


def byte_lines(values: Column) -> tuple[Column, Column]:
    """``byte_line`` for levels of any size: the line of bytes, and the levels themselves where some are not in 0..255.

    Such a line's bytes are the nearest levels, so that all lines stay equally long; other lines have null beside them.
    """
    fits = F.coalesce((F.array_min(values) >= 0) & (F.array_max(values) <= 255), F.lit(True))
    nearest = F.transform(values, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), v)))
    return F.when(fits, byte_line(values)).otherwise(byte_line(nearest)), F.when(~fits, values)


def levels_of(line: Column) -> Column:
    """Levels of a byte line."""
    return F.transform(line, lambda v: v.cast("int") + 128)


def to_pixels(scan: DataFrame, values: str = "values", keep: Sequence[str] = ()) -> DataFrame:
    """Scanlines to pixels, in the scanning stage (no shuffle)."""
    return scan.select(PAGE, "y", *keep, F.posexplode(values).alias("x", "v"))


def to_scanlines(pixels: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Pixels to scanlines; a group is one row of one page."""
    cells = F.array_sort(F.collect_list(F.struct("x", "v")))
    return pixels.groupBy(PAGE, "y", *keep).agg(F.transform(cells, lambda c: c["v"]).alias("values"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n, mass, moment, most`` of the lists in ``_values``, with the other columns of their rows."""
    for batch in batches:
        lists = batch.column("_values")
        kept = pa.RecordBatch.from_arrays(
            [batch.column(c) for c in batch.schema.names if c != "_values"], names=[c for c in batch.schema.names if c != "_values"]
        )
        full = pc.fill_null(pc.greater(pc.list_value_length(lists), 0), False)
        lists, kept = lists.filter(full), kept.filter(full)
        if not len(lists):
            continue
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.arange(len(values)) - np.repeat(first, sizes)
        sums = [sizes, np.add.reduceat(values, first), np.add.reduceat(values * x, first), np.maximum.reduceat(values, first)]
        yield pa.record_batch([*kept.columns, *map(pa.array, sums)], names=[*kept.schema.names, "n", "mass", "moment", "most"])


def line_moments(lines: DataFrame, values: str, keep: Sequence[str]) -> DataFrame:
    """Per line of whole numbers without nulls: count, sum, sum of value times place, and maximum, in the task that has the line.

    Empty lines give no row, as they have no pixels.
    """
    rows = lines.select(*keep, F.col(values).alias("_values"))
    sums = [T.StructField(c, T.LongType()) for c in ("n", "mass", "moment", "most")]
    return rows.mapInArrow(_moments, T.StructType([*[rows.schema[c] for c in keep], *sums]))


def page_shape(scan: DataFrame, values: str = "values", keys: Sequence[str] = (PAGE,)) -> DataFrame:
    """One row per page: height and width."""
    return scan.groupBy(*keys).agg(
        (F.max("y") + 1).cast("int").alias("height"), F.max(F.size(values)).alias("width")
    )


def attach_page_values(
    scan: DataFrame, facts: DataFrame, keys: Sequence[str] = (PAGE,), deal: str = "y", copies: int = 16,
    how: str = "inner",
) -> DataFrame:
    """Join one-row-per-page ``facts`` to scanlines without gathering a page in one task.

    The small side is copied ``copies`` times and the scanlines of a page are dealt over the copies
    by ``deal``, so a page with a third of all rows still spreads. When Spark finds the facts small
    enough it broadcasts them at run time and the copies cost nothing. A copy that is still far larger
    than the others is split once more by Spark's skew join, since nothing downstream needs its layout.
    """
    dealt = facts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return (
        scan.withColumn("_copy", F.pmod(F.col(deal), F.lit(copies)).cast("int"))
        .join(dealt, [*keys, "_copy"], how)
        .drop("_copy")
    )


def row_runs(values: Column, is_ink: Callable[[Column], Column]) -> Column:
    """Runs of ink inside one scanline as ``array<struct<x0,x1>>``, without a shuffle."""
    last = F.size(values) - 1
    at = lambda i: is_ink(F.get(values, i))
    inside = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(inside, lambda i: at(i) & ~F.coalesce(at(i - 1), F.lit(False)))
    ends = F.filter(inside, lambda i: at(i) & ~F.coalesce(at(i + 1), F.lit(False)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("x0"), (b + 1).alias("x1")))


def _runs_in(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, start and end of the runs of lists of booleans."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    ink = pc.fill_null(lists.flatten(), False).to_numpy(zero_copy_only=False).astype(bool)
    # Every line is led by paper, so no run goes on from one line to the next.
    line = np.arange(len(sizes))
    spaced = np.zeros(len(ink) + len(sizes) + 1, bool)
    spaced[np.arange(len(ink)) + np.repeat(line, sizes) + 1] = ink
    turns = np.flatnonzero(spaced[1:] != spaced[:-1]) + 1
    starts, stops = turns[::2], turns[1::2]
    head = ends - sizes + line + 1  # where a line's first pixel is
    row = np.searchsorted(head, starts, side="right") - 1
    return row, starts - head[row], stops - head[row]


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the lists of booleans in ``_ink``, with the other columns of their rows."""
    for batch in batches:
        row, starts, stops = _runs_in(batch.column("_ink"))
        kept = [batch.column(c).take(pa.array(row)) for c in batch.schema.names if c != "_ink"]
        yield pa.record_batch(
            [*kept, pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32))],
            names=[*[c for c in batch.schema.names if c != "_ink"], "x0", "x1"],
        )


def ink_runs(
    scan: DataFrame, is_ink: Callable[[Column], Column], values: str = "values", keep: Sequence[str] = ()
) -> DataFrame:
    """Run relation of a scanline relation: a condition per pixel, and runs of it found in the scanning task."""
    lines = scan.select(PAGE, "y", *keep, F.transform(values, is_ink).alias("_ink"))
    kept = [f for f in lines.schema.fields if f.name != "_ink"]
    ends = [T.StructField(c, T.IntegerType()) for c in ("x0", "x1")]
    return lines.mapInArrow(_runs_of, T.StructType([*kept, *ends]))


def runs_from_pixels(ink: DataFrame) -> DataFrame:
    """Runs by gaps and islands when only ink pixels are at hand; a window is one row of one page."""
    row = Window.partitionBy(PAGE, "y").orderBy("x")
    return (
        ink.withColumn("_island", F.col("x") - F.row_number().over(row))
        .groupBy(PAGE, "y", "_island")
        .agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
        .drop("_island")
    )


def run_overlap(left: DataFrame, right: DataFrame, by: Sequence[str] = (PAGE,)) -> DataFrame:
    """Total intersection length of two run relations per group.

    A sweep along each row: every run is one event where it begins and one where it ends. Between two events the
    numbers of open runs of both sides are constant, so their product times the distance is what overlaps. Rows
    are linear in the runs, whatever their number in one row of a page; runs without a key have no partner. Runs are
    shuffled, once; their events are made where they are swept. ``line_overlap`` shuffles no runs at all.
    """

    def sound(runs: DataFrame, a: int, b: int) -> DataFrame:
        whole = [F.col(c).isNotNull() for c in (*by, "y", "x0", "x1")]
        kept = runs.where(reduce(lambda p, q: p & q, whole) & (F.col("x0") < F.col("x1")))
        return kept.select(*by, "y", "x0", "x1", F.lit(a).alias("a"), F.lit(b).alias("b"))

    row = Window.partitionBy(*by, "y").orderBy("x")
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.struct(F.col(x).alias("x"), (F.col("a") * s).alias("a"), (F.col("b") * s).alias("b")) for x, s in (("x0", 1), ("x1", -1))]
    both = sound(left, 1, 0).unionByName(sound(right, 0, 1)).repartition(*by, "y")
    swept = both.select(*by, "y", F.inline(F.array(*ends))).select(
        *by, F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"), (F.lead("x").over(row) - F.col("x")).alias("n")
    )
    return swept.where("a > 0 AND b > 0 AND n > 0").groupBy(*by).agg(
        F.sum(F.col("a") * F.col("b") * F.col("n")).cast("bigint").alias("overlap")
    )


def _overlap_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersection length of the runs in ``_left`` and ``_right`` of each line that has any, with its other columns."""
    for batch in batches:
        sides = [_runs_in(batch.column(c)) for c in ("_left", "_right")]
        line = np.concatenate([r for row, _, _ in sides for r in (row, row)])
        x = np.concatenate([ends for _, starts, stops in sides for ends in (starts, stops)])
        a, b = (np.concatenate([np.full(len(row), s * (i == side)) for i, (row, _, _) in enumerate(sides) for s in (1, -1)]) for side in (0, 1))
        order = np.lexsort((x, line))
        line, x = line[order], x[order]
        # All runs of a line end in it, so nothing is open from one line to the next.
        n = (np.cumsum(a[order]) * np.cumsum(b[order]))[:-1] * np.diff(x)
        total = np.zeros(batch.num_rows, np.int64)
        np.add.at(total, line[:-1], n)
        met = np.flatnonzero(total)
        kept = [batch.column(c).take(pa.array(met)) for c in batch.schema.names if not c.startswith("_")]
        yield pa.record_batch([*kept, pa.array(total[met])], names=[*[c for c in batch.schema.names if not c.startswith("_")], "n"])


def line_overlap(
    scan: DataFrame, left: Callable[[Column], Column], right: Callable[[Column], Column], values: str = "values", by: Sequence[str] = (PAGE,)
) -> DataFrame:
    """``run_overlap`` of the ink runs of two conditions on the same scanlines.

    Both masks of a line are in one task, so its runs are found and swept there, from one reading of the lines, and
    what is shuffled is a sum per group.
    """
    lines = scan.select(*by, F.transform(values, left).alias("_left"), F.transform(values, right).alias("_right"))
    schema = T.StructType([*[lines.schema[c] for c in by], T.StructField("n", T.LongType())])
    return lines.mapInArrow(_overlap_of, schema).groupBy(*by).agg(F.sum("n").alias("overlap"))


def gray_from_image(images: DataFrame, page_id: str = PAGE) -> DataFrame:
    """Scanlines from Spark's image struct (BGR or BGRA or gray bytes), one row per image line."""
    from foliolake.functions import pixel

    hexed = F.hex("line")
    byte = lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    lines = images.select(
        F.col(page_id).alias(PAGE),
        F.col("image.width").alias("w"),
        F.col("image.nChannels").alias("n"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("image.height") - 1),
                lambda r: F.substr(
                    F.col("image.data"),
                    r * F.col("image.width") * F.col("image.nChannels") + 1,
                    F.col("image.width") * F.col("image.nChannels"),
                ),
            )
        ).alias("y", "line"),
    )

    def gray(i: Column) -> Column:
        base = i * F.col("n")
        b, g, r = byte(base), byte(base + 1), byte(base + 2)
        a = F.when(F.col("n") == 4, byte(base + 3)).otherwise(F.lit(255))
        colour = pixel.luma(pixel.over_white(r, a), pixel.over_white(g, a), pixel.over_white(b, a))
        return F.when(F.col("n") == 1, byte(base)).otherwise(colour)

    return lines.select(
        PAGE, "y", F.transform(F.sequence(F.lit(0), F.col("w") - 1), gray).alias("values")
    )
