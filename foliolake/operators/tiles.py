"""Overlapping tiles: starts, cutting, padding, scoring with a user's model, blending, results.

Nothing is grouped by page. A scoring group is one row of tiles, a blending group one band of rows, so
the memory of a task does not grow with the height of a page.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import CLASSES
from foliolake.functions import pixel
from foliolake.operators.raster import PAGE, attach_page_values, byte_lines, page_shape
from foliolake.operators.stencil import band_rows, list_of, map_groups, plane_of

CHANNELS = ("cleaning", *CLASSES)
Scorer = Callable[[np.ndarray], np.ndarray]


def check_settings(
    tile: int, overlap: int, cleaning_threshold: float = 0.5, segmentation_threshold: float = 0.5, multiple: int = 16
) -> None:
    """Refuse settings that no page can be scored with; ``multiple`` is what the network halves its input by."""
    if tile < multiple or tile % multiple:
        raise ValueError(f"tile must be at least {multiple} and divisible by {multiple}")
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be in [0, tile)")
    if not 0 <= cleaning_threshold <= 1 or not 0 <= segmentation_threshold <= 1:
        raise ValueError("thresholds must be in [0, 1]")


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """0, stride, ... and a last start flush with the edge; a single 0 when the page fits."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be in [0, tile)")
    last = length - tile
    grid = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(tile - overlap))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(grid, F.array(last))))


def tile_grid(shape: DataFrame, tile: int, overlap: int) -> DataFrame:
    """One row per tile of each page, with its real size."""
    size = lambda length, start: F.least(F.lit(tile), F.col(length) - F.col(start))
    return (
        shape.withColumn("top", F.explode(tile_starts(F.col("height"), tile, overlap)))
        .withColumn("left", F.explode(tile_starts(F.col("width"), tile, overlap)))
        .withColumn("tile_height", size("height", "top"))
        .withColumn("tile_width", size("width", "left"))
    )


def _tops(tile: int, overlap: int) -> Column:
    """Starts of the tile rows that cover ``y``, by arithmetic: only starts near ``y`` are looked at."""
    stride = tile - overlap
    last = F.greatest(F.col("height") - tile, F.lit(0))
    k0 = F.greatest(F.ceil((F.col("y") - tile + 1) / F.lit(stride)), F.lit(0)).cast("int")
    k1 = F.least(F.floor(F.col("y") / stride), F.floor(last / stride)).cast("int")
    none = F.array().cast("array<int>")
    regular = F.when(k0 <= k1, F.transform(F.sequence(k0, k1), lambda k: k * stride)).otherwise(none)
    return F.array_distinct(F.concat(regular, F.when(F.col("y") >= last, F.array(last)).otherwise(none)))


def cut_strips(scan: DataFrame, tile: int, overlap: int, values: str = "values", height: int | None = None) -> DataFrame:
    """Scanlines dealt to the rows of tiles that cover them (``top``), without a range join.

    ``height`` is that of all pages, where it is known; otherwise a page ends with its last line.
    """
    shape = page_shape(scan, values)
    if height is not None:
        shape = shape.withColumn("height", F.lit(height))
    shaped = attach_page_values(scan.select(PAGE, "y", F.col(values).alias("line")), shape)
    return shaped.withColumn("top", F.explode(_tops(tile, overlap)))


def cut_tiles(scan: DataFrame, tile: int, overlap: int, values: str = "values", height: int | None = None) -> DataFrame:
    """Scanline pieces per tile; ``height`` as in ``cut_strips``."""
    pieces = cut_strips(scan, tile, overlap, values, height).withColumn("left", F.explode(tile_starts(F.col("width"), tile, overlap)))
    return pieces.select(
        PAGE, "height", "width", "top", "left", "y", F.slice("line", F.col("left") + 1, F.lit(tile)).alias("piece")
    )


def reflect_index(position: Column, length: Column) -> Column:
    """Source index of a padded position: repeated reflection without repeating the edge pixel."""
    period = F.greatest(2 * (length - 1), F.lit(1))
    folded = F.pmod(position, period)
    return F.when(length == 1, F.lit(0)).otherwise(F.least(folded, period - folded)).cast("int")


def padded_tiles(pieces: DataFrame, tile: int) -> DataFrame:
    """Tiles of exactly ``tile`` x ``tile`` as rows ``(page, top, left, ty, cells)``.

    A tile that is one pixel high or wide is extended by its edge on both axes.
    """
    h = F.least(F.lit(tile), F.col("height") - F.col("top"))
    w = F.least(F.lit(tile), F.col("width") - F.col("left"))
    thin = (h == 1) | (w == 1)
    source = lambda i, n: F.when(thin, F.least(i, n - 1)).otherwise(reflect_index(i, n))
    targets = F.filter(
        F.sequence(F.lit(0), F.lit(tile - 1)), lambda i: source(i, h) == F.col("y") - F.col("top")
    )
    cells = F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda i: F.get(F.col("piece"), source(i, w)))
    return pieces.select(PAGE, "top", "left", F.explode(targets).alias("ty"), cells.alias("cells"))


def blend_axis(size: int) -> np.ndarray:
    """Symmetric raised cosine, kept above zero so page borders stay covered."""
    at = np.arange(size)
    return np.maximum(0.5 - 0.5 * np.cos(2 * np.pi * at / max(size - 1, 1)), 1e-3)


def blend_weight(position: Column, size: int) -> Column:
    return F.greatest(0.5 - 0.5 * F.cos(2 * F.pi() * position / float(max(size - 1, 1))), F.lit(1e-3))


def _pad(tile_values: np.ndarray, size: int) -> np.ndarray:
    height, width = tile_values.shape
    if height == 1 or width == 1:
        return np.pad(tile_values, ((0, size - height), (0, size - width)), mode="edge")
    return np.pad(tile_values, ((0, size - height), (0, size - width)), mode="reflect")


def _starts(length: int, tile: int, overlap: int) -> list[int]:
    if length <= tile:
        return [0]
    return sorted({*range(0, length - tile + 1, tile - overlap), length - tile})


def score_strips(
    strips: DataFrame, scorer: Scorer, tile: int, overlap: int, logits: str = "float", cells_per_call: int = 1 << 22
) -> DataFrame:
    """Run ``scorer`` on batches of tiles: ``(n, tile, tile)`` intensities to ``(n, 5, tile, tile)`` logits.

    A group is one row of tiles, at most ``tile`` scanlines. Tiles beside each other are blended here,
    so what leaves for the vertical blend is one logit per pixel, channel and tile row. The channels
    are the cleaning logit and the four class logits. ``scorer`` is serialized to the executors once
    per task; load weights lazily in it.
    """
    axis = blend_axis(tile)
    arrow = {"float": pa.float32(), "double": pa.float64()}[logits]
    lists = ", ".join(f"{c} array<{logits}>" for c in CHANNELS)
    at_once = max(1, cells_per_call // (tile * tile))

    def score(tables: list[pa.Table]) -> list[pa.Table]:
        planes = [plane_of(t.column("line")).astype(np.float64) / 255.0 for t in tables]
        places = [(i, left) for i, plane in enumerate(planes) for left in _starts(plane.shape[1], tile, overlap)]
        total = [np.zeros((len(CHANNELS), *plane.shape)) for plane in planes]
        seconds = np.zeros(len(tables))
        for first in range(0, len(places), at_once):
            batch = places[first : first + at_once]
            stack = np.stack([_pad(planes[i][:, left : left + tile], tile) for i, left in batch])
            started = time.perf_counter()
            result = scorer(stack)
            each = (time.perf_counter() - started) / len(batch)
            for (i, left), z in zip(batch, result):
                height, width = planes[i].shape[0], min(tile, planes[i].shape[1] - left)
                total[i][:, :, left : left + width] += z[:, :height, :width] * axis[:width]
                seconds[i] += each
        return [blended(t, z, s) for t, z, s in zip(tables, total, seconds)]

    def blended(table: pa.Table, total: np.ndarray, seconds: float) -> pa.Table:
        _, height, width = total.shape
        weight = np.zeros(width)
        for left in _starts(width, tile, overlap):
            weight[left : left + tile] += axis[: min(tile, width - left)]
        total /= weight
        return pa.table(
            {
                **{c: table.column(c) for c in (PAGE, "top", "y")},
                **{c: list_of(total[i], arrow) for i, c in enumerate(CHANNELS)},
                "row_weight": pa.array(axis[:height], pa.float64()),
                "seconds": pa.array(np.full(height, seconds / height), pa.float64()),
            }
        )

    d = dict(strips.dtypes)
    return map_groups(
        strips, [PAGE, "top"], ["y"], score,
        f"{PAGE} {d[PAGE]}, top {d['top']}, y {d['y']}, {lists}, row_weight double, seconds double",
    )


def blend_rows(scored: DataFrame, band: int = 64) -> DataFrame:
    """Weighted mean of the tile rows over each scanline; a group is one band of rows of one page."""
    dtype = dict(scored.dtypes)
    arrow = {"array<float>": pa.float32(), "array<double>": pa.float64()}[dtype[CHANNELS[0]]]
    lists = ", ".join(f"{c} {dtype[c]}" for c in CHANNELS)

    def blend(table: pa.Table) -> pa.Table:
        y, top, weight = (table.column(c).to_numpy() for c in ("y", "top", "row_weight"))
        low, high = int(y.min()), int(y.max()) + 1
        cuts = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(y)]
        summed = np.zeros(high - low)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            summed[y[lo] - low : y[hi - 1] - low + 1] += weight[lo:hi]
        out = {}
        for c in CHANNELS:
            plane = plane_of(table.column(c))
            total = np.zeros((high - low, plane.shape[1]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                total[y[lo] - low : y[hi - 1] - low + 1] += plane[lo:hi] * weight[lo:hi, None]
            out[c] = list_of(total / summed[:, None], arrow)
        page = pa.array([table.column(PAGE)[0].as_py()] * (high - low), table.column(PAGE).type)
        return pa.table({PAGE: page, "y": pa.array(np.arange(low, high), table.column("y").type), **out})

    return map_groups(
        scored.withColumn("band", F.floor(F.col("y") / band)), [PAGE, "band"], ["top", "y"],
        lambda tables: [blend(t) for t in tables], f"{PAGE} {dtype[PAGE]}, y {dtype['y']}, {lists}",
    )


def score_pages(
    scan: DataFrame, scorer: Scorer, tile: int, overlap: int, values: str = "values", logits: str = "float",
    multiple: int = 16,
) -> DataFrame:
    """Blended logits per scanline for whole pages of any size."""
    check_settings(tile, overlap, multiple=multiple)
    return _score_bands(scan, scorer, tile, overlap, values, logits)


def _score_bands(
    scan: DataFrame, scorer: Scorer, tile: int, overlap: int, values: str, logits: str, cells_per_call: int = 1 << 22
) -> DataFrame:
    """Bands of lines with the whole tiles that reach into them, scored and blended in one task.

    Only scanlines are shuffled, as bytes (with their levels beside them, if those are no bytes); logits, forty bytes and
    more a pixel, leave no task before they are blended.
    Tiles over a cut are scored on both sides, which are some six in a hundred at 512 rows and tiles of 32.
    """
    rows, axis = max(4 * tile, 512), blend_axis(tile)
    arrow = {"float": pa.float32(), "double": pa.float64()}[logits]
    at_once = max(1, cells_per_call // (tile * tile))
    line, wide = byte_lines(F.col(values))
    shaped = attach_page_values(
        scan.select(PAGE, "y", line.alias("line"), wide.alias("wide")), page_shape(scan, values).select(PAGE, "height")
    )
    bands = band_rows(shaped, tile - 1, rows)

    def score(table: pa.Table) -> pa.Table | None:
        y, band = table.column("y").to_numpy(), table.column("band")[0].as_py()
        low, high = np.searchsorted(y, [band * rows, (band + 1) * rows])
        if low == high:
            return None
        plane = plane_of(table.column("line")).astype(np.float64)
        wide = table.column("wide")
        if wide.null_count < len(wide):
            plane[wide.is_valid().to_numpy()] = plane_of(wide.drop_null())
        plane /= 255.0
        begin, end = int(y[low]), int(y[high - 1]) + 1
        tops = [t for t in _starts(table.column("height")[0].as_py(), tile, overlap) if t < end and t + tile > begin]
        lefts = _starts(plane.shape[1], tile, overlap)
        places = [(t, left) for t in tops for left in lefts]
        across = np.zeros(plane.shape[1])
        for left in lefts:
            across[left : left + tile] += axis[: min(tile, plane.shape[1] - left)]
        total, summed = np.zeros((len(CHANNELS), high - low, plane.shape[1])), np.zeros(high - low)
        for top in tops:
            lo, hi = np.searchsorted(y, [max(top, begin), min(top + tile, end)])
            summed[lo - low : hi - low] += axis[y[lo:hi] - top]
        for start in range(0, len(places), at_once):
            batch = places[start : start + at_once]
            cuts = [np.searchsorted(y, [top, top + tile]) for top, _ in batch]
            stack = np.stack([_pad(plane[a:b, left : left + tile], tile) for (a, b), (_, left) in zip(cuts, batch)])
            for (a, b), (top, left), z in zip(cuts, batch, scorer(stack)):
                lo, hi, width = max(a, low), min(b, high), min(tile, plane.shape[1] - left)
                weight = axis[lo - a : hi - a, None] * axis[:width]
                total[:, lo - low : hi - low, left : left + width] += z[:, lo - a : hi - a, :width] * weight
        total /= summed[:, None] * across
        kept = table.slice(low, high - low)
        return pa.table(
            {**{c: kept.column(c) for c in (PAGE, "y")}, **{c: list_of(total[i], arrow) for i, c in enumerate(CHANNELS)}}
        )

    d, lists = dict(bands.dtypes), ", ".join(f"{c} array<{logits}>" for c in CHANNELS)
    return map_groups(bands, [PAGE, "band"], ["y"], lambda tables: [score(t) for t in tables], f"{PAGE} {d[PAGE]}, y {d['y']}, {lists}")


def page_results(
    logits: DataFrame, cleaning_threshold: float = 0.5, segmentation_threshold: float = 0.5
) -> DataFrame:
    """Cleaned page, probabilities and masks as layers of each scanline."""
    check_settings(16, 0, cleaning_threshold, segmentation_threshold)
    prob = lambda c: F.transform(F.col(c), pixel.sigmoid)
    probabilities = logits.select(PAGE, "y", *[prob(c).alias(c) for c in CHANNELS])
    byte = lambda c: F.transform(F.col(c), pixel.probability_byte)
    mask = lambda c: F.transform(F.col(c), lambda p: pixel.mask_byte(p, segmentation_threshold))
    clean = F.transform(F.col("cleaning"), lambda p: pixel.cleaned_byte(p, cleaning_threshold))
    return probabilities.select(
        PAGE, "y", clean.alias("cleaned"), byte("cleaning").alias("probability"),
        *[mask(c).alias(c) for c in CLASSES],
        *[byte(c).alias(c + "_probability") for c in CLASSES],
    )


def page_metadata(scan: DataFrame, tile: int, overlap: int, values: str = "values") -> DataFrame:
    """Per page: size, tile settings and tile count, kept with the results."""
    rows = F.size(tile_starts(F.col("height"), tile, overlap))
    columns = F.size(tile_starts(F.col("width"), tile, overlap))
    return page_shape(scan, values).select(
        PAGE, "height", "width", F.lit(tile).alias("tile_size"), F.lit(overlap).alias("overlap"),
        (rows * columns).alias("tile_count"),
    )


def page_facts(
    scan: DataFrame, pages: DataFrame, tile: int, overlap: int, cleaning_threshold: float = 0.5,
    segmentation_threshold: float = 0.5, values: str = "values", multiple: int = 16,
) -> DataFrame:
    """``page_metadata`` with the page's own facts and the thresholds its results were made with.

    ``pages`` has ``page_id, page_number, dpi``; a page that it does not name keeps its row with nulls.
    """
    check_settings(tile, overlap, cleaning_threshold, segmentation_threshold, multiple)
    return page_metadata(scan, tile, overlap, values).join(pages.select(PAGE, "page_number", "dpi"), PAGE, "left").withColumns(
        {"cleaning_threshold": F.lit(float(cleaning_threshold)), "segmentation_threshold": F.lit(float(segmentation_threshold))}
    )


def blend_pixels(contributions: DataFrame) -> DataFrame:
    """Blending in pixel form, for contributions that do not come as tile rows.

    ``contributions`` has ``page_id, y, x, channel, weight, logit``; sums combine before the shuffle.
    """
    w, z = F.col("weight"), F.col("logit")
    return contributions.groupBy(PAGE, "y", "x", "channel").agg((F.sum(w * z) / F.sum(w)).alias("logit"))
