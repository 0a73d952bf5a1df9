"""The classical cleaning suite and its metrics in one band pass.

Scanlines and their targets are shuffled once, as bytes, to bands of their page; the rows of the light field that a
band needs travel with them. The same shuffle is read twice: first for the gray-level counts of the normalized page,
from which Spark finds the thresholds, then to make all variants and measure them. What leaves a band is 256 counts,
or some ten numbers per variant. Nothing is cached.

The halo of a line follows from its width, since the scale of the similarity does too: a page of scale ``s`` is
reduced inside the band, and a band owns the reduced rows that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import SSIM_C1, SSIM_C2
from foliolake.functions.pixel import predicted_ink
from foliolake.operators import stencil
from foliolake.operators.kernels import (
    CleaningConfig, cleaning_suite, light_field, morphology_steps, otsu_threshold, ssim, variant_planes,
)
from foliolake.operators.metrics import COUNTS, confusion_counts
from foliolake.operators.raster import PAGE, byte_line
from foliolake.session import checkpointed

ROWS = stencil.BAND_ROWS
#: Rows on either side that similarity needs, in rows of the page it is measured on.
_NEAR = 5
_FACTS, _LINE = 0, 1


def _cut(config: CleaningConfig) -> int:
    """Rows next to a cut whose variants are not those of the page."""
    steps = morphology_steps(config.morphology, config.iterations)
    return config.adaptive_block_size // 2 + len(steps) * (config.kernel_size // 2)


def halo(width: Column, config: CleaningConfig) -> Column:
    """Rows that a band needs around its own: the variants' reach and that of similarity at the page's scale.

    A page of ``width`` has at most the scale ``width / 256``; its reduced rows are up to 2 % taller than that.
    """
    scale = F.greatest(F.lit(1), F.rint(width / 256).cast("int"))
    return _cut(config) + F.when(scale == 1, _NEAR).otherwise(F.ceil((_NEAR + 1) * scale * 1.02).cast("int") + 2)


def banded(scan: DataFrame, config: CleaningConfig) -> tuple[DataFrame, DataFrame]:
    """(rows of all bands, page sizes): lines with their targets, and the light field rows under them."""
    field, sized = light_field(scan, config, whole=True)
    reach = halo(F.size("values"), config)
    lines = scan.withColumn("_halo", reach).select(
        PAGE, F.lit(_LINE).alias("kind"), "y", byte_line(F.col("values")).alias("line"), byte_line(F.col("clean")).alias("target"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("reduced_height"),
        F.explode(_bands(F.col("y") - F.col("_halo"), F.col("y") + F.col("_halo"))).alias("band"),
    )
    ratio = F.col("height") / F.col("reduced_height")
    low, high = (F.col("y") - 0.5) * ratio - 0.5, (F.col("y") + 1.5) * ratio + 0.5
    facts = field.join(sized, PAGE).withColumn("_halo", halo(F.col("width"), config))
    facts = facts.select(
        PAGE, F.lit(_FACTS).alias("kind"), "y", byte_line(F.col("field")).alias("line"), F.lit(None).cast("array<tinyint>").alias("target"),
        "height", "reduced_height",
        F.explode(_bands(low - F.col("_halo"), F.least(high, F.col("height") - 1.0) + F.col("_halo"))).alias("band"),
    )
    return lines.unionByName(facts).repartition(PAGE, "band"), sized


def _bands(low: Column, high: Column) -> Column:
    first = F.greatest(F.floor(low / ROWS), F.lit(0)).cast("int")
    return F.sequence(first, F.greatest(first, F.floor(high / ROWS).cast("int")))


class _Band:
    """One band of one page: its lines with halo, and where its own rows are."""

    def __init__(self, table: pa.Table):
        kind = table.column("kind").to_numpy()
        split = int(np.searchsorted(kind, _LINE))
        self.page, self.band = table.column(PAGE).slice(0, 1), table.column("band")[0].as_py()
        self.facts, self.lines = table.slice(0, split), table.slice(split)
        self.y = self.lines.column("y").to_numpy()
        low, high = np.searchsorted(self.y, [self.band * ROWS, (self.band + 1) * ROWS])
        self.core = slice(int(low), int(high))
        self.owned = split > 0 and low < high

    @property
    def height(self) -> int:
        return self.facts.column("height")[0].as_py()

    def normalized(self, rows: slice) -> np.ndarray:
        """Lines with the light field divided out."""
        plane = stencil.plane_of(self.lines.column("line").slice(rows.start, rows.stop - rows.start)).astype(np.float64)
        field = stencil.plane_of(self.facts.column("line")).astype(np.float64)
        first = self.facts.column("y")[0].as_py()
        at = np.maximum((self.y[rows] + 0.5) * (self.facts.column("reduced_height")[0].as_py() / self.height) - 0.5, 0.0)
        above = np.floor(at).astype(np.int64)
        weight = (at - above)[:, None]
        above -= first
        small = field[above] * (1 - weight) + field[np.minimum(above + 1, len(field) - 1)] * weight
        across = (np.arange(plane.shape[1]) + 0.5) * (small.shape[1] / plane.shape[1]) - 0.5
        across = np.clip(across, 0, small.shape[1] - 1)
        left = np.floor(across).astype(np.int64)
        right, share = np.minimum(left + 1, small.shape[1] - 1), across - left
        background = stencil.to_level(small[:, left] * (1 - share) + small[:, right] * share)
        return np.minimum(255, stencil.to_level(255 * plane / np.maximum(background, 1)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[_Band]:
    for tables in stencil.group_tables(batches, (PAGE, "band")):
        yield from (b for b in map(_Band, tables) if b.owned)


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for band in _groups(batches):
        counts = np.bincount(band.normalized(band.core).ravel(), minlength=256)
        yield pa.record_batch(
            [band.page.combine_chunks(), pa.array([counts.astype(np.int64)], pa.list_(pa.int64()))], names=[PAGE, "counts"]
        )


def _reduce(plane: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
    """Means between fractional edges along an axis, from running sums."""
    plane = np.moveaxis(plane, axis, 0)
    total = np.concatenate((np.zeros((1, plane.shape[1])), np.cumsum(plane, axis=0)))
    whole = np.minimum(np.floor(edges).astype(np.int64), len(plane))
    part = (edges - whole)[:, None]
    at = total[whole] + part * (total[np.minimum(whole + 1, len(plane))] - total[whole])
    return np.moveaxis(np.diff(at, axis=0) / np.diff(edges)[:, None], 0, axis)


class _Similarity:
    """The similarity of one band: targets are smoothed once for all variants."""

    def __init__(self, band: _Band, target: np.ndarray, cut: int):
        height, width = band.height, target.shape[1]
        self.taps = stencil.gaussian_taps(11, 1.5)
        scale = max(1, int(np.rint(min(height, width) / 256)))
        self.rows, self.columns, self.core = None, None, band.core
        if scale > 1:
            rows, columns = max(1, height // scale), max(1, width // scale)
            ratio, low, high = height / rows, int(band.y[0]), int(band.y[-1]) + 1
            first = 0 if low == 0 else int(np.ceil((low + cut) / ratio - 1e-9))
            last = rows if high == height else int(np.floor((high - cut) / ratio + 1e-9))
            self.rows = np.clip(np.arange(first, last + 1) * ratio - low, 0, high - low)
            self.columns = np.arange(columns + 1) * (width / columns)
            own = np.flatnonzero(np.floor(np.arange(first, last) * ratio + 1e-9) // ROWS == band.band)
            self.core = slice(int(own[0]), int(own[-1]) + 1) if len(own) else slice(0, 0)
        self.b = self.reduced(target)
        if self.core.start < self.core.stop:
            self.mean_b = self.near(self.b)
            self.var_b = self.near(self.b * self.b) - self.mean_b**2

    def reduced(self, plane: np.ndarray) -> np.ndarray:
        plane = plane.astype(np.float64)
        return plane if self.rows is None else _reduce(_reduce(plane, self.columns, 1), self.rows, 0)

    def near(self, plane: np.ndarray) -> np.ndarray:
        return stencil.smooth(plane, self.taps, "reflect")[self.core]

    def __call__(self, plane: np.ndarray) -> tuple[float, int]:
        if self.core.start == self.core.stop:
            return 0.0, 0
        a = self.reduced(plane)
        mean = self.near(a)
        var, cov = self.near(a * a) - mean**2, self.near(a * self.b) - mean * self.mean_b
        value = ((2 * mean * self.mean_b + SSIM_C1) * (2 * cov + SSIM_C2)) / (
            (mean**2 + self.mean_b**2 + SSIM_C1) * (var + self.var_b + SSIM_C2)
        )
        return float(value.sum()), int(value.size)


def _measurer(config: CleaningConfig):
    cut = _cut(config)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band in _groups(batches):
            if band.lines.column("threshold").null_count:
                continue  # a page without an id
            planes = variant_planes(band.normalized(slice(0, len(band.y))), band.lines.column("threshold")[0].as_py(), config)
            target = stencil.plane_of(band.lines.column("target"))
            score = _Similarity(band, target, cut)
            wanted = (255.0 - target[band.core]) / 255.0 >= config.target_ink_threshold
            out = {"variant": [], **{c: [] for c in COUNTS}, "total": [], "cells": []}
            for name, plane in planes.items():
                ink = plane[band.core] < 128
                total, cells = score(plane)
                counts = [(ink & wanted).sum(), (ink & ~wanted).sum(), (~ink & wanted).sum(), (~ink & ~wanted).sum()]
                for column, value in zip(out, [name, *map(int, counts), total, cells]):
                    out[column].append(value)
            n = len(planes)
            page = pa.concat_arrays([band.page.combine_chunks()] * n)
            threshold = pa.concat_arrays([band.lines.column("threshold").slice(0, 1).combine_chunks()] * n)
            types = [pa.string(), *[pa.int64()] * len(COUNTS), pa.float64(), pa.int64()]
            yield pa.record_batch(
                [page, threshold, *[pa.array(v, t) for v, t in zip(out.values(), types)]], names=[PAGE, "threshold", *out]
            )

    return measured


def suite_metrics(scan: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """``page_id, variant``, the four counts, ``ssim`` and ``threshold_value`` of the suite's variants.

    ``scan`` has ``page_id, y, values, clean`` with levels from 0 to 255. Pages that lack lines are measured
    apart, on the scanlines of ``cleaning_suite``.
    """
    gapped = stencil.gapped_pages(scan)
    if gapped is None:
        return _whole_pages(scan, config)
    torn = checkpointed(cleaning_suite(scan.join(gapped, PAGE, "left_semi"), config, keep=("clean",)))
    wanted = lambda v: (255.0 - v) / 255.0 >= config.target_ink_threshold
    keys = (PAGE, "variant")
    counts = confusion_counts(torn, "binary", "clean", predicted_ink, wanted, keys)
    levels = torn.groupBy(*keys).agg(F.max("threshold_value").alias("threshold_value"))
    apart = counts.join(ssim(torn, "binary", "clean", keys), list(keys)).join(levels, list(keys))
    return _whole_pages(scan.join(gapped, PAGE, "left_anti"), config).unionByName(apart)


def _whole_pages(scan: DataFrame, config: CleaningConfig) -> DataFrame:
    bands, sized = banded(scan, config)
    order = [PAGE, "band", "kind", "y"]
    page = f"`{PAGE}` {scan.schema[PAGE].dataType.simpleString()}"
    counts = bands.sortWithinPartitions(*order).mapInArrow(_level_counts, f"{page}, counts array<bigint>")
    hist = counts.select(PAGE, F.posexplode("counts").alias("v", "n")).where("n > 0").groupBy(PAGE, "v").agg(F.sum("n").alias("n"))
    thresholds = otsu_threshold(hist).join(sized.select(PAGE, "height"), PAGE).select(
        PAGE, "threshold", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / ROWS).cast("int"))).alias("band")
    )
    # An outer join, because an inner one would filter below the shuffle, which then were not the one read before.
    known = bands.join(thresholds.hint("shuffle_hash"), [PAGE, "band"], "left").select(*bands.columns, "threshold")
    known = known.sortWithinPartitions(*order)
    sums = f"{page}, threshold int, variant string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", total double, cells bigint"
    measured = known.mapInArrow(_measurer(config), sums)
    return measured.groupBy(PAGE, "variant").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.greatest(F.least(F.sum("total") / F.sum("cells"), F.lit(1.0)), F.lit(-1.0)).alias("ssim"),
        F.max(F.when(F.col("variant").startswith("otsu"), F.col("threshold"))).alias("threshold_value"),
    )
