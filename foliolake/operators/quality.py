"""Reference-free quality of cleaned pages against their own scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import QUALITY_METRICS
from foliolake.functions.score import ratio_or_null
from foliolake.operators import stencil
from foliolake.operators.kernels import histogram, otsu_pages, otsu_threshold
from foliolake.operators.metrics import grouped_finite_mean
from foliolake.operators.raster import PAGE, attach_page_values, row_runs

SQUARE = ((-1, 1), (0, 1), (1, 1))
KEYS = (PAGE, "comparison_id")


def count_tiny(ink: np.ndarray, core: slice, limit: int = 4) -> int:
    """Components of at most ``limit`` pixels (8-connected) whose first pixel lies in ``core``.

    Labels travel ``limit`` steps, which settles every component that small. A label is a whole
    component exactly when no neighbouring ink carries another label.
    """
    width = ink.shape[1]
    far = 1 << 30
    labels = np.where(ink, np.arange(ink.size, dtype=np.int32).reshape(ink.shape), far)
    for _ in range(limit):
        labels = np.where(ink, stencil.spread(labels, SQUARE, grow=False), far)
    highest = stencil.spread(np.where(ink, labels, -1), SQUARE, grow=True)
    lowest = stencil.spread(labels, SQUARE, grow=False)
    names, sizes = np.unique(labels[ink], return_counts=True)
    unsettled = np.unique(labels[ink & ((highest != labels) | (lowest != labels))])
    small = names[(sizes <= limit) & ~np.isin(names, unsettled)]
    rows = small // width
    return int(np.count_nonzero((rows >= core.start) & (rows < core.stop)))


def tiny_components(scan: DataFrame, ink: str = "ink", keys: Sequence[str] = (PAGE,)) -> DataFrame:
    """Tiny ink components per page; ``ink`` is 0/1 per pixel."""
    parts = stencil.reduce_bands(
        scan, lambda planes, core: {"n": count_tiny(planes[ink] > 0, core)}, 5, (ink,), {"n": "bigint"}, keys
    )
    return parts.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("tiny_components"))


def line_length(width: Column) -> Column:
    """Shortest run that counts as a staff-like line."""
    return F.greatest(F.lit(16), F.least(F.floor(width / 12), F.lit(128))).cast("int")


def line_sums(source: str, cleaned: str) -> tuple[Column, Column]:
    """Per scanline: pixels of long source runs, and how many of them lie on long cleaned runs.

    A line is a run of at least ``line_length`` pixels; a run cut by the page edge gets no credit for
    what lies outside. A row has at most ``width / 16`` long runs.
    """
    long_runs = lambda c: F.filter(
        row_runs(F.col(c), lambda v: v > 0), lambda r: r["x1"] - r["x0"] >= line_length(F.size(c))
    )
    length = F.aggregate(long_runs(source), F.lit(0), lambda acc, r: acc + r["x1"] - r["x0"])
    within = lambda r, runs: F.aggregate(
        runs, F.lit(0),
        lambda acc, s: acc + F.greatest(F.least(r["x1"], s["x1"]) - F.greatest(r["x0"], s["x0"]), F.lit(0)),
    )
    # The lambda variable keeps the cleaned runs of a row from being found again for each of its source runs.
    over = lambda runs: F.aggregate(long_runs(source), F.lit(0), lambda acc, r: acc + within(r, runs))
    kept = F.get(F.transform(F.array(long_runs(cleaned)), over), F.lit(0))
    return length.alias("line_source"), kept.alias("line_kept")


def line_retention(scan: DataFrame, source: str, cleaned: str, keys: Sequence[str] = (PAGE,)) -> DataFrame:
    """Retention of staff-like lines per page; NULL where the source has none."""
    rows = scan.select(*keys, *line_sums(source, cleaned)).groupBy(*keys).agg(
        F.sum("line_source").cast("bigint").alias("line_source"), F.sum("line_kept").cast("bigint").alias("line_kept")
    )
    return rows.withColumn("staff_like_line_retention", ratio_or_null(F.col("line_kept"), F.col("line_source")))


def seam_zone(position: Column, starts: Column) -> Column:
    """2 on a seam band (3 pixels at an internal tile start), 1 in its context, 0 elsewhere."""
    inner = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
    near = lambda reach: F.exists(inner, lambda s: F.abs(position - s) <= reach)
    return F.when(near(1), F.lit(2)).when(near(7), F.lit(1)).otherwise(F.lit(0))


def dynamic_tile_starts(length: Column, tile: Column, overlap: Column) -> Column:
    """Tile starts when tile size and overlap are columns."""
    last = length - tile
    grid = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.greatest(tile - overlap, F.lit(1)))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(grid, F.array(last))))


def quality_rows(scan: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One quality row per (page, comparison).

    ``scan`` has ``page_id, comparison_id, y, original array<int>, cleaned array<int>`` and the page-wide
    ``source, page_number, comparison_label, tile_size, overlap`` (tile size NULL for untiled results).
    A page-wide column ``height`` states how high pages are; without it a page ends with its last line.
    ``originals`` (``page_id, y, original``) saves one histogram per extra comparison. One aggregate over
    the scanlines counts ink, overlap, seam zones and line pixels (line runs are found inside each row);
    only tiny components need neighbouring rows.
    """
    height = F.first("height") if "height" in scan.columns else F.max("y") + 1
    facts = scan.groupBy(*KEYS).agg(
        F.first("source").alias("source"), F.first("page_number").alias("page_number"),
        F.first("comparison_label").alias("comparison_label"),
        F.first("tile_size").alias("tile_size"), F.first("overlap").alias("overlap"),
        height.cast("int").alias("height"), F.max(F.size("cleaned")).alias("width"),
    )
    tiled = F.col("tile_size").isNotNull() & (
        (F.col("height") > F.col("tile_size")) | (F.col("width") > F.col("tile_size"))
    )
    starts = lambda n: F.when(
        tiled, dynamic_tile_starts(F.col(n), F.col("tile_size"), F.col("overlap"))
    ).otherwise(F.array(F.lit(0)))
    columns = F.transform(
        F.sequence(F.lit(0), F.col("width") - 1), lambda x: seam_zone(x, F.col("column_starts"))
    )
    facts = (
        facts.withColumn("tiled", tiled)
        .withColumns({"row_starts": starts("height"), "column_starts": starts("width")})
        .withColumn("column_zone", columns)
    )
    if originals is None:
        otsu = otsu_threshold(histogram(scan, "original", KEYS), KEYS)
        known = facts.select(*KEYS, "row_starts", "column_zone").join(otsu, list(KEYS))
    else:
        known = facts.select(*KEYS, "row_starts", "column_zone").join(otsu_pages(originals, "original"), PAGE)
    rows = attach_page_values(
        scan.select(*KEYS, "y", "original", "cleaned"),
        known,
        KEYS,
    ).select(
        *KEYS, "y", seam_zone(F.col("y"), F.col("row_starts")).alias("row_zone"), "column_zone",
        F.transform("original", lambda v: (v <= F.col("threshold")).cast("int")).alias("source_ink"),
        F.transform("cleaned", lambda v: (v < 128).cast("int")).alias("ink"),
    )
    lined = rows.select("*", *line_sums("source_ink", "ink"))
    pixels = lined.select(
        *KEYS, "row_zone", "column_zone", "source_ink", "line_source", "line_kept", F.posexplode("ink").alias("x", "c")
    ).select(
        *KEYS, "c", F.get("source_ink", F.col("x")).alias("s"),
        *[F.when(F.col("x") == 0, F.col(n)).alias(n) for n in ("line_source", "line_kept")],
        F.greatest("row_zone", F.get("column_zone", F.col("x"))).alias("zone"),
    )
    zone = lambda z: F.sum((F.col("zone") == z).cast("int"))
    zone_ink = lambda z: F.sum(((F.col("zone") == z) & (F.col("c") > 0)).cast("int"))
    sums = pixels.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("c").alias("cleaned_count"), F.sum("s").alias("source_count"),
        F.sum(F.col("c") * F.col("s")).alias("both"),
        F.sum("line_source").alias("line_source"), F.sum("line_kept").alias("line_kept"),
        zone(2).alias("seam_n"), zone_ink(2).alias("seam_ink"), zone(1).alias("context_n"), zone_ink(1).alias("context_ink"),
    )
    joined = facts.join(sums, list(KEYS)).join(tiny_components(rows, "ink", KEYS), list(KEYS))
    density = lambda ink, n: F.coalesce(F.try_divide(F.col(ink) * 1.0, F.col(n)), F.lit(0.0))
    seam, context = density("seam_ink", "seam_n"), density("context_ink", "context_n")
    page_density = F.col("cleaned_count") / F.col("pixels")
    return joined.select(
        "source", "page_number", "comparison_id", "comparison_label", "width", "height",
        page_density.alias("cleaned_ink_fraction"),
        ratio_or_null(F.col("both"), F.col("source_count")).alias("source_ink_retention"),
        ratio_or_null(F.col("both"), F.col("cleaned_count")).alias("cleaned_ink_from_source_fraction"),
        (F.col("tiny_components") / (F.col("pixels") / 1e6)).alias("tiny_ink_components_per_megapixel"),
        ratio_or_null(F.col("line_kept"), F.col("line_source")).alias("staff_like_line_retention"),
        F.when(F.col("tiled"), F.abs(seam - context)).alias("tile_seam_discontinuity"),
        F.when(F.col("tiled"), F.try_divide(seam, page_density)).alias("tile_seam_ink_density_ratio"),
    )


def ordered_report(rows: DataFrame) -> DataFrame:
    """Report order: source, numeric page, comparison."""
    return rows.orderBy("source", F.col("page_number").cast("int"), "comparison_id")


def quality_summaries(rows: DataFrame) -> DataFrame:
    """Macro means of defined values per source and overall (source NULL)."""
    return grouped_finite_mean(rows, QUALITY_METRICS)
