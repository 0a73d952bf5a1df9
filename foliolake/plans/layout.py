"""Layout grid, layout seeds and margins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.functions.rand import hash_u64, int_between


@dataclass(frozen=True)
class LayoutGrid:
    staff_sizes: Sequence[float] = (12.0, 16.0, 20.0, 24.0)
    paper_formats: Sequence[str] = ("a4", "letter")
    orientations: Sequence[str] = ("portrait", "landscape")
    variants_per_combination: int = 1
    margin_range_mm: tuple[float, float] = (8.0, 16.0)


def layout_grid(sources: DataFrame, grid: LayoutGrid, seed: int) -> DataFrame:
    """Every layout of every source, expanded row by row from fixed option lists (no join).

    A layout's seed is the first 8 SHA-256 bytes of its own description, and its four margins are
    drawn from that seed on a 0.001 mm grid, so adding sources or options never changes a layout.
    """
    options = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    rows = (
        sources.select("source_id")
        .withColumn("staff_size", options([float(s) for s in grid.staff_sizes]))
        .withColumn("paper_format", options(grid.paper_formats))
        .withColumn("orientation", options(grid.orientations))
        .withColumn("variant_index", F.explode(F.sequence(F.lit(0), F.lit(grid.variants_per_combination - 1))))
    )
    described = [seed] + [F.col(c).cast("string") for c in ("source_id", "staff_size", "paper_format", "orientation", "variant_index")]
    rows = rows.withColumn("layout_seed", hash_u64(*described))
    low, high = (round(m * 1000) for m in grid.margin_range_mm)
    margin = lambda side: int_between(low, high, F.col("layout_seed").cast("string"), side) / F.lit(1000.0)
    return rows.withColumn("margins_mm", F.struct(*[margin(s).alias(s) for s in ("top", "bottom", "left", "right")]))
