"""Layer algebra on class masks and coverage layers held as array columns of one scanline row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import CLASSES, FOREGROUND, TRAINABLE_CLASSES
from foliolake.functions.pixel import coverage_byte
from foliolake.operators.raster import PAGE


def union(*layers: Column) -> Column:
    out = layers[0]
    for layer in layers[1:]:
        out = F.zip_with(out, layer, lambda a, b: F.greatest(a, b))
    return out


def intersection(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def complement(layer: Column) -> Column:
    return F.transform(layer, lambda v: 255 - v)


def subtract(a: Column, b: Column) -> Column:
    """Saturating difference of two coverages."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0)))


def with_background(scan: DataFrame) -> DataFrame:
    """Background as the exact complement of the union of the foreground layers."""
    return scan.withColumn("background", complement(union(*[F.col(c) for c in FOREGROUND])))


def masks_from_layers(scan: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class masks from rendered layers ``none, staff, notation, text`` (gray intensities).

    The empty-paper layer is taken out of staff and notation; text keeps its full coverage.
    """
    paper = complement(F.col("none"))
    cut = lambda coverage: F.transform(coverage, lambda v: coverage_byte(v, threshold))
    return with_background(
        scan.withColumns(
            {
                "staff": cut(subtract(complement(F.col("staff")), paper)),
                "notation": cut(subtract(complement(F.col("notation")), paper)),
                "text": cut(complement(F.col("text"))),
            }
        )
    )


def stack_layers(scan: DataFrame, names: Sequence[str] = CLASSES, out: str = "values") -> DataFrame:
    """Layer columns to one row per (page, y, class); no shuffle."""
    cells = F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias(out)) for n in names])
    return scan.select(PAGE, "y", F.inline(cells))


def combine_layers(long: DataFrame, names: Sequence[str] = CLASSES) -> DataFrame:
    """Several layers of one page side by side again; the names are fixed, so no extra scan."""
    return long.groupBy(PAGE, "y").pivot("class", list(names)).agg(F.first("values"))


def mask_levels(long: DataFrame) -> DataFrame:
    """Per page and class: members, non-binary pixels and the largest value."""
    v = F.col("v")
    return (
        long.select(PAGE, "class", F.explode("values").alias("v"))
        .groupBy(PAGE, "class")
        .agg(
            F.count_if(v == 255).alias("foreground_pixels"),
            F.count_if(~v.isin(0, 255)).alias("nonbinary_pixels"),
            F.max("v").alias("max_value"),
            F.count(F.lit(1)).alias("pixels"),
        )
    )


def mask_problems(scan: DataFrame, expected_nonempty: Sequence[str] = TRAINABLE_CLASSES) -> DataFrame:
    """Every mask rule that a page breaks, one row per problem, in a single aggregation pass.

    A background pixel is judged against the complement of the foreground union at its place.
    """
    others = [F.get(F.col(c), F.col("x")) for c in FOREGROUND]
    px = scan.select(PAGE, *FOREGROUND, F.posexplode("background").alias("x", "background_v"))
    px = px.select(PAGE, "background_v", *[o.alias(c + "_v") for o, c in zip(others, FOREGROUND)])
    front = F.greatest(*[F.col(c + "_v") for c in FOREGROUND])
    back = F.col("background_v")
    sums = px.groupBy(PAGE).agg(
        *[F.count_if(~F.col(c + "_v").isin(0, 255)).alias("nonbinary_" + c) for c in CLASSES],
        *[F.max(c + "_v").alias("max_" + c) for c in FOREGROUND],
        F.count_if(back != 255 - front).alias("not_complement"),
        F.count_if((back > 0) & (front > 0)).alias("overlap"),
    )
    rules = [F.when(F.col("nonbinary_" + c) > 0, F.lit(f"{c} mask is not binary")) for c in CLASSES]
    rules += [F.when(F.col("max_" + c) == 0, F.lit(f"expected nonempty {c} mask")) for c in expected_nonempty]
    rules += [
        F.when(F.col("not_complement") > 0, F.lit("background is not the foreground complement")),
        F.when(F.col("overlap") > 0, F.lit("background overlaps foreground")),
    ]
    return sums.select(PAGE, F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def trainable_pages(levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pages, skipped pages with the names of their empty required masks)."""
    empty = F.filter(
        F.array(
            *[
                F.when(F.max(F.when(F.col("class") == c, F.col("max_value"))) == 0, F.lit(c))
                for c in TRAINABLE_CLASSES
            ]
        ),
        lambda c: c.isNotNull(),
    )
    pages = levels.groupBy(PAGE).agg(empty.alias("missing_masks"))
    return pages.where(F.size("missing_masks") == 0).select(PAGE), pages.where(F.size("missing_masks") > 0)
