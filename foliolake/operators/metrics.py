"""Confusion counts, derived scores and their micro and macro averages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import SPLITS
from foliolake.functions.score import binary_scores
from foliolake.operators.raster import PAGE

COUNTS = ("true_positive", "false_positive", "false_negative", "true_negative")


def confusion_counts(
    pairs: DataFrame,
    predicted: str,
    target: str,
    is_predicted: Callable[[Column], Column],
    is_target: Callable[[Column], Column],
    keys: Sequence[str] = (PAGE,),
) -> DataFrame:
    """TP/FP/FN/TN per group from scanlines that hold both layers.

    One array is exploded and the other read by position in the same generated loop, so pixels never
    leave the stage: each task sends one row of four partial counts per group.
    """
    p, t = is_predicted(F.col("pv")), is_target(F.get(F.col(target), F.col("x")))
    return (
        pairs.select(*keys, target, F.posexplode(predicted).alias("x", "pv"))
        .select(*keys, p.alias("p"), t.alias("t"))
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("p") & F.col("t")).alias("true_positive"),
            F.count_if(F.col("p") & ~F.col("t")).alias("false_positive"),
            F.count_if(~F.col("p") & F.col("t")).alias("false_negative"),
            F.count_if(~F.col("p") & ~F.col("t")).alias("true_negative"),
        )
    )


def with_scores(counts: DataFrame) -> DataFrame:
    scores = binary_scores(F.col("true_positive"), F.col("false_positive"), F.col("false_negative"))
    return counts.select("*", *[c.alias(n) for n, c in scores.items()])


def micro_average(pages: DataFrame, keys: Sequence[str], ssim: str | None = None) -> DataFrame:
    """Sum counts per group, derive scores from the sums, and average SSIM over samples."""
    extra = [F.avg(ssim).alias("ssim")] if ssim else []
    summed = pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), *[F.sum(c).cast("bigint").alias(c) for c in COUNTS], *extra
    )
    return with_scores(summed)


def with_scopes(pages: DataFrame, split: str = "split") -> DataFrame:
    """Each page under its own split and, unless it is a challenge page, under ``non_challenge``."""
    scopes = F.when(F.col(split) == "challenge", F.array(split)).otherwise(
        F.array(F.col(split), F.lit("non_challenge"))
    )
    return pages.withColumn("scope", F.explode(scopes))


def variant_summary(pages: DataFrame, ssim: str | None = None, by: Sequence[str] = ("variant",)) -> DataFrame:
    """Micro averages of populated splits plus the pool of everything but ``challenge``."""
    return micro_average(with_scopes(pages), [*by, "scope"], ssim)


def class_counts(pairs: DataFrame, keys: Sequence[str], predicted: str = "predicted", target: str = "target") -> DataFrame:
    """Per-class mask metrics from a long layer relation of scanlines (members are >= 128)."""
    member = lambda v: v >= 128
    return with_scores(confusion_counts(pairs, predicted, target, member, member, keys)).drop("true_negative", "f1")


def class_macro(per_class: DataFrame, keys: Sequence[str] = (PAGE,)) -> DataFrame:
    """Mean over the four classes and over the three foreground classes."""
    scores = ("precision", "recall", "dice", "iou")
    front = F.col("class") != "background"
    return per_class.groupBy(*keys).agg(
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[F.avg(F.when(front, F.col(s))).alias(f"foreground_macro_{s}") for s in scores],
    )


def consistency(masks: DataFrame, keys: Sequence[str] = (PAGE,)) -> DataFrame:
    """Unassigned and doubly assigned pixels; ``masks`` holds one array column per class."""
    pixels = masks.select(*keys, "staff", "notation", "text", F.posexplode("background").alias("x", "bg"))
    front = F.lit(False)
    for name in ("staff", "notation", "text"):
        front = front | (F.get(F.col(name), F.col("x")) >= 128)
    flags = pixels.select(*keys, (F.col("bg") >= 128).alias("b"), front.alias("f"))
    return flags.groupBy(*keys).agg(
        F.avg((~F.col("b") & ~F.col("f")).cast("double")).alias("all_false_rate"),
        F.avg((F.col("b") & F.col("f")).cast("double")).alias("background_overlap_rate"),
    )


def split_macro(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model",), splits: Sequence[str] = SPLITS) -> DataFrame:
    """Macro mean of every float metric per split; requested splits without rows keep a zero count."""
    found = rows.groupBy(*by, "split").agg(
        F.count(F.lit(1)).alias("sample_count"), *[F.avg(m).alias(m) for m in metrics]
    )
    asked = rows.select(*by).distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    return asked.join(found, [*by, "split"], "left").withColumn(
        "sample_count", F.coalesce("sample_count", F.lit(0).cast("bigint"))
    )


def split_counts(rows: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Rows per split, zero splits included, in one aggregation row unpivoted to one row per split."""
    counted = rows.agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits])
    return counted.select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in splits]))
    )


def grouped_finite_mean(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Macro means over non-null values per (source, comparison) and per comparison.

    One shuffle: the overall rows are one more grouping set, not a second pass.
    """
    pages = F.count(F.lit(1)).alias("page_count")
    return rows.groupingSets(
        [["source", "comparison_id"], ["comparison_id"]], "source", "comparison_id"
    ).agg(F.min("comparison_label").alias("comparison_label"), pages, *[F.avg(m).alias(m) for m in metrics])


def dimension_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages whose two rasters disagree in size or exist on one side only."""
    a = left.select(PAGE, F.col("height").alias("left_height"), F.col("width").alias("left_width"))
    b = right.select(PAGE, F.col("height").alias("right_height"), F.col("width").alias("right_width"))
    same = F.col("left_height").eqNullSafe(F.col("right_height")) & F.col("left_width").eqNullSafe(F.col("right_width"))
    return a.join(b, PAGE, "full").where(~same)
