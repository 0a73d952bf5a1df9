"""Score ratios with the two empty-denominator rules, and rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_one(numerator: Column, denominator: Column) -> Column:
    """Supervised ratio: nothing expected and nothing found is a perfect score."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(
        F.try_divide(numerator.cast("double"), denominator.cast("double"))
    )


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """Reference-free ratio: undefined when there is nothing to measure."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def binary_scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    dice = ratio_or_one(2 * tp, 2 * tp + fp + fn)
    return {
        "precision": ratio_or_one(tp, tp + fp),
        "recall": ratio_or_one(tp, tp + fn),
        "f1": dice,
        "dice": dice,
        "iou": ratio_or_one(tp, tp + fp + fn),
    }


def r6(value: Column) -> Column:
    """Six decimals, half up with a little slack, so summation order cannot flip a tie."""
    return F.floor(value * 1e6 + 0.50001) / F.lit(1e6)
