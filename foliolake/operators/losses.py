"""Training losses as aggregates over logits and targets held as scanline arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import CLASSES
from foliolake.functions.pixel import sigmoid

EPSILON = 1e-6
EQUAL_WEIGHTS = {c: 1.0 for c in CLASSES}


def bce(z: Column, t: Column) -> Column:
    """Binary cross entropy of a logit, in the form that cannot overflow."""
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


def loss_sums(scan: DataFrame, keys: Sequence[str], logit: str = "logit", target: str = "target") -> DataFrame:
    """Per key: sums of p*t, p, t, cross entropy and pixels. All losses derive from these five sums,
    which combine before the shuffle."""
    px = scan.select(*keys, target, F.posexplode(logit).alias("x", "z")).select(
        *keys, "z", F.get(F.col(target), F.col("x")).cast("double").alias("t")
    )
    p, z, t = sigmoid(F.col("z")), F.col("z"), F.col("t")
    return px.groupBy(*keys).agg(
        F.sum(p * t).alias("pt"), F.sum(p).alias("p"), F.sum(t).alias("t"), F.sum(bce(z, t)).alias("bce"),
        F.count(F.lit(1)).alias("n"),
    )


def dice_term() -> Column:
    return F.lit(1.0) - (2.0 * F.col("pt") + EPSILON) / (F.col("p") + F.col("t") + EPSILON)


def class_weight(weights: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in weights.items():
        out = F.when(F.col("channel") == name, F.lit(float(weight))).otherwise(out)
    return out


def soft_dice(sums: DataFrame, by: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Soft Dice loss over items and channels, optionally weighted by class."""
    w = class_weight(weights) if weights else F.lit(1.0)
    return sums.groupBy(*by).agg((F.sum(w * dice_term()) / F.sum(w)).alias("dice_loss"))


def task_losses(
    sums: DataFrame, by: Sequence[str], task: str = "task", class_weights: Mapping[str, float] = EQUAL_WEIGHTS,
    cleaning_bce: float = 1.0, cleaning_dice: float = 1.0, segmentation_bce: float = 1.0,
    segmentation_dice: float = 1.0, clean_task: float = 1.0, segment_task: float = 1.0,
) -> DataFrame:
    """Clean, segment and total loss per group; only the terms of the group's task count.

    ``sums`` has ``item, channel`` (``cleaning`` and the four classes) besides ``by`` and ``task``.
    """
    cleaning = F.col("channel") == "cleaning"
    segment = ~cleaning
    w = class_weight(class_weights)
    mean_bce = lambda on, weight: F.sum(F.when(on, weight * F.col("bce"))) / F.sum(F.when(on, F.col("n")))
    clean_loss = cleaning_bce * mean_bce(cleaning, F.lit(1.0)) + cleaning_dice * F.avg(F.when(cleaning, dice_term()))
    segment_loss = segmentation_bce * mean_bce(segment, w) + segmentation_dice * (
        F.sum(F.when(segment, w * dice_term())) / F.sum(F.when(segment, w))
    )
    rows = sums.groupBy(*by, task).agg(clean_loss.alias("_clean"), segment_loss.alias("_segment"))
    clean = F.when(F.col(task).isin("clean", "multitask"), F.col("_clean"))
    segmented = F.when(F.col(task).isin("segment", "multitask"), F.col("_segment"))
    total = F.coalesce(clean * clean_task, F.lit(0.0)) + F.coalesce(segmented * segment_task, F.lit(0.0))
    return rows.select(
        *by, task, clean.alias("clean_loss"), segmented.alias("segment_loss"),
        F.when(clean.isNotNull() | segmented.isNotNull(), total).alias("total_loss"),
    )
