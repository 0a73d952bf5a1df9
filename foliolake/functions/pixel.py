"""Per-pixel conversions (0 is black, 255 is white; masks are 255 for members)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolake.constants import OVERLAY_COLOURS


def intensity(v: Column) -> Column:
    return v / F.lit(255.0)


def ink_coverage(v: Column) -> Column:
    return F.lit(1.0) - v / F.lit(255.0)


def mask_member(v: Column) -> Column:
    return v / F.lit(255.0) >= 0.5


def predicted_ink(v: Column) -> Column:
    return v < 128


def target_ink(v: Column, threshold: float = 0.5) -> Column:
    return (F.lit(255.0) - v) / F.lit(255.0) >= threshold


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def probability_byte(p: Column) -> Column:
    """Probability to 8 bits, half to even."""
    return F.rint(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")


def cleaned_byte(p: Column, threshold: float = 0.5) -> Column:
    """Ink probability to the binary cleaned page: black where ink."""
    return F.when(p >= threshold, F.lit(0)).otherwise(F.lit(255))


def mask_byte(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, F.lit(255)).otherwise(F.lit(0))


def coverage_byte(v: Column, threshold: float = 0.5) -> Column:
    """Coverage thresholding; the cutoff rounds half to even."""
    return F.when(v >= round(threshold * 255), F.lit(255)).otherwise(F.lit(0))


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma with the ITU-R 601 weights in 16-bit fixed point."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16).cast("int")


def over_white(channel: Column, alpha: Column) -> Column:
    """Channel composited over a white page."""
    return F.floor((channel * alpha + (255 - alpha) * 255) / 255.0 + 0.5).cast("int")


def unit_scaled(values: Column) -> Column:
    """Arrays given in [0, 1] are brought to 0..255."""
    return F.when(F.array_max(values) <= 1, F.transform(values, lambda v: v * 255.0)).otherwise(
        F.transform(values, lambda v: v * 1.0)
    )


def overlay_channel(base: Column, masks: dict[str, Column], channel: int, inclusive_cutoff: int = 128) -> Column:
    """One colour channel of the mask overlay, blended in class order (``cutoff`` 128, or 1 for any ink)."""
    value = base.cast("double")
    for name, colour in OVERLAY_COLOURS.items():
        value = F.when(masks[name] >= inclusive_cutoff, value * 0.45 + 0.55 * colour[channel]).otherwise(value)
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)) + 1e-9).cast("int")
