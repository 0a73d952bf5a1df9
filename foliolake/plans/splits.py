"""Source-isolated split assignment and split selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import SPLITS
from foliolake.functions.rand import hash_fraction


def split_of(source_id: Column, weights: Mapping[str, float], seed: int) -> Column:
    """The split of a source as a column expression: no state, so no source can ever leak."""
    if set(weights) != set(SPLITS):
        raise ValueError(f"split weights must name exactly {', '.join(SPLITS)}")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("at least one split weight must be positive")
    fraction, edge, choice = hash_fraction(seed, source_id), 0.0, None
    for split in SPLITS:
        edge += weights[split] / total
        hit = fraction < edge
        choice = F.when(hit, F.lit(split)) if choice is None else choice.when(hit, F.lit(split))
    return choice.otherwise(F.lit(SPLITS[-1]))


def selected_splits(asked: Sequence[str] | None) -> tuple[str, ...]:
    """Requested splits in canonical order; unknown names and an empty selection are refused."""
    if asked is None:
        return SPLITS
    if not asked:
        raise ValueError("no split is selected")
    unknown = sorted(set(asked) - set(SPLITS))
    if unknown:
        raise ValueError(f"unknown split(s): {', '.join(unknown)}")
    return tuple(s for s in SPLITS if s in asked)


def filter_splits(rows: DataFrame, asked: Sequence[str] | None) -> DataFrame:
    """Rows of the asked splits with their canonical position; pushed to the scan as a predicate."""
    chosen = selected_splits(asked)
    position = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    return rows.where(F.col("split").isin(*chosen)).withColumn("split_order", position)


def split_leaks(rows: DataFrame) -> DataFrame:
    """Sources that occur in more than one split."""
    return (
        rows.groupBy("source_id")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )
