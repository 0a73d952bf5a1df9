"""Thresholding and pixel metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.rasters import (
    DENSE, SCORES_SQL, SEED, TEXT, WEIGHTS, dense, otsu_sql, r6_sql, split_sql, textpage,
)
from foliolake.catalog.registry import query
from foliolake.functions.pixel import target_ink
from foliolake.functions.score import r6
from foliolake.operators import kernels, metrics, raster
from foliolake.plans.splits import split_of

SCORE_NAMES = ("precision", "recall", "f1", "dice", "iou")


def rounded(df, names=SCORE_NAMES):
    return df.withColumns({n: r6(F.col(n)) for n in names})


def otsu_counts(scan, keys=("page_id",)):
    """Otsu-cleaned page against its own thresholded target.

    Both are functions of a pixel's level, so the page's histogram, taken once, tells threshold and counts.
    """
    levels = kernels.levels_with_threshold(scan)
    p, t = F.col("v") <= F.col("threshold"), target_ink(F.col("v"))
    pixels = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return levels.groupBy(*keys).agg(
        pixels(p & t).alias("true_positive"),
        pixels(p & ~t).alias("false_positive"),
        pixels(~p & t).alias("false_negative"),
        pixels(~p & ~t).alias("true_negative"),
    )


COUNTS_SQL = """
counts AS (
  SELECT page_id,
         CAST(count(*) FILTER (WHERE v <= threshold AND v <= 127) AS BIGINT) AS true_positive,
         CAST(count(*) FILTER (WHERE v <= threshold AND v > 127) AS BIGINT) AS false_positive,
         CAST(count(*) FILTER (WHERE v > threshold AND v <= 127) AS BIGINT) AS false_negative,
         CAST(count(*) FILTER (WHERE v > threshold AND v > 127) AS BIGINT) AS true_negative
  FROM {pages} JOIN otsu USING (page_id) GROUP BY page_id
)"""

MICRO_SQL = """
scoped AS (
  SELECT *, split AS scope FROM tagged UNION ALL SELECT *, 'non_challenge' FROM tagged WHERE split <> 'challenge'
),
summed AS (
  SELECT scope, count(*) AS sample_count, CAST(sum(true_positive) AS BIGINT) AS true_positive,
         CAST(sum(false_positive) AS BIGINT) AS false_positive, CAST(sum(false_negative) AS BIGINT) AS false_negative,
         CAST(sum(true_negative) AS BIGINT) AS true_negative FROM scoped GROUP BY scope
)"""


@query(
    "otsu_split_scores",
    sql=f"WITH {DENSE}, {otsu_sql('dense')}, {COUNTS_SQL.format(pages='dense')}, "
    f"tagged AS (SELECT *, {split_sql('CAST(page_id AS VARCHAR)')} AS split FROM counts), {MICRO_SQL} "
    f"SELECT *, {SCORES_SQL} FROM summed",
)
def otsu_split_scores(spark, sf):
    """Per split, micro-averaged scores of Otsu-cleaned pages, challenge apart."""
    counts = otsu_counts(dense(spark, sf)).withColumn(
        "split", split_of(F.col("page_id").cast("string"), WEIGHTS, SEED)
    )
    return rounded(metrics.variant_summary(counts, by=()))


@query(
    "otsu_split_scores_text",
    sql=f"WITH {TEXT}, {otsu_sql('textpage')}, {COUNTS_SQL.format(pages='textpage')}, "
    f"tagged AS (SELECT *, {split_sql('CAST(page_id AS VARCHAR)')} AS split FROM counts), {MICRO_SQL} "
    f"SELECT *, {SCORES_SQL} FROM summed",
)
def otsu_split_scores_textpage(spark, sf):
    """The same over document pages, whose sizes differ by orders of magnitude."""
    counts = otsu_counts(textpage(spark, sf)).withColumn(
        "split", split_of(F.col("page_id").cast("string"), WEIGHTS, SEED)
    )
    return rounded(metrics.variant_summary(counts, by=()))
