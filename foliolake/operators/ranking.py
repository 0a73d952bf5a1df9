"""Row numbers over whole relations without one global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.operators.raster import attach_page_values
from foliolake.session import checkpointed


def _with_offsets(rows: DataFrame, bucket: str, order: Sequence[Column | str], out: str) -> DataFrame:
    """Rank inside each bucket plus the number of rows in earlier buckets.

    The offsets have one row per bucket, a count fixed by the caller, so sending them to every task
    is bounded whatever the data.
    """
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).select(
        bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(bucket).orderBy(*order)
    return (
        rows.join(F.broadcast(offsets), bucket)
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside)).cast("bigint"))
        .drop("_offset", bucket)
    )


def hash_rank(rows: DataFrame, digest: Column, ties: Sequence[str], out: str = "rank", hex_digits: int = 3) -> DataFrame:
    """1-based rank by a hex digest. Leading digits are an even, order-preserving bucketing."""
    keyed = rows.withColumn("_digest", digest)
    keyed = keyed.withColumn("_bucket", F.conv(F.substring("_digest", 1, hex_digits), 16, 10).cast("int"))
    return _with_offsets(keyed, "_bucket", ["_digest", *ties], out).drop("_digest")


ROWS_PER_PART = 250_000


def sorted_rank(rows: DataFrame, order: Sequence[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based rank by sort order over range partitions, as many as the counted rows need.

    Range bounds are sampled, so the partition numbers are frozen by a reliable checkpoint before
    they are counted.
    """
    if parts is None:
        parts = 1 + rows.count() // ROWS_PER_PART
    ranged = rows.repartitionByRange(parts, *order).withColumn("_bucket", F.spark_partition_id())
    return _with_offsets(checkpointed(ranged), "_bucket", list(order), out)


def rank_within(rows: DataFrame, group: str, order: Sequence[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based rank inside each group without gathering a group: the rank over all rows sorted by group
    and order, less the group's first rank. A group with a third of all rows spans many partitions."""
    ranked = sorted_rank(rows, [group, *order], "_global", parts)
    first = ranked.groupBy(group).agg(F.min("_global").alias("_first"))
    return attach_page_values(ranked, first, (group,), deal="_global").withColumn(
        out, F.col("_global") - F.col("_first") + 1
    ).drop("_global", "_first")
