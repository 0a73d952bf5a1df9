"""Joins on ids of which one may hold a large share of all rows.

``heavy_keys`` finds such ids with a mergeable sketch of frequent items: one narrow pass, a few kilobytes per task,
one row as a result. ``dealt_join`` deals only the rows of heavy ids over copies of their partners; all other ids
join plainly, so the partner side does not grow. Ids are compared by their 64-bit hashes when they are counted and
by themselves when they are joined; an id that is dealt without need costs copies, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: An id is heavy if it holds this share of the rows. Fewer than ``1 / SHARE`` ids can.
SHARE = 1 / 64
#: Parts over which the rows of a heavy id are dealt.
COPIES = 32
#: Items a sketch follows; its counts are off by at most a few rows in ``TRACKED``.
TRACKED = 8192


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _deal_hash(rows: DataFrame) -> Column:
    """A hash of whole rows, so equal tasks deal equal rows alike when they are run again."""
    plain = [f"`{f.name}`" for f in rows.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(*plain)


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: float = SHARE) -> DataFrame:
    """``key_hash`` of the ids with at least ``share`` of the rows, nulls included: fewer than ``1 / share`` rows."""
    most = int(1 / share) + 1
    counted = rows.select(_key_hash(keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total")
    )
    each = counted.select("total", F.explode("top").alias("t"))
    return each.where(F.col("t.count") >= share * F.col("total")).select(F.col("t.item").alias("key_hash"))


def dealt(
    rows: DataFrame, partners: DataFrame, keys: Sequence[str], share: float = SHARE, copies: int = COPIES,
    deal: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_copy``: the rows of a heavy id are dealt over copies, and its partners are in all of them.

    ``rows`` is read once more for its keys. The sketch is broadcast: it has fewer than ``1 / share`` rows. ``deal``
    (default: a hash of the row) places the rows of a heavy id; equal rows may share a place.
    """
    heavy = heavy_keys(rows, keys, share)
    place = F.pmod(_deal_hash(rows) if deal is None else deal, F.lit(copies)).cast("int")

    def marked(side: DataFrame) -> DataFrame:
        mark = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
        return side.withColumn("_key_hash", _key_hash(keys)).join(mark, F.col("_key_hash") == F.col("key_hash"), "left").drop("_key_hash", "key_hash")

    left = marked(rows.withColumn("_place", place)).withColumn("_copy", F.when(F.col("_heavy"), F.col("_place")).otherwise(0))
    last = F.when(F.col("_heavy"), copies - 1).otherwise(0)
    right = marked(partners).withColumn("_copy", F.explode(F.sequence(F.lit(0), last)))
    return left.drop("_heavy", "_place"), right.drop("_heavy")


def dealt_join(
    rows: DataFrame, partners: DataFrame, keys: Sequence[str], how: str = "inner", share: float = SHARE,
    copies: int = COPIES, deal: Column | None = None,
) -> DataFrame:
    """``rows`` joined to ``partners`` (inner, left, left_semi or left_anti) without gathering a heavy id."""
    left, right = dealt(rows, partners, keys, share, copies, deal)
    return left.join(right, [*keys, "_copy"], how).drop("_copy")
