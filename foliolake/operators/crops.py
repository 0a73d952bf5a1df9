"""Deterministic foreground-aware training crops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolake.functions.rand import unit_uniform
from foliolake.operators import stencil
from foliolake.operators.raster import PAGE
from foliolake.operators.skew import dealt
from foliolake.session import checkpointed

ATTEMPTS = 20


def integral_rows(scan: DataFrame, member: str = "member", rows: int = stencil.BAND_ROWS) -> DataFrame:
    """``page_id, y, integral``: members above and left of each pixel, itself included.

    Sums run inside bands; what earlier bands add is one row per full band and column, accumulated by
    (page, column), so a tall page is never walked by one task.
    """
    inner = stencil.map_bands(
        scan, lambda p: {"inner": np.cumsum(np.cumsum(p[member], axis=0), axis=1)}, 0, (member,), {"inner": "int"}, rows=rows
    ).withColumn("band", F.floor(F.col("y") / rows))
    column = Window.partitionBy(PAGE, "x").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    above = (
        inner.where(F.col("y") % rows == rows - 1)
        .select(PAGE, "band", F.posexplode("inner").alias("x", "n"))
        .select(PAGE, (F.col("band") + 1).alias("band"), "x", F.sum("n").over(column).alias("n"))
        .groupBy(PAGE, "band")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "n"))), lambda c: c["n"]).alias("above"))
    )
    total = F.when(F.col("above").isNull(), F.col("inner").cast("array<bigint>")).otherwise(
        F.zip_with(F.col("inner"), "above", lambda a, b: a + b)
    )
    return inner.join(above, [PAGE, "band"], "left").select(PAGE, "y", total.alias("integral"))


def origin(length: Column, size: int, *parts) -> Column:
    """A crop start drawn uniformly over the page, 0 when the page is smaller than the crop."""
    return F.floor(unit_uniform(*parts) * F.greatest(length - size + 1, F.lit(1))).cast("int")


def _covered(table: pa.Table, rows: int) -> pa.Table | None:
    """Members under each asked piece of one band, from the summed areas of that band alone."""
    kind = table.column("kind").to_numpy()
    split = int(np.searchsorted(kind, 1))
    lines, asked = table.slice(0, split), table.slice(split)
    if not lines.num_rows or not asked.num_rows:
        return None
    plane = lines.column("member").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(split, -1)
    area = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(plane, axis=0, dtype=np.int64), axis=1, out=area[1:, 1:])
    base = table.column("band")[0].as_py() * rows
    y0, y1, x0, x1 = (asked.column(c).to_numpy() for c in ("y", "bottom", "left", "right"))
    y0, y1 = np.maximum(y0, base) - base, np.minimum(y1, base + plane.shape[0]) - base
    n = area[y1, x1] - area[y0, x1] - area[y1, x0] + area[y0, x0]
    return pa.table({**{c: asked.column(c) for c in (PAGE, "epoch", "index", "attempt")}, "n": pa.array(n)})


def covered_members(pieces: DataFrame, members: DataFrame, member: str = "member", rows: int = stencil.BAND_ROWS) -> DataFrame:
    """``page_id, epoch, index, attempt, n``: members inside ``[y, bottom) x [left, right)``, summed over bands.

    Lines (as bytes) and rectangles meet in bands; what leaves is one number per rectangle and band. Summed areas
    exist for one band at a time only. The rectangles of a page that is asked for very often are dealt over copies
    of its lines.
    """
    last = F.greatest(F.col("bottom") - 1, F.col("y"))  # an empty rectangle asks one band, not those before it
    span = F.sequence(F.floor(F.col("y") / rows).cast("int"), F.floor(last / rows).cast("int"))
    lines = members.select(
        PAGE, F.lit(0).alias("kind"), "y", F.transform(member, lambda m: m.cast("tinyint")).alias("member"),
        F.floor(F.col("y") / rows).cast("int").alias("band"),
    )
    asked, lines = dealt(pieces, lines, [PAGE], deal=F.xxhash64("epoch", "index", "attempt"))
    asked = asked.withColumn("kind", F.lit(1)).withColumn("band", F.explode(span))
    both = lines.unionByName(asked, allowMissingColumns=True)
    kept = [both.schema[c] for c in (PAGE, "epoch", "index", "attempt")]
    counted = stencil.map_groups(
        both, [PAGE, "band", "_copy"], ["kind", "y"], lambda groups: [_covered(t, rows) for t in groups],
        T.StructType([*kept, T.StructField("n", T.LongType())]),
    )
    return counted.groupBy(PAGE, "epoch", "index", "attempt").agg(F.sum("n").alias("n"))


def crop_plan(
    draws: DataFrame, members: DataFrame, size: int, foreground_fraction: float, minimum_occupancy: float, seed: int,
    member: str = "member",
) -> DataFrame:
    """One crop per draw ``(epoch, index, page_id, height, width)``: ``top, left`` and how it was chosen.

    ``members`` has scanlines of 0 and 1. Attempt 0 is the fallback. A foreground-aware crop takes the first of 20
    attempts with enough foreground; a uniform crop takes attempt 1; a page without foreground, or without lines, is
    uniform. An attempt asks each band that it covers for one number.
    """
    tag = (seed, F.col("epoch").cast("string"), F.col("index").cast("string"))
    filled = members.groupBy(PAGE).agg(F.max(F.array_max(member)).alias("_foreground"))
    # One row per draw is kept, so that attempts, pieces and the look for heavy pages do not read the lines again.
    drawn = checkpointed(draws.join(filled, PAGE, "left").withColumn(
        "aware", (unit_uniform(*tag, "aware") < foreground_fraction) & F.coalesce(F.col("_foreground") > 0, F.lit(False))
    ))
    last = F.when(F.col("aware"), F.lit(ATTEMPTS)).otherwise(F.lit(1))
    attempts = drawn.withColumn("attempt", F.explode(F.sequence(F.lit(0), last)))
    step = F.col("attempt").cast("string")
    attempts = attempts.withColumn("top", origin(F.col("height"), size, *tag, "top", step)).withColumn(
        "left", origin(F.col("width"), size, *tag, "left", step)
    )
    pieces = attempts.where(F.col("aware") & (F.col("attempt") > 0)).select(
        PAGE, "epoch", "index", "attempt", F.col("top").alias("y"), F.least(F.col("top") + size, F.col("height")).alias("bottom"),
        "left", F.least(F.col("left") + size, F.col("width")).alias("right"),
    )
    occupancy = covered_members(pieces, members, member).withColumn("occupancy", F.col("n") / float(size * size)).drop("n")
    tried = attempts.join(occupancy, [PAGE, "epoch", "index", "attempt"], "left")
    good = F.when(F.col("aware"), (F.coalesce(F.col("occupancy"), F.lit(0.0)) >= minimum_occupancy) & (F.col("attempt") > 0)).otherwise(F.col("attempt") == 1)
    place = F.struct("top", "left", "attempt")
    chosen = F.coalesce(
        F.min_by(F.when(good, place), F.when(good, F.col("attempt"))), F.min_by(place, F.col("attempt"))
    )
    return tried.groupBy("epoch", "index", PAGE).agg(F.first("aware").alias("aware"), chosen.alias("c")).select(
        "epoch", "index", PAGE, "aware", F.col("c.top").alias("top"), F.col("c.left").alias("left"), F.col("c.attempt").alias("attempt")
    )


def extract_crops(plan: DataFrame, scan: DataFrame, size: int, pad: int, values: str = "values") -> DataFrame:
    """Crop rows ``(epoch, index, cy, cells)`` of exactly ``size`` cells; outside the page is ``pad``."""
    rows = plan.select("epoch", "index", PAGE, "top", "left", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("cy"))
    rows = rows.withColumn("y", F.col("top") + F.col("cy"))
    cut = F.coalesce(F.slice(F.col(values), F.col("left") + 1, F.lit(size)), F.array().cast("array<int>"))
    return rows.join(scan.select(PAGE, "y", values), [PAGE, "y"], "left").select(
        "epoch", "index", PAGE, "cy", F.concat(cut, F.array_repeat(F.lit(pad), F.lit(size) - F.size(cut))).alias("cells")
    )
