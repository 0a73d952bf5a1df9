"""Scalar and per-pixel functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.masks import layer_sql, layers
from foliolake.catalog.rasters import DENSE, dense, r6_sql
from foliolake.catalog.registry import query, table
from foliolake.constants import FOREGROUND, OVERLAY_COLOURS
from foliolake.functions import paths, pixel
from foliolake.functions.score import r6
from foliolake.operators import raster


@query(
    "pixel_values",
    sql=f"WITH {DENSE} SELECT page_id, y, x, {r6_sql('v / 255.0')} AS intensity, {r6_sql('1 - v / 255.0')} AS coverage, v >= 128 AS member, v < 128 AS predicted, v <= 127 AS target FROM dense",
)
def pixel_values(spark, sf):
    v = F.col("v")
    return raster.to_pixels(dense(spark, sf)).select(
        "page_id", "y", "x", r6(pixel.intensity(v)).alias("intensity"), r6(pixel.ink_coverage(v)).alias("coverage"),
        pixel.mask_member(v).alias("member"), pixel.predicted_ink(v).alias("predicted"), pixel.target_ink(v).alias("target"),
    )


@query(
    "probabilities_to_bytes",
    sql=f"WITH {DENSE}, p AS (SELECT page_id, y, x, 1 / (1 + exp(-(v / 32.0 - 4))) AS p FROM dense) SELECT page_id, y, x, {r6_sql('p')} AS p, "
    "CAST(round_even(p * 255, 0) AS INT) AS probability, CASE WHEN p >= 0.5 THEN 0 ELSE 255 END AS cleaned, CASE WHEN p >= 0.3 THEN 255 ELSE 0 END AS mask FROM p",
)
def probabilities_to_bytes(spark, sf):
    px = raster.to_pixels(dense(spark, sf)).withColumn("p", pixel.sigmoid(F.col("v") / 32.0 - 4))
    p = F.col("p")
    return px.select("page_id", "y", "x", r6(p).alias("p"), pixel.probability_byte(p).alias("probability"), pixel.cleaned_byte(p).alias("cleaned"), pixel.mask_byte(p, 0.3).alias("mask"))


def _channel_sql(i: int) -> str:
    value = "CAST(v AS DOUBLE)"
    for c in FOREGROUND:
        value = f"(CASE WHEN {layer_sql(c, 'v')} >= 128 THEN ({value}) * 0.45::DOUBLE + 0.55::DOUBLE * {OVERLAY_COLOURS[c][i]} ELSE {value} END)"
    return f"CAST(floor(least(greatest({value}, 0), 255) + 1e-9) AS INT)"


@query("colour_overlay", sql=f"WITH {DENSE} SELECT page_id, y, x, {_channel_sql(0)} AS r, {_channel_sql(1)} AS g, {_channel_sql(2)} AS b FROM dense")
def colour_overlay(spark, sf):
    wide = layers(dense(spark, sf))
    px = wide.select("page_id", "y", *FOREGROUND, F.posexplode("values").alias("x", "v"))
    masks = {c: F.get(F.col(c), F.col("x")) for c in FOREGROUND}
    return px.select("page_id", "y", "x", *[pixel.overlay_channel(F.col("v"), masks, i).alias(n) for i, n in enumerate("rgb")])


_over = "CAST(floor(({c} * a + (255 - a) * 255) / 255.0 + 0.5) AS INT)"


@query(
    "gray_from_colour",
    sql=f"WITH {DENSE}, c AS (SELECT page_id, y, x, v AS r, (v * 3) % 256 AS g, (v * 7) % 256 AS b, CASE WHEN x % 2 = 0 THEN 255 ELSE (v * 11) % 256 END AS a FROM dense) "
    f"SELECT page_id, y, x, CAST(({_over.format(c='r')} * 19595 + {_over.format(c='g')} * 38470 + {_over.format(c='b')} * 7471 + 32768) >> 16 AS INT) AS gray FROM c",
)
def gray_from_colour(spark, sf):
    v = F.col("v")
    alpha = F.when(F.col("x") % 2 == 0, F.lit(255)).otherwise((v * 11) % 256)
    over = lambda c: pixel.over_white(c, alpha)
    return raster.to_pixels(dense(spark, sf)).select("page_id", "y", "x", pixel.luma(over(v), over((v * 3) % 256), over((v * 7) % 256)).alias("gray"))


@query(
    "unit_scaled_arrays",
    sql=f"SELECT vec_id, {r6_sql('list_sum(l)')} AS total, {r6_sql('list_max(l)')} AS top FROM (SELECT vec_id, "
    "CASE WHEN vec_id % 2 = 0 THEN list_transform(embedding, lambda f: abs(CAST(f AS DOUBLE)) * 255) ELSE list_transform(embedding, lambda f: abs(CAST(f AS DOUBLE)) * 100 + 2) END AS l FROM embeddings)",
)
def unit_scaled_arrays(spark, sf):
    scaled = F.when(F.col("vec_id") % 2 == 0, F.transform("embedding", lambda f: F.abs(f.cast("double")))).otherwise(
        F.transform("embedding", lambda f: F.abs(f.cast("double")) * 100 + 2)
    )
    rows = table(spark, sf, "embeddings").select("vec_id", pixel.unit_scaled(scaled).alias("l"))
    return rows.select("vec_id", r6(F.aggregate("l", F.lit(0.0), lambda a, b: a + b)).alias("total"), r6(F.array_max("l")).alias("top"))


@query(
    "path_keys",
    sql="SELECT page_id, printf('page-%04d', page_id) AS dir, 'render-' || page_id || printf('-p%03d', page_id % 7) AS stem_key, "
    "'scan.' || page_id AS stem FROM pages",
)
def path_keys(spark, sf):
    p = F.col("page_id")
    name = F.concat(F.lit("in/deep.dir/scan."), p.cast("string"), F.lit(".png"))
    return table(spark, sf, "pages").select(
        "page_id", paths.page_dir(p).alias("dir"), paths.page_stem(F.concat(F.lit("render-"), p.cast("string")), p % 7).alias("stem_key"), paths.stem(name).alias("stem")
    )
