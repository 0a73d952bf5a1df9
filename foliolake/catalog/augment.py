"""Augmentation kernels on dense pages, each with its own page-wide parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.planning import key, vsql
from foliolake.catalog.rasters import DENSE, SHAPE, dense, level_sql, u_sql
from foliolake.catalog.registry import query
from foliolake.operators import augment, raster

PRIME = augment.PRIME


def params(spark, sf):
    """Seed and parameters of each page."""
    return raster.page_shape(dense(spark, sf)).select(
        "page_id", "height", "width", (F.col("page_id") * 1000 + 7).alias("seed"), (F.col("page_id") % 3 * 0.4 + 0.5).alias("radius"), (F.col("page_id") % 5 + 2.0).alias("sigma"),
        (F.col("page_id") % 4 * 0.05 + 0.1).alias("strength"), (F.col("page_id") % 3 + 3).cast("int").alias("grid_size"), (F.col("page_id") % 3 * 0.1 + 0.1).alias("opacity"),
        (F.col("page_id") % 5 + 1).alias("blob_count"), (F.col("page_id") % 3 * 0.02 + 0.05).alias("blob_radius_fraction"), (F.col("page_id") % 2 * 0.002 + 0.001).alias("speckle_density"),
    )


PARAMS = """
prm AS (
  SELECT page_id, CAST(h AS INT) AS height, CAST(w AS INT) AS width, page_id * 1000 + 7 AS seed, page_id % 3 * 0.4::DOUBLE + 0.5 AS radius, page_id % 5 + 2.0::DOUBLE AS sigma,
         page_id % 4 * 0.05::DOUBLE + 0.1 AS strength, CAST(page_id % 3 + 3 AS INT) AS grid_size, page_id % 3 * 0.1::DOUBLE + 0.1 AS opacity,
         page_id % 5 + 1 AS blob_count, page_id % 3 * 0.02::DOUBLE + 0.05 AS blob_radius_fraction, page_id % 2 * 0.002::DOUBLE + 0.001 AS speckle_density
  FROM shape
)"""


def clip_sql(value: str) -> str:
    return f"least(255, greatest(0, {level_sql(value)}))"


def blur_sql(name: str, source: str, sigma: str, column: str = "v") -> str:
    """Gaussian means with a sigma per page, as two passes over offsets."""
    reach = f"greatest(1, CAST(ceil(3 * ({sigma})) AS INT))"
    weight = f"exp(-(k.k * k.k) / (2 * ({sigma}) * ({sigma})))"

    def one(out: str, src: str, axis: str, length: str) -> str:
        other = "x" if axis == "y" else "y"
        return (
            f"{out} AS MATERIALIZED (SELECT t.page_id, t.y, t.x, sum({weight} * s.{column}) / sum({weight}) AS {column} FROM {src} t JOIN prm p ON p.page_id = t.page_id "
            f"JOIN range(-20, 21) k(k) ON abs(k.k) <= {reach} JOIN {src} s ON s.page_id = t.page_id AND s.{other} = t.{other} "
            f"AND s.{axis} = least(greatest(t.{axis} + k.k, 0), p.{length} - 1) GROUP BY t.page_id, t.y, t.x)"
        )

    return (
        f"{one(name + '_h', source, 'x', 'width')}, {one(name + '_f', name + '_h', 'y', 'height')}, "
        f"{name} AS (SELECT page_id, y, x, {clip_sql(column)} AS {column} FROM {name}_f)"
    )


def noise_sql(name: str, source: str) -> str:
    digest = "sha256(concat_ws(':', CAST(seed AS VARCHAR), 'noise', CAST(y AS VARCHAR)))"
    c = [f"(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) % {PRIME})" for i in range(8)]
    x = "CAST(x + 1 AS BIGINT)"
    cubic = lambda a: f"(((({c[a + 3]} * {x} + {c[a + 2]}) % {PRIME} * {x} + {c[a + 1]}) % {PRIME} * {x} + {c[a]}) % {PRIME})"
    return (
        f"{name}_d AS (SELECT s.*, sigma, {digest} AS d FROM {source} s JOIN prm USING (page_id)), "
        f"{name} AS (SELECT page_id, y, x, {clip_sql(f'v + sigma * sqrt(-2 * ln(({cubic(0)} + 1) / {PRIME}.0::DOUBLE)) * cos(2 * pi() * ({cubic(4)} / {PRIME}.0::DOUBLE))')} AS v FROM {name}_d)"
    )


def light_sql(name: str, source: str) -> str:
    def cubic(d: str) -> str:
        return (
            f"CASE WHEN {d} < 1 THEN (1.5 * {d} - 2.5) * {d} * {d} + 1 WHEN {d} < 2 THEN ((-0.5 * {d} + 2.5) * {d} - 4) * {d} + 2 ELSE 0 END"
        )

    dy = "abs(i.i + 0.5 - (y + 0.5) * (grid_size::DOUBLE / height))"
    dx = "abs(j.j + 0.5 - (x + 0.5) * (grid_size::DOUBLE / width))"
    level = f"(1 - strength * {u_sql('CAST(seed AS VARCHAR)', chr(39) + 'grid' + chr(39), 'CAST(i.i * grid_size + j.j AS VARCHAR)')})"
    return (
        f"{name}_g AS MATERIALIZED (SELECT page_id, i.i AS gi, j.j AS gj, {level} AS g FROM prm JOIN range(12) i(i) ON i.i < grid_size JOIN range(12) j(j) ON j.j < grid_size), "
        f"{name}_w AS (SELECT s.page_id, s.y, s.x, s.v, g, {cubic(dy.replace('i.i', 'gi'))} AS wy, {cubic(dx.replace('j.j', 'gj'))} AS wx FROM {source} s JOIN prm USING (page_id) JOIN {name}_g USING (page_id)), "
        f"{name} AS (SELECT page_id, y, x, {clip_sql('max(v) * (sum(g * wy * wx) / sum(wy * wx))')} AS v FROM {name}_w GROUP BY page_id, y, x)"
    )


def stains_sql(name: str, source: str) -> str:
    u = lambda tag: u_sql("CAST(seed AS VARCHAR)", "'stain'", "CAST(shape AS VARCHAR)", f"'{tag}'")
    half_even = lambda v: f"round_even({v}, 0)"
    return (
        f"{name}_p AS (SELECT *, greatest(1.0, least(height, width) * blob_radius_fraction) AS base, greatest(1, {half_even('opacity * 255')})::DOUBLE AS top, "
        f"unnest(range(1, CAST(blob_count + {half_even('height * width * speckle_density')} AS INT) + 1)) AS shape FROM prm), "
        f"{name}_s AS MATERIALIZED (SELECT page_id, shape, floor({u('x')} * width) AS cx, floor({u('y')} * height) AS cy, "
        f"CASE WHEN shape <= blob_count THEN greatest(1, {half_even('base * (0.7 + ' + u('rx') + ' * (2.2 - 0.7))')}) ELSE floor({u('rx')} * 2) END::DOUBLE AS rx, "
        f"CASE WHEN shape <= blob_count THEN greatest(1, {half_even('base * (0.5 + ' + u('ry') + ' * (1.8 - 0.5))')}) ELSE floor({u('rx')} * 2) END::DOUBLE AS ry, "
        f"greatest(1, {half_even('top * CASE WHEN shape <= blob_count THEN 0.55 + ' + u('ink') + ' * (1.0 - 0.55) ELSE 0.4 + ' + u('ink') + ' * (1.0 - 0.4) END')})::INT AS ink FROM {name}_p), "
        f"{name}_hit AS (SELECT d.page_id, d.y, d.x, arg_max(s.ink, s.shape) AS m FROM {source} d JOIN {name}_s s ON s.page_id = d.page_id AND abs(d.y - s.cy) <= s.ry "
        f"AND abs(d.x - s.cx) <= floor(s.rx * sqrt(greatest(0, 1 - (CASE WHEN s.ry = 0 THEN 0 ELSE (d.y - s.cy) / s.ry END) * (CASE WHEN s.ry = 0 THEN 0 ELSE (d.y - s.cy) / s.ry END))) + 1e-9) GROUP BY d.page_id, d.y, d.x), "
        f"{name}_mask AS MATERIALIZED (SELECT d.page_id, d.y, d.x, coalesce(m, 0) AS v FROM {source} d LEFT JOIN {name}_hit USING (page_id, y, x)), "
        + blur_sql(name + "_soft", name + "_mask", f"round_even(greatest(0.5, greatest(1.0, least(p.height, p.width) * p.blob_radius_fraction) * 0.18) * 1e6, 0)::DOUBLE / 1e6")
        + f", {name} AS (SELECT d.page_id, d.y, d.x, greatest(d.v - s.v, 0) AS v FROM {source} d JOIN {name}_soft s USING (page_id, y, x))"
    )


def start(spark, sf, *columns):
    return raster.attach_page_values(dense(spark, sf), params(spark, sf).select("page_id", *columns))


HEAD = f"WITH {DENSE}, {SHAPE}, {PARAMS}"
PIXELS = "SELECT page_id, y, x, v FROM"


@query("blurred_pages", sql=f"{HEAD}, {blur_sql('b', 'dense', 'p.radius')} {PIXELS} b")
def blurred_pages(spark, sf):
    return raster.to_pixels(augment.blur(start(spark, sf, "radius"), sigma="radius"))


@query("noisy_pages", sql=f"{HEAD}, {noise_sql('n', 'dense')} {PIXELS} n")
def noisy_pages(spark, sf):
    rows = start(spark, sf, "seed", "sigma")
    return raster.to_pixels(rows.withColumn("values", augment.gaussian_noise(F.col("values"), F.col("seed"), F.col("sigma"))))


@query("shaded_pages", sql=f"{HEAD}, {light_sql('l', 'dense')} {PIXELS} l")
def shaded_pages(spark, sf):
    grid = params(spark, sf).select("page_id", "height", augment.light_grid(F.col("seed"), F.col("strength"), F.col("grid_size")).alias("grid"))
    rows = raster.attach_page_values(dense(spark, sf), grid)
    return raster.to_pixels(rows.withColumn("values", augment.uneven_illumination(F.col("values"), F.col("y"), F.col("height"), F.col("grid"))))


@query("stained_pages", sql=f"{HEAD}, {stains_sql('s', 'dense')} {PIXELS} s")
def stained_pages(spark, sf):
    return raster.to_pixels(augment.stains(dense(spark, sf), params(spark, sf)))


RECIPES = {0: ("blur", "gaussian_noise"), 1: ("uneven_illumination", "stains", "jpeg"), 2: ("gaussian_noise", "blur", "uneven_illumination")}


def recipes(spark, sf):
    p = params(spark, sf)
    parameters = F.create_map(*[x for n in augment.PARAMETERS for x in (F.lit(n), F.col(n).cast("double"))])
    lists = None
    for k, families in RECIPES.items():
        ops = F.array(*[
            F.struct(F.lit(i + 1).alias("order"), F.lit(f).alias("family"), F.col("seed").alias("seed"), parameters.alias("parameters"))
            for i, f in enumerate(families)
        ])
        lists = F.when(F.col("page_id") % 4 == k, ops) if lists is None else lists.when(F.col("page_id") % 4 == k, ops)
    return p.select("page_id", lists.alias("degradations")).where("degradations IS NOT NULL")


def _subset(name: str, source: str, k: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT page_id, y, x, v FROM {source} WHERE page_id % 4 = {k})"


CHAIN = ", ".join([
    _subset("r0", "dense", 0), blur_sql("r0a", "r0", "p.radius"), noise_sql("r0b", "r0a"),
    _subset("r1", "dense", 1), light_sql("r1a", "r1"), stains_sql("r1b", "r1a"),
    _subset("r2", "dense", 2), noise_sql("r2a", "r2"), blur_sql("r2b", "r2a", "p.radius"), light_sql("r2c", "r2b"),
])


@query(
    "augmented_pages",
    sql=f"{HEAD}, {CHAIN} {PIXELS} r0b UNION ALL {PIXELS} r1b UNION ALL {PIXELS} r2c UNION ALL {PIXELS} dense WHERE page_id % 4 = 3",
)
def augmented_pages(spark, sf):
    """Ordered chains that differ by page; every fourth page has no recipe."""
    return raster.to_pixels(augment.apply_recipes(dense(spark, sf), recipes(spark, sf)))


@query(
    "pixel_hashes",
    sql=f"WITH {DENSE}, l AS (SELECT page_id, y, count(*) AS w, sha256(string_agg(printf('%02X', v), '' ORDER BY x)) AS h FROM dense GROUP BY page_id, y) "
    "SELECT page_id, sha256('L|' || max(w) || 'x' || (max(y) + 1) || '|' || sha256(string_agg(h, '' ORDER BY y))) AS pixel_sha256 FROM l GROUP BY page_id",
)
def pixel_hashes(spark, sf):
    return augment.pixel_hash(dense(spark, sf))
