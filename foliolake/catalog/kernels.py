"""Cleaning kernels on dense pages, checked pixel by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.cleaning_metrics import rounded
from foliolake.catalog.rasters import (
    DENSE, SCORES_SQL, SHAPE, dense, level_sql, otsu_sql, r6_sql, smooth_sql, textpage, TEXT,
)
from foliolake.catalog.registry import query
from foliolake.functions.pixel import predicted_ink, target_ink
from foliolake.functions.score import r6
from foliolake.operators import kernels, metrics, raster, stencil

SIGMA = 25.0 / 8
TAPS = stencil.taps_for_sigma(SIGMA)
BLOCK_SIGMA = stencil.sigma_for_taps(35)


def with_clean(scan):
    """A gray target beside each page: the page with doubled contrast."""
    sharper = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), 2 * v - 128))
    return scan.withColumn("clean", F.transform("values", sharper))


CLEAN_SQL = "least(255, greatest(0, 2 * v - 128))"

REDUCED = f"""
{SHAPE},
sized AS (SELECT *, greatest(1, CAST(round_even(h / 8.0, 0) AS INT)) AS rh, greatest(1, CAST(round_even(w / 8.0, 0) AS INT)) AS rw FROM shape),
across AS (
  SELECT d.page_id, d.y, c.rx AS x, sum(v * (least(d.x + 1, (c.rx + 1) * (w * 1.0 / rw)) - greatest(d.x, c.rx * (w * 1.0 / rw)))) / (w * 1.0 / rw) AS v
  FROM dense d JOIN sized USING (page_id) JOIN range(64) c(rx)
    ON c.rx < rw AND d.x < (c.rx + 1) * (w * 1.0 / rw) AND d.x + 1 > c.rx * (w * 1.0 / rw)
  GROUP BY ALL HAVING true
),
down AS (
  SELECT a.page_id, c.ry AS y, a.x, sum(v * (least(a.y + 1, (c.ry + 1) * (h * 1.0 / rh)) - greatest(a.y, c.ry * (h * 1.0 / rh))) / (h * 1.0 / rh)) AS v
  FROM across a JOIN sized USING (page_id) JOIN range(64) c(ry)
    ON c.ry < rh AND a.y < (c.ry + 1) * (h * 1.0 / rh) AND a.y + 1 > c.ry * (h * 1.0 / rh)
  GROUP BY a.page_id, c.ry, a.x
),
reduced AS (SELECT page_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {level_sql('v')} AS v FROM down),
small AS (SELECT page_id, rh AS h, rw AS w FROM sized)"""
REDUCED = REDUCED.replace(
    "/ (w * 1.0 / rw) AS v\n", "/ max(w * 1.0 / rw) AS v\n"
).replace("GROUP BY ALL HAVING true", "GROUP BY d.page_id, d.y, c.rx")

NORMALIZED = f"""
{REDUCED},
{smooth_sql('blurred', 'reduced', ['v'], TAPS, SIGMA, 'edge', 'small')},
field AS (SELECT page_id, y, x, {level_sql('v')} AS v FROM blurred),
placed AS (
  SELECT d.*, h, w, rh, rw,
         least(greatest((y + 0.5) * (rh * 1.0 / h) - 0.5, 0), rh - 1) AS ay,
         least(greatest((x + 0.5) * (rw * 1.0 / w) - 0.5, 0), rw - 1) AS ax
  FROM dense d JOIN sized USING (page_id)
),
corners AS (
  SELECT p.page_id, p.y, p.x, p.v,
         (a.v * (1 - (ay - floor(ay))) + c.v * (ay - floor(ay))) * (1 - (ax - floor(ax)))
       + (b.v * (1 - (ay - floor(ay))) + e.v * (ay - floor(ay))) * (ax - floor(ax)) AS g
  FROM placed p
  JOIN field a ON a.page_id = p.page_id AND a.y = floor(ay) AND a.x = floor(ax)
  JOIN field b ON b.page_id = p.page_id AND b.y = floor(ay) AND b.x = least(floor(ax) + 1, rw - 1)
  JOIN field c ON c.page_id = p.page_id AND c.y = least(floor(ay) + 1, rh - 1) AND c.x = floor(ax)
  JOIN field e ON e.page_id = p.page_id AND e.y = least(floor(ay) + 1, rh - 1) AND e.x = least(floor(ax) + 1, rw - 1)
),
normalized AS (
  SELECT page_id, y, x, CAST(least(255, {level_sql(f"255.0 * v / greatest({level_sql('g')}, 1)")}) AS INT) AS v FROM corners
)"""

PIXELS = ("page_id", "y", "x")


def pixels_of(scan, values):
    return raster.to_pixels(scan, values)


@query("area_reduced_pages", sql=f"WITH {DENSE}, {REDUCED} SELECT page_id, y, x, v FROM reduced")
def area_reduced_pages(spark, sf):
    scan = dense(spark, sf)
    shrink = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) / 8).cast("int"))
    sized = raster.page_shape(scan).withColumns({"reduced_height": shrink("height"), "reduced_width": shrink("width")})
    return pixels_of(kernels.area_reduce(scan, sized, to_byte=True), "values")


@query("illumination_normalized", sql=f"WITH {DENSE}, {NORMALIZED} SELECT page_id, y, x, v FROM normalized")
def illumination_normalized(spark, sf):
    return pixels_of(kernels.normalize_illumination(dense(spark, sf)), "normalized")


@query("otsu_thresholds", sql=f"WITH {TEXT}, {otsu_sql('textpage')} SELECT page_id, threshold FROM otsu")
def otsu_thresholds(spark, sf):
    return kernels.otsu_pages(textpage(spark, sf))


@query("gray_histogram", sql=f"WITH {TEXT} SELECT page_id, v, count(*) AS n FROM textpage GROUP BY page_id, v")
def gray_histogram(spark, sf):
    return kernels.histogram(textpage(spark, sf))


@query(
    "otsu_single_level_pages",
    sql=f"WITH {DENSE} SELECT page_id, y, x, 0 AS threshold, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 255 END AS v FROM dense",
)
def otsu_single_level_pages(spark, sf):
    """Pages of one gray level each: black ones stay black, all others turn white."""
    level = F.element_at(F.array(F.lit(0), F.lit(90), F.lit(200), F.lit(255)), (F.col("page_id") % 4 + 1).cast("int"))
    flat = dense(spark, sf).withColumn("values", F.transform("values", lambda v: level))
    return raster.to_pixels(kernels.otsu_binarize(flat), "binary", keep=("threshold",))


@query(
    "otsu_binarized",
    sql=f"WITH {DENSE}, {otsu_sql('dense')} SELECT page_id, y, x, threshold, "
    "CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM dense JOIN otsu USING (page_id)",
)
def otsu_binarized(spark, sf):
    return raster.to_pixels(kernels.otsu_binarize(dense(spark, sf)), "binary", keep=("threshold",))


ADAPTIVE = f"""
{smooth_sql('block', 'dense', ['v'], 35, BLOCK_SIGMA, 'edge')},
adaptive AS (
  SELECT d.page_id, d.y, d.x, CASE WHEN d.v > {level_sql('b.v')} - 11 THEN 255 ELSE 0 END AS v
  FROM dense d JOIN block b USING (page_id, y, x)
)"""


@query("adaptive_binarized", sql=f"WITH {DENSE}, {SHAPE}, {ADAPTIVE} SELECT page_id, y, x, v FROM adaptive")
def adaptive_binarized(spark, sf):
    return pixels_of(kernels.adaptive_binarize(dense(spark, sf)), "binary")


def cross_sql(name: str, source: str, grow: bool) -> str:
    """Moving maximum or minimum over the 3 x 3 cross; neighbours off the page do not count."""
    pick = "greatest" if grow else "least"
    near = ", ".join(
        f"{f}(v, 1, v) OVER (PARTITION BY page_id, {a} ORDER BY {b})"
        for f in ("lag", "lead") for a, b in (("y", "x"), ("x", "y"))
    )
    return f"{name} AS MATERIALIZED (SELECT page_id, y, x, {pick}(v, {near}) AS v FROM {source})"


def chain_sql(source: str, name: str, operation: str) -> str:
    """Ink-side morphology of a binary page as a chain of cross windows."""
    steps = kernels.morphology_steps(operation, 1)
    parts, last = [f"{name}_0 AS MATERIALIZED (SELECT page_id, y, x, 255 - v AS v FROM {source})"], f"{name}_0"
    for i, grow in enumerate(steps, start=1):
        parts.append(cross_sql(f"{name}_{i}", last, grow))
        last = f"{name}_{i}"
    return ", ".join(parts) + f", {name} AS (SELECT page_id, y, x, 255 - v AS v FROM {last})"


def _morphology_query(operation: str):
    @query(
        f"morphology_{operation}",
        sql=f"WITH {DENSE}, bin AS (SELECT page_id, y, x, CASE WHEN v > 110 THEN 255 ELSE 0 END AS v FROM dense), "
        f"{chain_sql('bin', 'cleaned', operation)} SELECT page_id, y, x, v FROM cleaned",
    )
    def run(spark, sf):
        binary = dense(spark, sf).withColumn("binary", kernels.binarize(F.col("values"), F.lit(110)))
        return pixels_of(kernels.morphology(binary, operation=operation), "binary")


for _operation in ("open", "close", "open_close"):
    _morphology_query(_operation)


def ssim_sql(first: str, second: str, source: str, name: str = "ssim", shape: str = "shape") -> str:
    moments = (
        f"{name}_m AS (SELECT page_id, y, x, CAST({first} AS DOUBLE) AS a, CAST({second} AS DOUBLE) AS b, "
        f"CAST({first} AS DOUBLE) * {first} AS aa, CAST({second} AS DOUBLE) * {second} AS bb, "
        f"CAST({first} AS DOUBLE) * {second} AS ab FROM {source})"
    )
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    score = (
        f"((2 * a * b + {c1!r}) * (2 * (ab - a * b) + {c2!r})) / "
        f"((a * a + b * b + {c1!r}) * ((aa - a * a) + (bb - b * b) + {c2!r}))"
    )
    return (
        f"{moments}, {smooth_sql(name + '_s', name + '_m', ['a', 'b', 'aa', 'bb', 'ab'], 11, 1.5, 'reflect', shape)}, "
        f"{name} AS (SELECT page_id, greatest(-1, least(1, avg({score}))) AS ssim FROM {name}_s GROUP BY page_id)"
    )


@query(
    "structural_similarity",
    sql=f"WITH {DENSE}, {SHAPE}, {ssim_sql('v', CLEAN_SQL, 'dense')} SELECT page_id, {r6_sql('ssim')} AS ssim FROM ssim",
)
def structural_similarity(spark, sf):
    return kernels.ssim(with_clean(dense(spark, sf)), "values", "clean").select("page_id", r6(F.col("ssim")).alias("ssim"))


SUITE = f"""
{NORMALIZED},
{otsu_sql('normalized', 'lvl')},
{smooth_sql('nblock', 'normalized', ['v'], 35, BLOCK_SIGMA, 'edge')},
v_otsu AS (SELECT page_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM normalized JOIN lvl USING (page_id)),
v_adaptive AS (SELECT n.page_id, n.y, n.x, CASE WHEN n.v > {level_sql('b.v')} - 11 THEN 255 ELSE 0 END AS v
  FROM normalized n JOIN nblock b USING (page_id, y, x)),
{chain_sql('v_otsu', 'v_otsu_m', 'open_close')},
{chain_sql('v_adaptive', 'v_adaptive_m', 'open_close')},
suite AS (
  SELECT 'otsu' AS variant, * FROM v_otsu UNION ALL SELECT 'adaptive', * FROM v_adaptive
  UNION ALL SELECT 'otsu_morphology', * FROM v_otsu_m UNION ALL SELECT 'adaptive_morphology', * FROM v_adaptive_m
)"""


@query(
    "cleaning_suite",
    sql=f"WITH {DENSE}, {SUITE} SELECT s.page_id, s.y, s.x, s.variant, s.v, "
    "CASE WHEN s.variant LIKE 'otsu%' THEN threshold END AS threshold_value FROM suite s JOIN lvl USING (page_id)",
)
def cleaning_suite(spark, sf):
    return raster.to_pixels(kernels.cleaning_suite(dense(spark, sf)), "binary", keep=("variant", "threshold_value"))
