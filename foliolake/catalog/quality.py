"""Reference-free quality on ruled pages under two cleanings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.cleaning_metrics import rounded
from foliolake.catalog.masks import runs_sql
from foliolake.catalog.rasters import DENSE, HEIGHT, TEXT, dense, otsu_sql, r6_sql, textpage
from foliolake.catalog.registry import query, table
from foliolake.constants import QUALITY_METRICS
from foliolake.functions.score import r6
from foliolake.operators import quality, tiles

RULED = """
ruled AS (SELECT page_id, y, x, CASE WHEN y % 10 = 0 THEN v // 4 ELSE v END AS v FROM dense),
pair AS (
  SELECT page_id, 'fixed' AS comparison_id, y, x, v, CAST(v < 90 AS INT) AS c FROM ruled
  UNION ALL SELECT page_id, 'tiled', y, x, v, CAST(v < 45 OR v BETWEEN 90 AND 99 AS INT) FROM ruled
)"""


def ruled(spark, sf):
    return dense(spark, sf).withColumn(
        "values", F.when(F.col("y") % 10 == 0, F.transform("values", lambda v: F.floor(v / 4).cast("int"))).otherwise(F.col("values"))
    )


def comparisons(spark, sf):
    """Two cleanings of each ruled page: one whole-page, one from 24-pixel tiles."""
    page = F.col("page_id")
    byte = lambda ink: F.transform("values", lambda v: F.when(ink(v), F.lit(0)).otherwise(F.lit(255)))
    kinds = F.array(
        F.struct(
            F.lit("fixed").alias("comparison_id"), F.lit("Fixed threshold").alias("comparison_label"),
            F.lit(None).cast("int").alias("tile_size"), F.lit(0).alias("overlap"), byte(lambda v: v < 90).alias("cleaned"),
        ),
        F.struct(
            F.lit("tiled").alias("comparison_id"), F.lit("Tiled model").alias("comparison_label"),
            F.lit(24).alias("tile_size"), F.lit(8).alias("overlap"),
            byte(lambda v: (v < 45) | v.between(90, 99)).alias("cleaned"),
        ),
    )
    return ruled(spark, sf).select(
        "page_id", "y", F.col("values").alias("original"),
        F.concat(F.lit("s"), (page % 3).cast("string")).alias("source"),
        (F.floor(page / 3) + 1).cast("int").alias("page_number"), F.lit(HEIGHT).alias("height"), F.inline(kinds),
    )


def tiny_sql(source: str, name: str = "tiny", keys: str = "page_id, comparison_id") -> str:
    """Components of at most four ink pixels by label propagation over eight neighbours."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    near = "CROSS JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(dy,dx)"
    a_keys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    parts = [f"{name}_0 AS MATERIALIZED (SELECT {keys}, y, x, CAST(y AS BIGINT) * 100000 + x AS l FROM {source} WHERE c = 1)"]
    for i in range(1, 5):
        parts.append(
            f"{name}_{i} AS MATERIALIZED (SELECT {a_keys}, a.y, a.x, min(b.l) AS l FROM {name}_{i - 1} a {near} "
            f"JOIN {name}_{i - 1} b ON {same} AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY {a_keys}, a.y, a.x)"
        )
    parts.append(
        f"{name}_n AS (SELECT {a_keys}, a.y, a.x, any_value(a.l) AS l, bool_or(b.l <> a.l) AS open FROM {name}_4 a {near} "
        f"JOIN {name}_4 b ON {same} AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY {a_keys}, a.y, a.x)"
    )
    parts.append(
        f"{name} AS (SELECT {keys}, count(*) AS tiny_components FROM (SELECT {keys}, l FROM {name}_n GROUP BY {keys}, l "
        f"HAVING count(*) <= 4 AND NOT bool_or(open)) GROUP BY {keys})"
    )
    return ", ".join(parts)


@query(
    "tiny_ink_components",
    sql=f"WITH {DENSE}, ink AS (SELECT page_id, y, x, CAST(v < 90 AS INT) AS c FROM dense), {tiny_sql('ink', keys='page_id')} SELECT * FROM tiny",
)
def tiny_ink_components(spark, sf):
    ink = dense(spark, sf).withColumn("ink", F.transform("values", lambda v: (v < 90).cast("int")))
    return quality.tiny_components(ink)


LINES = f"""
{otsu_sql('ruled')},
inked AS (SELECT p.*, CAST(v <= threshold AS INT) AS s FROM pair p JOIN otsu USING (page_id)),
src AS (SELECT page_id, comparison_id, y, x FROM inked WHERE s = 1),
srcrun AS (SELECT page_id, comparison_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, comparison_id, y ORDER BY x) AS g FROM src) GROUP BY page_id, comparison_id, y, g HAVING count(*) >= 16),
clnrun AS (SELECT page_id, comparison_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, comparison_id, y ORDER BY x) AS g FROM inked WHERE c = 1) GROUP BY page_id, comparison_id, y, g HAVING count(*) >= 16),
line_source AS (SELECT page_id, comparison_id, CAST(sum(x1 - x0) AS BIGINT) AS n FROM srcrun GROUP BY page_id, comparison_id),
line_kept AS (SELECT a.page_id, a.comparison_id, CAST(sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS BIGINT) AS n
  FROM srcrun a JOIN clnrun b ON a.page_id = b.page_id AND a.comparison_id = b.comparison_id AND a.y = b.y AND a.x0 < b.x1 AND b.x0 < a.x1
  GROUP BY a.page_id, a.comparison_id)"""


@query(
    "line_retention",
    sql=f"WITH {DENSE}, {RULED}, {LINES}, k AS (SELECT DISTINCT page_id, comparison_id FROM pair) "
    "SELECT page_id, comparison_id, coalesce(s.n, 0) AS line_source, coalesce(c.n, 0) AS line_kept, "
    f"{r6_sql('coalesce(c.n, 0) * 1.0 / nullif(coalesce(s.n, 0), 0)')} AS staff_like_line_retention "
    "FROM k LEFT JOIN line_source s USING (page_id, comparison_id) LEFT JOIN line_kept c USING (page_id, comparison_id)",
)
def line_retention(spark, sf):
    from foliolake.operators.kernels import otsu_pages
    from foliolake.operators.raster import attach_page_values

    scan = comparisons(spark, sf)
    inked = attach_page_values(scan, otsu_pages(ruled(spark, sf))).withColumns(
        {
            "s": F.transform("original", lambda v: (v <= F.col("threshold")).cast("int")),
            "c": F.transform("cleaned", lambda v: (v < 128).cast("int")),
        }
    )
    return rounded(quality.line_retention(inked, "s", "c", ("page_id", "comparison_id")), ("staff_like_line_retention",))


# 50 x 64 pages in 24-pixel tiles with 8 shared pixels: starts 0, 16, 26 by rows and 0, 16, 32, 40 by columns.
ZONES = """
zoned AS (
  SELECT *, CASE WHEN comparison_id = 'fixed' THEN 0
    WHEN least(abs(y - 16), abs(y - 26)) <= 1 OR least(abs(x - 16), abs(x - 32), abs(x - 40)) <= 1 THEN 2
    WHEN least(abs(y - 16), abs(y - 26)) <= 7 OR least(abs(x - 16), abs(x - 32), abs(x - 40)) <= 7 THEN 1 ELSE 0 END AS zone
  FROM inked
),
q AS (
  SELECT page_id, comparison_id, count(*) AS n, sum(c) AS cleaned, sum(s) AS source_ink, sum(c * s) AS shared_ink,
         coalesce(avg(c) FILTER (WHERE zone = 2), 0) AS seam, coalesce(avg(c) FILTER (WHERE zone = 1), 0) AS context
  FROM zoned GROUP BY page_id, comparison_id
)"""

QUALITY = f"""
{RULED}, {LINES}, {ZONES}, {tiny_sql('pair')},
quality AS (
  SELECT 's' || (page_id % 3) AS source, CAST(page_id // 3 + 1 AS INT) AS page_number, comparison_id,
         CASE comparison_id WHEN 'fixed' THEN 'Fixed threshold' ELSE 'Tiled model' END AS comparison_label,
         64 AS width, 50 AS height,
         cleaned * 1.0 / n AS cleaned_ink_fraction, shared_ink * 1.0 / nullif(source_ink, 0) AS source_ink_retention,
         shared_ink * 1.0 / nullif(cleaned, 0) AS cleaned_ink_from_source_fraction,
         coalesce(tiny_components, 0) / (n / 1e6) AS tiny_ink_components_per_megapixel,
         coalesce(k.n0, 0) * 1.0 / nullif(s.n0, 0) AS staff_like_line_retention,
         CASE WHEN comparison_id = 'tiled' THEN abs(seam - context) END AS tile_seam_discontinuity,
         CASE WHEN comparison_id = 'tiled' AND cleaned > 0 THEN seam / (cleaned * 1.0 / n) END AS tile_seam_ink_density_ratio
  FROM q LEFT JOIN tiny USING (page_id, comparison_id)
  LEFT JOIN (SELECT page_id, comparison_id, n AS n0 FROM line_source) s USING (page_id, comparison_id)
  LEFT JOIN (SELECT page_id, comparison_id, n AS n0 FROM line_kept) k USING (page_id, comparison_id)
)"""
_metrics_sql = ", ".join(f"{r6_sql(m)} AS {m}" for m in QUALITY_METRICS)


@query(
    "page_quality",
    sql=f"WITH {DENSE}, {QUALITY} SELECT source, page_number, comparison_id, comparison_label, width, height, {_metrics_sql} FROM quality",
)
def page_quality(spark, sf):
    rows = quality.quality_rows(comparisons(spark, sf), ruled(spark, sf).withColumnRenamed("values", "original"))
    return quality.ordered_report(rounded(rows, QUALITY_METRICS))


_avg_sql = ", ".join(f"{r6_sql(f'avg({m})')} AS {m}" for m in QUALITY_METRICS)


@query(
    "quality_summaries",
    sql=f"WITH {DENSE}, {QUALITY} SELECT source, comparison_id, min(comparison_label) AS comparison_label, count(*) AS page_count, {_avg_sql} "
    "FROM quality GROUP BY GROUPING SETS ((source, comparison_id), (comparison_id))",
)
def quality_summaries(spark, sf):
    rows = quality.quality_rows(comparisons(spark, sf), ruled(spark, sf).withColumnRenamed("values", "original"))
    return rounded(quality.quality_summaries(rows), QUALITY_METRICS)


@query(
    "source_ink_retention",
    sql=f"WITH {TEXT}, {otsu_sql('textpage')}, p AS (SELECT page_id, CAST(v <= threshold AS INT) AS s, CAST(v < 60 AS INT) AS c "
    "FROM textpage JOIN otsu USING (page_id)) "
    f"SELECT page_id, {r6_sql('avg(c)')} AS cleaned_ink_fraction, {r6_sql('sum(c * s) * 1.0 / nullif(sum(s), 0)')} AS source_ink_retention, "
    f"{r6_sql('sum(c * s) * 1.0 / nullif(sum(c), 0)')} AS cleaned_ink_from_source_fraction FROM p GROUP BY page_id",
)
def source_ink_retention(spark, sf):
    """Ink fractions of document pages, with the inverse Otsu mask of the scan as source ink; both go by level."""
    from foliolake.functions.score import ratio_or_null
    from foliolake.operators.kernels import levels_with_threshold

    levels = levels_with_threshold(textpage(spark, sf))
    s, c, n = (F.col("v") <= F.col("threshold")).cast("int"), (F.col("v") < 60).cast("int"), F.col("n")
    return levels.groupBy("page_id").agg(
        r6(F.sum(c * n).cast("double") / F.sum(n)).alias("cleaned_ink_fraction"),
        r6(ratio_or_null(F.sum(c * s * n), F.sum(s * n))).alias("source_ink_retention"),
        r6(ratio_or_null(F.sum(c * s * n), F.sum(c * n))).alias("cleaned_ink_from_source_fraction"),
    )
