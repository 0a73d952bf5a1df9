"""End-to-end evaluations on dense pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.cleaning_metrics import rounded
from foliolake.catalog.kernels import CLEAN_SQL, SUITE, ssim_sql, with_clean
from foliolake.catalog.masks import layer_sql, layers
from foliolake.catalog.planning import S, docs, key
from foliolake.catalog.quality import LINES, ZONES, tiny_sql
from foliolake.catalog.rasters import DENSE, HEIGHT, SCORES_SQL, SEED, WEIGHTS, dense, otsu_sql, r6_sql, ratio_sql, split_sql
from foliolake.catalog.registry import query, table
from foliolake.catalog.tiles import POINT, pointwise, starts_sql
from foliolake.constants import CLASSES, QUALITY_METRICS
from foliolake.operators import kernels, lookups, metrics, raster, tiles, validation
from foliolake.plans import reports
from foliolake.plans.splits import split_of

VARIANT_ID = "CASE variant WHEN 'otsu' THEN 0 WHEN 'adaptive' THEN 1 WHEN 'otsu_morphology' THEN 2 ELSE 3 END"


def pages(spark, sf):
    """Dense pages with clean targets and target masks."""
    return layers(with_clean(dense(spark, sf)), "clean")


def page_splits(spark, sf):
    ids = dense(spark, sf).select("page_id").distinct()
    return ids.withColumn("split", split_of(F.col("page_id").cast("string"), WEIGHTS, SEED))


CLASSICAL = f"""
{SUITE},
versus AS MATERIALIZED (SELECT s.page_id * 4 + {VARIANT_ID} AS page_id, s.page_id AS page, s.variant, s.y, s.x, s.v AS p, least(255, greatest(0, 2 * d.v - 128)) AS t
  FROM suite s JOIN dense d USING (page_id, y, x)),
vshape AS (SELECT page_id, max(y) + 1 AS h, max(x) + 1 AS w FROM versus GROUP BY page_id),
{ssim_sql('p', 't', 'versus', 'vs', 'vshape')},
ccounts AS (
  SELECT page_id, page, variant, CAST(count(*) FILTER (WHERE p < 128 AND t <= 127) AS BIGINT) AS true_positive,
         CAST(count(*) FILTER (WHERE p < 128 AND t > 127) AS BIGINT) AS false_positive,
         CAST(count(*) FILTER (WHERE p >= 128 AND t <= 127) AS BIGINT) AS false_negative,
         CAST(count(*) FILTER (WHERE p >= 128 AND t > 127) AS BIGINT) AS true_negative FROM versus GROUP BY page_id, page, variant
),
crows AS (
  SELECT c.page AS page_id, variant, {split_sql('CAST(c.page AS VARCHAR)')} AS split, true_positive, false_positive, false_negative, true_negative, ssim
  FROM ccounts c JOIN vs USING (page_id)
)"""


@query(
    "classical_suite_rows",
    sql=f"WITH {DENSE}, {CLASSICAL} SELECT c.page_id, variant, CASE WHEN variant LIKE 'otsu%' THEN 'otsu' ELSE 'adaptive' END AS threshold_method, variant LIKE '%morphology' AS morphology_applied, "
    "CASE WHEN variant LIKE '%morphology' THEN 'open_close' ELSE 'none' END AS morphology_operation, CASE WHEN variant LIKE 'otsu%' THEN threshold END AS threshold_value, "
    f"true_positive, false_positive, false_negative, true_negative, {SCORES_SQL}, {r6_sql('ssim')} AS ssim FROM crows c JOIN lvl ON lvl.page_id = c.page_id",
)
def classical_suite_rows(spark, sf):
    return rounded(reports.classical_rows(with_clean(dense(spark, sf))), (*reports.SCORES, "ssim"))


@query(
    "classical_suite_summary",
    sql=f"WITH {DENSE}, {CLASSICAL}, chosen AS (SELECT * FROM crows WHERE split IN ('train', 'test', 'challenge')), "
    "scoped AS (SELECT *, split AS scope FROM chosen UNION ALL SELECT *, 'non_challenge' FROM chosen WHERE split <> 'challenge'), "
    "summed AS (SELECT variant, scope, count(*) AS sample_count, CAST(sum(true_positive) AS BIGINT) AS true_positive, CAST(sum(false_positive) AS BIGINT) AS false_positive, "
    "CAST(sum(false_negative) AS BIGINT) AS false_negative, CAST(sum(true_negative) AS BIGINT) AS true_negative, avg(ssim) AS ssim0 FROM scoped GROUP BY variant, scope) "
    f"SELECT * EXCLUDE (ssim0), {SCORES_SQL}, {r6_sql('ssim0')} AS ssim FROM summed",
)
def classical_suite_summary(spark, sf):
    _, summary = reports.classical_suite(with_clean(dense(spark, sf)), page_splits(spark, sf), ("test", "train", "challenge"))
    return rounded(summary, (*reports.SCORES, "ssim"))


_cls = lambda c: f"CASE WHEN z_{c} >= 0 THEN 255 ELSE 0 END"
_tp = {c: f"count(*) FILTER (WHERE p_{c} >= 128 AND t_{c} >= 128)" for c in CLASSES}
_fp = {c: f"count(*) FILTER (WHERE p_{c} >= 128 AND t_{c} < 128)" for c in CLASSES}
_fn = {c: f"count(*) FILTER (WHERE p_{c} < 128 AND t_{c} >= 128)" for c in CLASSES}


def _class_score(c: str, s: str) -> str:
    tp, fp, fn = _tp[c], _fp[c], _fn[c]
    pair = {"precision": (tp, f"{tp} + {fp}"), "recall": (tp, f"{tp} + {fn}"), "dice": (f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "iou": (tp, f"{tp} + {fp} + {fn}")}
    return ratio_sql(*pair[s])


_seg = ", ".join(f"{_class_score(c, s)} AS segmentation_{c}_{s}" for c in CLASSES for s in reports.CLASS_SCORES)
MODEL = f"""
zz AS (SELECT page_id, y, x, v, {POINT} FROM dense),
px AS MATERIALIZED (
  SELECT page_id, y, x, CASE WHEN 1 / (1 + exp(-cleaning)) >= 0.5 THEN 0 ELSE 255 END AS p,
         255 - CAST(round_even(255 / (1 + exp(-cleaning)), 0) AS INT) AS gray, {CLEAN_SQL} AS t,
         {', '.join(f"CASE WHEN 1 / (1 + exp(-{c})) >= 0.5 THEN 255 ELSE 0 END AS p_{c}, {layer_sql(c, CLEAN_SQL)} AS t_{c}" for c in CLASSES)}
  FROM zz
),
shape AS (SELECT page_id, max(y) + 1 AS h, max(x) + 1 AS w FROM dense GROUP BY page_id),
{ssim_sql('gray', 't', 'px', 'ms')},
mrows AS (
  SELECT page_id, count(*) FILTER (WHERE p < 128 AND t <= 127) AS true_positive, count(*) FILTER (WHERE p < 128 AND t > 127) AS false_positive,
         count(*) FILTER (WHERE p >= 128 AND t <= 127) AS false_negative, count(*) FILTER (WHERE p >= 128 AND t > 127) AS true_negative,
         avg(CASE WHEN p_background < 128 AND greatest(p_staff, p_notation, p_text) < 128 THEN 1.0 ELSE 0 END) AS all_false_rate,
         avg(CASE WHEN p_background >= 128 AND greatest(p_staff, p_notation, p_text) >= 128 THEN 1.0 ELSE 0 END) AS background_overlap_rate, {_seg}
  FROM px GROUP BY page_id
)"""
_mean = lambda cs, s: "(" + " + ".join(f"segmentation_{c}_{s}" for c in cs) + f") / {len(cs)}.0"
_model_floats = [f"segmentation_{c}_{s}" for c in CLASSES for s in reports.CLASS_SCORES] + ["all_false_rate", "background_overlap_rate"]
_scores_cleaning = SCORES_SQL
for _s in ("precision", "recall", "f1", "dice", "iou"):
    _scores_cleaning = _scores_cleaning.replace(f" AS {_s}", f" AS cleaning_{_s}")
MODEL_SELECT = (
    "page_id, 'neural' AS evaluation_kind, 'pointwise' AS model, true_positive AS cleaning_true_positive, false_positive AS cleaning_false_positive, "
    f"false_negative AS cleaning_false_negative, true_negative AS cleaning_true_negative, {_scores_cleaning}, {r6_sql('ssim')} AS cleaning_ssim, "
    + ", ".join(f"{r6_sql(c)} AS {c}" for c in _model_floats) + ", "
    + ", ".join(f"{r6_sql(_mean(CLASSES, s))} AS segmentation_macro_{s}, {r6_sql(_mean(CLASSES[1:], s))} AS segmentation_foreground_macro_{s}" for s in reports.CLASS_SCORES)
)


def float_columns(df):
    return [n for n, t in df.dtypes if t == "double"]


@query("model_evaluation_rows", sql=f"WITH {DENSE}, {MODEL} SELECT {MODEL_SELECT} FROM mrows JOIN ms USING (page_id)")
def model_evaluation_rows(spark, sf):
    rows = reports.model_rows(pages(spark, sf), pointwise, "pointwise", 32, 8)
    return rounded(rows, float_columns(rows))


@query(
    "evaluation_summary",
    sql=f"WITH {DENSE}, {MODEL}, {CLASSICAL.replace('shape AS (SELECT page_id, max(y) + 1 AS h, max(x) + 1 AS w FROM dense GROUP BY page_id),', '', 1)}, "
    f"every AS (SELECT 'pointwise' AS model, {split_sql('CAST(page_id AS VARCHAR)')} AS split, {ratio_sql('2 * true_positive', '2 * true_positive + false_positive + false_negative')} AS dice, "
    f"{_mean(CLASSES[1:], 'dice')} AS fdice, all_false_rate FROM mrows UNION ALL SELECT 'classical_baseline', split, {ratio_sql('2 * true_positive', '2 * true_positive + false_positive + false_negative')}, NULL, NULL FROM crows WHERE variant = 'otsu') "
    "SELECT model, split, count(*) AS sample_count, printf('%.4f', avg(dice)) AS cleaning_dice, coalesce(printf('%.4f', avg(fdice)), '—') AS foreground_dice, "
    "coalesce(printf('%.4f', avg(all_false_rate)), '—') AS all_false_rate FROM every GROUP BY model, split",
)
def evaluation_summary(spark, sf):
    """Model and classical rows side by side, macro means per split, as report cells."""
    scan = pages(spark, sf)
    rows = reports.model_rows(scan, pointwise, "pointwise", 32, 8).unionByName(
        reports.baseline_rows(reports.classical_rows(with_clean(dense(spark, sf)))), allowMissingColumns=True
    )
    tagged = rows.join(page_splits(spark, sf), "page_id")
    means = metrics.split_macro(tagged, ("cleaning_dice", "segmentation_foreground_macro_dice", "all_false_rate"))
    return reports.summary_table(
        means, {"cleaning_dice": "cleaning_dice", "segmentation_foreground_macro_dice": "foreground_dice", "all_false_rate": "all_false_rate"}
    )


COMPARISON = f"""
{SUITE},
pair AS MATERIALIZED (
  SELECT page_id, 'classical' AS comparison_id, y, x, CAST(s.v < 128 AS INT) AS c, d.v FROM v_otsu s JOIN dense d USING (page_id, y, x)
  UNION ALL SELECT page_id, 'tiled', y, x, CAST(1 / (1 + exp(-(2 - 4 * (v / 255.0)))) >= 0.5 AS INT), v FROM dense
),
ruled AS (SELECT * FROM dense),
{LINES}, {ZONES.replace("'fixed'", "'classical'").replace('y - 16), abs(y - 26', 'y - 16), abs(y - 26')}, {tiny_sql('pair')},
quality AS (
  SELECT 's' || (page_id % 3) AS source, CAST(page_id // 3 + 1 AS INT) AS page_number, comparison_id, CASE comparison_id WHEN 'classical' THEN 'Classical' ELSE 'Model' END AS comparison_label,
         64 AS width, 50 AS height, cleaned * 1.0 / n AS cleaned_ink_fraction, shared_ink * 1.0 / nullif(source_ink, 0) AS source_ink_retention,
         shared_ink * 1.0 / nullif(cleaned, 0) AS cleaned_ink_from_source_fraction, coalesce(tiny_components, 0) / (n / 1e6) AS tiny_ink_components_per_megapixel,
         coalesce(k.n0, 0) * 1.0 / nullif(s.n0, 0) AS staff_like_line_retention, CASE WHEN comparison_id = 'tiled' THEN abs(seam - context) END AS tile_seam_discontinuity,
         CASE WHEN comparison_id = 'tiled' AND cleaned > 0 THEN seam / (cleaned * 1.0 / n) END AS tile_seam_ink_density_ratio
  FROM q LEFT JOIN tiny USING (page_id, comparison_id)
  LEFT JOIN (SELECT page_id, comparison_id, n AS n0 FROM line_source) s USING (page_id, comparison_id)
  LEFT JOIN (SELECT page_id, comparison_id, n AS n0 FROM line_kept) k USING (page_id, comparison_id)
)"""


@query(
    "unannotated_comparison",
    sql=f"WITH {DENSE}, {COMPARISON} SELECT source, page_number, comparison_id, comparison_label, width, height, "
    + ", ".join(f"{r6_sql(m)} AS {m}" for m in QUALITY_METRICS) + " FROM quality",
)
def unannotated_comparison(spark, sf):
    page = F.col("page_id")
    scan = dense(spark, sf).withColumns(
        {
            "source": F.concat(F.lit("s"), (page % 3).cast("string")), "page_number": (F.floor(page / 3) + 1).cast("int"),
            "height": F.lit(HEIGHT),
        }
    )
    classical = kernels.cleaning_suite(dense(spark, sf), variants=("otsu",)).withColumnRenamed("binary", "cleaned")
    model = tiles.page_results(tiles.score_pages(dense(spark, sf), pointwise, 24, 8, multiple=8))
    rows = reports.unannotated_comparison(scan, [("classical", "Classical", classical, None, 0), ("tiled", "Model", model, 24, 8)])
    return rounded(rows, QUALITY_METRICS)


@query(
    "source_audit",
    sql="WITH f AS (SELECT source AS source_id, 'lacks the required markers' AS message FROM documents WHERE NOT (contains(lower(text), 'the') AND contains(lower(text), 'er')) "
    "UNION SELECT source, 'text is longer than declared' FROM documents WHERE doc_id % 77 = 0 UNION SELECT source, 'unknown language ' || lang FROM documents WHERE lang NOT IN ('en', 'fr')) "
    "SELECT source_id, count(*) AS problems, min(message) AS first_problem FROM f GROUP BY source_id",
)
def source_audit(spark, sf):
    d = docs(spark, sf)
    markers = d.where(validation.lacks_markers(F.col("text"), ("the", "er"))).select(F.col("source").alias("source_id"), F.lit("lacks the required markers").alias("message"))
    longer = d.where((F.col("doc_id") % 77 == 0)).select(F.col("source").alias("source_id"), F.lit("text is longer than declared").alias("message"))
    registry = spark.createDataFrame([("en", "text"), ("fr", "text")], "name string, class string")
    names = lookups.classify_names(d.select(F.col("source").alias("source_id"), F.col("lang").alias("name")), registry)
    strict = names.where("NOT known").select("source_id", F.concat(F.lit("unknown language "), "name").alias("message"))
    return reports.source_audit(markers.unionByName(longer).unionByName(strict))


@query(
    "latency_report",
    sql=f"WITH {DENSE}, shape AS (SELECT page_id, max(y) + 1 AS height, max(x) + 1 AS width FROM dense GROUP BY page_id) "
    f"SELECT page_id, height, width, 32 AS tile_size, 8 AS overlap, len({starts_sql('height', 32, 8)}) * len({starts_sql('width', 32, 8)}) AS tile_count, "
    "true AS timed, width * height AS rated_pixels FROM shape "
    f"UNION ALL SELECT NULL, NULL, NULL, 32, 8, sum(len({starts_sql('height', 32, 8)}) * len({starts_sql('width', 32, 8)})), true, sum(width * height) FROM shape",
)
def latency_report(spark, sf):
    """Pages and the total row; seconds differ from run to run, so rate times latency is given as pixels."""
    scan = dense(spark, sf)
    timings = tiles.score_strips(tiles.cut_strips(scan, 32, 8), pointwise, 32, 8)
    rows = reports.latency_report(timings, tiles.page_metadata(scan, 32, 8), wall_seconds=12.5)
    return rows.select(
        "page_id", "height", "width", "tile_size", "overlap", "tile_count", (F.col("latency_seconds") > 0).alias("timed"),
        F.round(F.col("megapixels_per_second") * F.col("latency_seconds") * 1e6).cast("bigint").alias("rated_pixels"),
    )
