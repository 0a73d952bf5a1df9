"""Whole evaluations: classical suite, model evaluation, unannotated comparison, audits, summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import CLASSES
from foliolake.functions.pixel import predicted_ink, target_ink
from foliolake.operators import kernels, metrics, quality, suite, tiles
from foliolake.operators.raster import PAGE, attach_page_values
from foliolake.plans.splits import filter_splits
from foliolake.session import shared

SCORES = ("precision", "recall", "f1", "dice", "iou")
CLASS_SCORES = ("precision", "recall", "dice", "iou")


def classical_rows(scan: DataFrame, config: kernels.CleaningConfig = kernels.CleaningConfig()) -> DataFrame:
    """One metric row per page and variant of the classical suite.

    ``scan`` has ``page_id, y, values, clean``. The variants are made and measured in one band pass
    (``suite.suite_metrics``), which sends out sums only.
    """
    measured = metrics.with_scores(suite.suite_metrics(scan, config))
    described = F.create_map(
        *[x for v, (method, morphology) in kernels.VARIANTS.items() for x in (F.lit(v), F.struct(
            F.lit(method).alias("threshold_method"), F.lit(morphology).alias("morphology_applied"),
            F.lit(config.morphology if morphology else "none").alias("morphology_operation")))]
    )
    return measured.select("*", described[F.col("variant")].alias("_d")).select(
        PAGE, "variant", "_d.*", "threshold_value", *metrics.COUNTS, *SCORES, "ssim"
    )


def classical_suite(
    scan: DataFrame, samples: DataFrame, splits: Sequence[str] | None = None,
    config: kernels.CleaningConfig = kernels.CleaningConfig(),
) -> tuple[DataFrame, DataFrame]:
    """(metric rows, summaries) for the selected splits; ``samples`` gives ``page_id, split``.

    Pages of other splits are dropped before any pixel work.
    """
    chosen = filter_splits(samples, splits)
    rows = classical_rows(attach_page_values(scan, chosen.select(PAGE).distinct()), config).join(
        chosen.select(PAGE, "split"), PAGE
    )
    rows = shared(rows)
    return rows, metrics.variant_summary(rows, "ssim")


def model_rows(scan: DataFrame, scorer: tiles.Scorer, model: str, tile: int, overlap: int) -> DataFrame:
    """One metric row per page for a tile model.

    ``scan`` has ``page_id, y, values, clean`` and one target mask column per class. Similarity uses the
    inverted probability map, the other cleaning scores the binary page.
    """
    result = tiles.page_results(tiles.score_pages(scan, scorer, tile, overlap)).withColumnsRenamed(
        {c: f"p_{c}" for c in CLASSES}
    )
    pairs = shared(
        result.join(scan.select(PAGE, "y", "clean", *CLASSES), [PAGE, "y"]).withColumn(
            "gray", F.transform("probability", lambda v: 255 - v)
        )
    )
    cleaning = metrics.with_scores(metrics.confusion_counts(pairs, "cleaned", "clean", predicted_ink, target_ink))
    similarity = kernels.ssim(pairs, "gray", "clean")
    flags = metrics.consistency(pairs.select(PAGE, *[F.col(f"p_{c}").alias(c) for c in CLASSES]))
    layers = F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("predicted"), F.col(c).alias("target")) for c in CLASSES]
    )
    per_class = shared(metrics.class_counts(pairs.select(PAGE, F.inline(layers)), (PAGE, "class")))
    means = metrics.class_macro(per_class)
    one = lambda c, s: F.max(F.when(F.col("class") == c, F.col(s))).alias(f"segmentation_{c}_{s}")
    classes = per_class.groupBy(PAGE).agg(*[one(c, s) for c in CLASSES for s in CLASS_SCORES])
    names = {c: f"cleaning_{c}" for c in (*metrics.COUNTS, *SCORES)}
    macro = {f"{p}macro_{s}": f"segmentation_{p}macro_{s}" for p in ("", "foreground_") for s in CLASS_SCORES}
    return (
        cleaning.withColumnsRenamed(names).join(similarity.withColumnRenamed("ssim", "cleaning_ssim"), PAGE)
        .join(flags, PAGE).join(means.withColumnsRenamed(macro), PAGE).join(classes, PAGE)
        .withColumns({"evaluation_kind": F.lit("neural"), "model": F.lit(model)})
    )


def baseline_rows(rows: DataFrame, variant: str = "otsu") -> DataFrame:
    """Classical rows in the shape of model rows, without masks that were never measured."""
    names = {c: f"cleaning_{c}" for c in (*metrics.COUNTS, *SCORES, "ssim")}
    return rows.where(F.col("variant") == variant).select(PAGE, *[F.col(c).alias(n) for c, n in names.items()]).withColumns(
        {"evaluation_kind": F.lit("classical_baseline"), "model": F.lit("classical_baseline")}
    )


def summary_table(summaries: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Report cells with four decimals, a dash where a model has no such metric; empty splits are left out."""
    cell = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("—"))
    shown = F.when(F.col("sample_count") > 0, F.lit(True))
    return summaries.where(shown).select(
        "model", "split", "sample_count", *[F.when(F.col(c).isNull(), F.lit("—")).otherwise(cell(c)).alias(n) for c, n in columns.items()]
    )


def unannotated_comparison(scan: DataFrame, panels: Sequence[tuple[str, str, DataFrame, int | None, int]]) -> DataFrame:
    """Quality rows of every page under every cleaning.

    ``scan`` has ``page_id, y, values, source, page_number`` and, where pages may end before their last line,
    ``height``; a panel is ``(id, label, cleaned scanlines,
    tile size, overlap)`` with the tile size None for results that were not tiled.
    """
    stated = [c for c in ("height",) if c in scan.columns]
    original = scan.select(PAGE, "y", F.col("values").alias("original"), "source", "page_number", *stated)
    stacked = None
    for name, label, cleaned, tile, overlap in panels:
        one = cleaned.select(PAGE, "y", "cleaned").withColumns(
            {
                "comparison_id": F.lit(name), "comparison_label": F.lit(label),
                "tile_size": F.lit(tile).cast("int"), "overlap": F.lit(overlap),
            }
        )
        stacked = one if stacked is None else stacked.unionByName(one)
    return quality.quality_rows(shared(stacked.join(original, [PAGE, "y"])), original.select(PAGE, "y", "original"))


def page_index(pages: DataFrame, keys: DataFrame, panels: Sequence[tuple[str, int | None, int]]) -> DataFrame:
    """Where each page of an unannotated comparison lies: one row per page and panel.

    ``pages`` has ``source, page_number, input_dpi, width, height``, ``keys`` the key of each source. A panel is
    ``(id, tile size, overlap)``, with the tile size None for results that were not tiled. Paths are relative to
    the output; a tiled result also says how many tiles it took.
    """
    file = lambda folder: F.concat(F.lit(f"{folder}/"), F.col("key"), F.format_string("/page-%04d.png", F.col("page_number").cast("int")))

    def panel(name: str, tile: int | None, overlap: int) -> Column:
        count = F.lit(None).cast("int") if tile is None else (
            F.size(tiles.tile_starts(F.col("height"), tile, overlap)) * F.size(tiles.tile_starts(F.col("width"), tile, overlap))
        )
        return F.struct(F.lit(name).alias("comparison_id"), file(name).alias("cleaned"), count.alias("tile_count"))

    placed = pages.join(keys.select("source", "key"), "source")
    return placed.select(
        "source", "page_number", "input_dpi", "width", "height", file("original").alias("original"), F.inline(F.array(*[panel(*p) for p in panels]))
    )


def comparison_totals(index: DataFrame) -> DataFrame:
    """One row: how many sources and pages were compared, and how many tiles were scored."""
    per_page = index.groupBy("source", "page_number").agg(F.coalesce(F.sum("tile_count"), F.lit(0)).alias("tiles"))
    per_source = per_page.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("tiles").alias("tiles"))
    return per_source.agg(
        F.count(F.lit(1)).alias("source_count"), F.coalesce(F.sum("pages"), F.lit(0)).alias("page_count"),
        F.coalesce(F.sum("tiles"), F.lit(0)).alias("tile_count"),
    )


def source_audit(problems: DataFrame) -> DataFrame:
    """Failing sources, sorted, with the number of different problems and the first of them.

    ``problems`` is the union of whatever was checked, as ``source_id, message``; it stays available as
    the full list, so no source's messages are gathered here.
    """
    return problems.distinct().groupBy("source_id").agg(
        F.count(F.lit(1)).alias("problems"), F.min("message").alias("first_problem")
    ).orderBy("source_id")


def latency_report(timings: DataFrame, metadata: DataFrame, wall_seconds: float | None = None) -> DataFrame:
    """Measured latency and rate per page from the seconds the scoring tasks report, and one total row.

    The total has a NULL page. Its time is the run's wall clock where that is given, else the summed
    latencies, which are longer than the run when pages are scored side by side.
    """
    spent = timings.groupBy(PAGE).agg(F.sum("seconds").alias("latency_seconds"))
    pages = metadata.join(spent, PAGE).withColumn("_pixels", F.col("width") * F.col("height"))
    summed = F.sum("latency_seconds") if wall_seconds is None else F.lit(float(wall_seconds))
    total = pages.groupBy("tile_size", "overlap").agg(
        F.sum("tile_count").alias("tile_count"), summed.alias("latency_seconds"), F.sum("_pixels").alias("_pixels")
    )
    rows = pages.unionByName(total, allowMissingColumns=True)
    return rows.withColumn("megapixels_per_second", F.try_divide(F.col("_pixels") / 1e6, F.col("latency_seconds"))).drop("_pixels")
