import pytest
from pyspark.sql import functions as F

from foliolake.functions.pixel import predicted_ink, target_ink
from foliolake.operators import kernels, masks, metrics, raster

INK = ("precision", "recall", "f1", "dice", "iou")


def scores(scan_of, predicted, target):
    pairs = scan_of({1: predicted}).join(scan_of({1: target}).withColumnRenamed("values", "target"), ["page_id", "y"])
    return metrics.with_scores(metrics.confusion_counts(pairs, "values", "target", predicted_ink, target_ink)).first()


def test_confusion_2x2(scan_of):
    row = scores(scan_of, [[0, 255], [0, 255]], [[0, 0], [255, 255]])
    assert [row[c] for c in metrics.COUNTS] == [1, 1, 1, 1]
    assert (row.precision, row.recall, row.dice) == (0.5, 0.5, 0.5)
    assert row.iou == pytest.approx(1 / 3)


def test_identity_and_empty(scan_of):
    page = [[0, 255], [255, 0]]
    assert all(scores(scan_of, page, page)[n] == 1.0 for n in INK)
    blank = [[255, 255], [255, 255]]
    assert all(scores(scan_of, blank, blank)[n] == 1.0 for n in INK)  # nothing expected, nothing found


def test_target_threshold_edge(scan_of):
    # 127 is target ink, 128 is not; predicted ink is below 128
    row = scores(scan_of, [[127, 128]], [[127, 128]])
    assert [row[c] for c in metrics.COUNTS] == [1, 0, 0, 1]


def test_ssim_identity_and_gray(scan_of):
    def pair(a, b):
        df = scan_of({1: a}).join(scan_of({1: b}).withColumnRenamed("values", "other"), ["page_id", "y"])
        return kernels.ssim(df, "values", "other").first().ssim

    page = [[0, 255], [255, 0]]
    assert pair(page, page) == pytest.approx(1.0)
    assert pair([[20, 220], [230, 15]], page) < 1.0


def test_size_mismatch_is_a_row(scan_of):
    a, b = raster.page_shape(scan_of({1: [[0, 0], [0, 0]]})), raster.page_shape(scan_of({1: [[0, 0, 0], [0, 0, 0]], 2: [[1]]}))
    bad = {r.page_id for r in metrics.dimension_mismatch(a, b).collect()}
    assert bad == {1, 2}


def test_masks_overlap_is_legal_background_is_not(scan_of):
    scan = scan_of({1: [[0, 255, 0], [0, 0, 0]]}).withColumnRenamed("values", "staff")
    scan = scan.withColumn("notation", F.col("staff")).withColumn(
        "text", F.when(F.col("y") == 1, F.array(F.lit(0), F.lit(0), F.lit(255))).otherwise(F.array(*[F.lit(0)] * 3))
    )
    good = masks.with_background(scan)
    assert masks.mask_problems(good).count() == 0
    assert [r.background for r in good.orderBy("y").collect()] == [[255, 0, 255], [255, 255, 0]]
    broken = good.withColumn("background", F.array(*[F.lit(255)] * 3))
    assert {r.problem for r in masks.mask_problems(broken).collect()} == {
        "background is not the foreground complement", "background overlaps foreground",
    }
    gray = good.withColumn("staff", F.transform("staff", lambda v: F.when(v > 0, F.lit(7)).otherwise(v)))
    assert "staff mask is not binary" in {r.problem for r in masks.mask_problems(gray).collect()}


def test_coverage_cutoff_rounds_half_even(spark):
    from foliolake.functions.pixel import coverage_byte

    df = spark.createDataFrame([(0,), (127,), (128,), (255,)], "v int")
    assert [r[0] for r in df.select(coverage_byte(F.col("v"), 0.5)).collect()] == [0, 0, 255, 255]


def test_challenge_stays_apart(spark):
    rows = spark.createDataFrame(
        [("v", "train", 1, 0, 0, 0), ("v", "test", 0, 1, 1, 0), ("v", "challenge", 5, 0, 0, 0)],
        "variant string, split string, true_positive bigint, false_positive bigint, false_negative bigint, true_negative bigint",
    )
    found = {r.scope: (r.sample_count, r.dice) for r in metrics.variant_summary(rows).collect()}
    assert set(found) == {"train", "test", "challenge", "non_challenge"}
    assert found["non_challenge"] == (2, 0.5) and found["challenge"] == (1, 1.0)
