"""The fused band pass against the single kernels, on pages of many bands and of scale one and two."""

import numpy as np
import pytest

from foliolake.functions.pixel import predicted_ink, target_ink
from foliolake.operators import kernels, metrics, suite


def page(height, width, seed):
    draw = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    light = 150 + 70 * np.sin(y / 90 + seed) * np.cos(x / 70)
    ink = (np.sin(y / 5) + np.sin(x / 7 + y / 31) > 1.1) * 110
    return np.clip(light - ink + draw.integers(-12, 13, (height, width)), 0, 255).astype(int)


@pytest.fixture
def scan(spark):
    rows = []
    for number, (height, width) in enumerate([(300, 96), (40, 33), (620, 400), (530, 800), (1, 5)]):
        plane = page(height, width, number)
        clean = np.where(page(height, width, number + 1) < 90, 20, 240)
        rows += [(number, y, plane[y].tolist(), clean[y].tolist()) for y in range(height)]
    return spark.createDataFrame(rows, "page_id bigint, y int, values array<int>, clean array<int>").repartition(8, "page_id", "y")


def test_fused_metrics_equal_the_single_kernels(spark, scan):
    config = kernels.CleaningConfig()
    lines = kernels.cleaning_suite(scan, config, keep=("clean",))
    keys = ("page_id", "variant")
    counts = metrics.confusion_counts(lines, "binary", "clean", predicted_ink, target_ink, keys)
    want = {(r.page_id, r.variant): r for r in counts.join(kernels.ssim(lines, "binary", "clean", keys), list(keys)).collect()}
    got = {(r.page_id, r.variant): r for r in suite.suite_metrics(scan, config).collect()}
    spark.catalog.clearCache()
    assert got.keys() == want.keys() and len(got) == 20
    for key, r in got.items():
        assert [r[c] for c in metrics.COUNTS] == [want[key][c] for c in metrics.COUNTS], key
        assert r.ssim == pytest.approx(want[key].ssim, abs=1e-9), key
    levels = {r.page_id: r.threshold for r in kernels.otsu_pages(kernels.normalize_illumination(scan, config), "normalized").collect()}
    assert {(p, r.threshold_value) for (p, v), r in got.items() if v == "otsu"} == set(levels.items())


def test_pixels_are_shuffled_once_and_nothing_is_cached(spark, scan):
    result = suite.suite_metrics(scan)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "InMemoryTableScan" not in plan and "ReusedExchange" in plan
    banded = [line for line in plan.split("\n") if "Exchange hashpartitioning(page_id" in line and "band" in line and "REPARTITION" in line]
    # The pixels, read again once, and the reduced pages of the light field.
    assert len(banded) == 3 and sum("ReusedExchange" in line for line in banded) == 1


def test_lines_travel_as_bytes(scan):
    bands, _ = suite.banded(scan, kernels.CleaningConfig())
    types = dict(bands.dtypes)
    assert types["line"] == types["target"] == "array<tinyint>"
