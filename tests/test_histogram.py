"""Histograms counted per batch, and what is summed from them."""

import pyarrow as pa
from pyspark.sql import functions as F

from foliolake.catalog.cleaning_metrics import otsu_counts
from foliolake.operators import kernels


def exploded(scan):
    """Pixel by pixel."""
    return sorted(map(tuple, scan.select("page_id", F.explode("values").alias("v")).groupBy("page_id", "v").count().collect()), key=repr)


def test_levels_of_odd_lines_are_counted_like_pixels(spark):
    rows = [(1, 0, [3, 3, 255]), (2, 0, [0]), (1, 1, [3, None]), (None, 0, [7]), (2, 1, None), (2, 2, []), (3, 0, [None])]
    for wide in ([], [(4, 0, [-5, 300, 300, None])]):
        scan = spark.createDataFrame(rows + wide, "page_id bigint, y int, values array<int>").coalesce(1)
        assert sorted(map(tuple, kernels.histogram(scan).collect()), key=repr) == exploded(scan)


def test_otsu_counts_read_the_lines_once_and_make_no_row_per_pixel(spark):
    scan = spark.createDataFrame([(1, 0, [10, 200, 10, 130]), (2, 0, [9, 9]), (None, 0, [1, 2])], "page_id bigint, y int, values array<int>")
    counts = otsu_counts(scan)
    assert sorted(map(tuple, counts.collect())) == [(1, 2, 0, 0, 2), (2, 0, 0, 2, 0)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_levels_below_zero_are_counted_in_cells_and_far_ones_sorted(spark):
    rows = [(1, 0, [3, 3, 255]), (2, 0, [-7, 255, None]), (2, 1, [-7, -7]), (3, 0, [None])]
    far = [(4, 0, [-(2**31), 2**31 - 1, None])]
    for added in ([], far):
        scan = spark.createDataFrame(rows + added, "page_id bigint, y int, values array<int>").coalesce(1)
        assert sorted(map(tuple, kernels.histogram(scan).collect()), key=repr) == exploded(scan)


def test_levels_below_zero_need_no_sort(monkeypatch):
    values = pa.array([[-7, 255, 255], [255, -7]], pa.list_(pa.int32()))
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), values], names=["page_id", "_values"])
    monkeypatch.setattr(kernels.np, "unique", None)
    (found,) = kernels._level_counts([batch])
    assert found.to_pydict() == {"page_id": [1, 1, 2, 2], "v": [-7, 255, -7, 255], "n": [1, 2, 1, 1]}
