import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliolake.operators import raster, tiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the test folder


def pointwise(values):
    return np.stack([4 * values - 2, values, 2 * values, 3 * values, 4 * values], axis=1)


def test_starts(spark):
    df = spark.createDataFrame([(32,), (79,), (20,), (128,)], "n int")
    got = {r.n: list(r.s) for r in df.select("n", tiles.tile_starts(F.col("n"), 32, 8).alias("s")).collect()}
    assert got == {32: [0], 79: [0, 24, 47], 20: [0], 128: [0, 24, 48, 72, 96]}
    assert all(tiles._starts(n, 32, 8) == s for n, s in got.items())
    with pytest.raises(ValueError):
        tiles.tile_starts(F.col("n"), 32, 32)


def test_reflection_repeats(scan_of):
    cut = tiles.cut_tiles(scan_of({1: [[1, 2], [3, 4]]}), 4, 0)
    rows = sorted((r.ty, list(r.cells)) for r in tiles.padded_tiles(cut, 4).collect())
    assert rows == [(0, [1, 2, 1, 2]), (1, [3, 4, 3, 4]), (2, [1, 2, 1, 2]), (3, [3, 4, 3, 4])]
    assert tiles._pad(np.array([[1, 2], [3, 4]]), 4).tolist() == [c for _, c in rows]


def test_thin_page_is_replicated(scan_of):
    cut = tiles.cut_tiles(scan_of({1: [[7, 9]]}), 3, 0)
    assert sorted((r.ty, list(r.cells)) for r in tiles.padded_tiles(cut, 3).collect()) == [(i, [7, 9, 9]) for i in range(3)]
    assert tiles._pad(np.array([[7, 9]]), 3).tolist() == [[7, 9, 9]] * 3


def test_pointwise_scorer_leaves_no_seam(scan_of, plane_of):
    ramp = (np.add.outer(np.arange(91), np.arange(75)) % 256).astype(int)
    logits = tiles.score_pages(scan_of({1: ramp}), pointwise, 32, 8)
    np.testing.assert_allclose(plane_of(logits, "cleaning")[1], 4 * ramp / 255 - 2, atol=1e-6)
    np.testing.assert_allclose(plane_of(logits, "text")[1], 4 * ramp / 255, atol=1e-6)


def test_large_page_keeps_size_and_tiles_stay_small(scan_of, plane_of):
    page = np.full((701, 983), 180)
    scan = scan_of({1: page})
    strips = tiles.cut_strips(scan, 128, 32)
    assert strips.groupBy("page_id", "top").count().agg(F.max("count")).first()[0] <= 128
    cleaned = plane_of(tiles.page_results(tiles.score_pages(scan, pointwise, 128, 32)), "cleaned")[1]
    assert np.array(cleaned).shape == page.shape and set(np.unique(cleaned)) <= {0, 255}


def test_scorer_sees_whole_tiles(scan_of):
    def check(values):
        assert values.shape[1:] == (32, 32)
        return pointwise(values)

    assert tiles.score_pages(scan_of({1: np.ones((5, 40))}), check, 32, 8).count() == 5


def test_metadata(scan_of):
    row = tiles.page_metadata(scan_of({1: np.ones((79, 20))}), 32, 8).first()
    assert (row.height, row.width, row.tile_count) == (79, 20, 3)
    assert raster.page_shape(scan_of({1: np.ones((79, 20))})).count() == 1


def test_logits_are_blended_where_they_are_scored(scan_of):
    page = np.random.default_rng(3).integers(0, 256, (1100, 40))
    logits = tiles.score_pages(scan_of({1: page}), pointwise, 32, 8, logits="double")
    assert logits._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = np.array([r.staff for r in sorted(logits.collect(), key=lambda r: r.y)])
    assert np.allclose(got, 2 * page / 255.0)


def test_levels_beyond_bytes_are_scored_as_they_are(spark, scan_of, plane_of):
    page = np.arange(20 * 30).reshape(20, 30) % 256
    page[3, 4], page[7, 0], page[7, 29] = -7, 300, -200
    logits = tiles.score_pages(scan_of({1: page}), lambda v: np.stack([v] * 5, axis=1), 16, 4, logits="double")
    assert np.allclose(plane_of(logits, "text")[1], page / 255.0)
