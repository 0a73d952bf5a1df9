"""Banded kernels must equal the whole-page kernel, and no group may grow with the page."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.operators import crops, kernels, quality, raster, stencil

RNG = np.random.default_rng(3)
TALL = RNG.integers(0, 256, (331, 23))
SMALL = RNG.integers(0, 256, (5, 23))


@pytest.mark.parametrize("rows", [16, 128])
def test_smoothing(scan_of, plane_of, rows):
    taps = stencil.gaussian_taps(11, 1.5)
    for border in ("edge", "reflect"):
        out = stencil.map_bands(
            scan_of({1: TALL, 2: SMALL}), lambda p: {"s": stencil.smooth(p["values"], taps, border)}, 5, ("values",), {"s": "double"}, rows=rows
        )
        got = plane_of(out, "s")
        for page, plane in ((1, TALL), (2, SMALL)):
            np.testing.assert_allclose(got[page], stencil.smooth(plane, taps, border), atol=1e-9)


def test_morphology_chain(scan_of, plane_of):
    binary = np.where(TALL > 100, 255, 0)
    config = kernels.CleaningConfig(kernel_size=5, iterations=2)
    ink = 255 - binary
    for grow in kernels.morphology_steps("open_close", 2):
        ink = stencil.spread(ink, stencil.ellipse_spans(5), grow)
    got = plane_of(kernels.morphology(scan_of({1: binary}), config, "values", "values"))
    np.testing.assert_array_equal(got[1], 255 - ink)
    assert set(np.unique(got[1])) <= {0, 255}


def test_ellipse_of_three_is_a_cross():
    assert stencil.ellipse_spans(3) == [(-1, 0), (0, 1), (1, 0)]


def brute_tiny(ink):
    seen, count = set(), 0
    cells = set(zip(*np.nonzero(ink)))
    for start in cells:
        if start in seen:
            continue
        stack, part = [start], {start}
        while stack:
            y, x = stack.pop()
            for n in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if n in cells and n not in part:
                    part.add(n)
                    stack.append(n)
        seen |= part
        count += len(part) <= 4
    return count


@pytest.mark.parametrize("density", [0.05, 0.2, 0.45])
def test_tiny_components(scan_of, density):
    ink = (RNG.random((400, 31)) < density).astype(int)
    got = quality.tiny_components(scan_of({1: ink}), "values").first().tiny_components
    assert got == brute_tiny(ink)


def test_large_page_similarity_shrinks_first(scan_of):
    a, b = RNG.integers(0, 256, (517, 523)), RNG.integers(0, 256, (517, 523))

    def shrink(p):
        h, w = p.shape[0] // 2, p.shape[1] // 2

        def weights(n, m):
            edge = np.linspace(0, n, m + 1)
            lo, hi = edge[:-1, None], edge[1:, None]
            i = np.arange(n)
            return np.clip(np.minimum(hi, i + 1) - np.maximum(lo, i), 0, None) / (n / m)

        return weights(p.shape[0], h) @ p @ weights(p.shape[1], w).T

    x, y = shrink(a), shrink(b)
    taps = stencil.gaussian_taps(11, 1.5)
    near = lambda p: stencil.smooth(p, taps, "reflect")
    mx, my = near(x), near(y)
    vx, vy, c = near(x * x) - mx**2, near(y * y) - my**2, near(x * y) - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    want = (((2 * mx * my + c1) * (2 * c + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean()
    pairs = scan_of({1: a}).join(scan_of({1: b}).withColumnRenamed("values", "other"), ["page_id", "y"])
    assert kernels.ssim(pairs, "values", "other").first().ssim == pytest.approx(want, abs=1e-9)


def test_integral_image(scan_of, plane_of):
    member = (RNG.random((300, 17)) < 0.3).astype(int)
    got = plane_of(crops.integral_rows(scan_of({1: member}).withColumnRenamed("values", "member")), "integral")
    np.testing.assert_array_equal(got[1], member.cumsum(0).cumsum(1))


def test_uneven_page_becomes_binary(scan_of, plane_of):
    light = np.tile(np.linspace(135, 245, 161), (91, 1))
    for top in (20, 45, 70):
        light[top : top + 2, 10:150] = 30
    page = light.astype(int)
    suite = kernels.cleaning_suite(scan_of({1: page}))
    assert {r.variant for r in suite.select("variant").distinct().collect()} == set(kernels.VARIANTS)
    otsu = plane_of(suite.where("variant = 'otsu'"), "binary")[1]
    assert np.array(otsu).shape == page.shape and set(np.unique(otsu)) == {0, 255}
    assert (np.array(otsu)[20:22, 20:140] == 0).all()


def test_bands_bound_the_group(spark, scan_of):
    rows = stencil.band_rows(scan_of({1: RNG.integers(0, 9, (5000, 3))}), 10)
    largest = rows.groupBy("page_id", "band").count().agg(F.max("count")).first()[0]
    assert largest <= stencil.BAND_ROWS + 20


def test_hot_page_facts_are_dealt_out(spark, scan_of):
    scan = scan_of({1: [[v % 256] for v in range(4000)], 2: [[1]]})
    facts = raster.page_shape(scan)
    dealt = raster.attach_page_values(scan, facts)
    assert dealt.count() == 4001 and {r.height for r in dealt.where("page_id = 1").select("height").distinct().collect()} == {4000}


def test_single_level_pages_stay_as_they_are(scan_of, plane_of):
    from foliolake.operators import kernels

    pages = {1: [[255] * 8] * 4, 2: [[0] * 8] * 4, 3: [[90] * 8] * 4, 4: [[10] * 4 + [200] * 4] * 4}
    out = plane_of(kernels.otsu_binarize(scan_of(pages)), "binary")
    assert out[1] == [[255] * 8] * 4 and out[2] == [[0] * 8] * 4 and out[3] == [[255] * 8] * 4
    assert out[4] == [[0] * 4 + [255] * 4] * 4


def test_a_null_key_is_a_group_of_its_own():
    import pyarrow as pa

    from foliolake.operators import stencil

    batch = pa.record_batch([pa.array([None, None, 1, 1, None], pa.int64()), pa.array(range(5))], names=["k", "v"])
    groups = [t.column("v").to_pylist() for part in stencil.group_tables(iter([batch]), ["k"]) for t in part]
    assert groups == [[0, 1], [2, 3], [4]]
