import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.operators import augment


@pytest.fixture
def page():
    plane = np.full((160, 96), 250)
    for top in range(20, 140, 20):
        plane[top : top + 2, 8:88] = 10
    plane[60:70, 30:40] = 0
    return plane


def recipe(spark, family, **parameters):
    return spark.createDataFrame(
        [(1, [(1, family, 77, {k: float(v) for k, v in parameters.items()})])],
        "page_id bigint, degradations array<struct<order:int,family:string,seed:bigint,parameters:map<string,double>>>",
    )


CASES = {
    "blur": dict(radius=1.2), "gaussian_noise": dict(sigma=6.0), "uneven_illumination": dict(strength=0.2, grid_size=4),
    "stains": dict(opacity=0.2, blob_count=5, blob_radius_fraction=0.03, speckle_density=0.0005),
}


@pytest.mark.parametrize("family", CASES)
def test_family_changes_pixels_not_size(spark, scan_of, plane_of, page, family):
    steps = recipe(spark, family, **CASES[family])
    once = np.array(plane_of(augment.apply_recipes(scan_of({1: page}), steps))[1])
    again = np.array(plane_of(augment.apply_recipes(scan_of({1: page}).repartition(5), steps))[1])
    assert once.shape == page.shape and (once != page).any()
    assert once.min() >= 0 and once.max() <= 255
    np.testing.assert_array_equal(once, again)


def test_page_without_recipe_and_jpeg_are_unchanged(spark, scan_of, plane_of, page):
    out = plane_of(augment.apply_recipes(scan_of({1: page, 2: page}), recipe(spark, "jpeg", quality=80)))
    np.testing.assert_array_equal(out[1], page)
    np.testing.assert_array_equal(out[2], page)


def test_noise_has_the_asked_spread(spark, scan_of, plane_of):
    flat = np.full((400, 100), 128)
    out = np.array(plane_of(augment.apply_recipes(scan_of({1: flat}), recipe(spark, "gaussian_noise", sigma=10.0)))[1])
    assert abs(out.mean() - 128) < 0.5 and abs(out.std() - 10) < 0.3


def test_light_only_darkens(spark, scan_of, plane_of):
    flat = np.full((200, 50), 200)
    out = np.array(plane_of(augment.apply_recipes(scan_of({1: flat}), recipe(spark, "uneven_illumination", strength=0.3, grid_size=3)))[1])
    assert out.max() <= 212 and out.min() >= 128 and out.std() > 1


def test_long_chain_equals_one_step_at_a_time(spark, scan_of, plane_of):
    tall = np.random.default_rng(1).integers(0, 256, (700, 40))
    ops = [(i + 1, f, 11 * i, {k: float(v) for k, v in CASES[f].items()}) for i, f in enumerate(("blur", "stains", "gaussian_noise", "blur"))]
    schema = "page_id bigint, degradations array<struct<order:int,family:string,seed:bigint,parameters:map<string,double>>>"
    whole = plane_of(augment.apply_recipes(scan_of({1: tall}), spark.createDataFrame([(1, ops)], schema)))[1]
    step = tall
    for _, family, seed, parameters in ops:
        one = spark.createDataFrame([(1, [(1, family, seed, parameters)])], schema)
        step = np.array(plane_of(augment.apply_recipes(scan_of({1: step}), one))[1])
    np.testing.assert_array_equal(whole, step)


def test_one_call(spark, scan_of, plane_of, page):
    scan = scan_of({i: page for i in range(6)})
    ids = scan.select("page_id").distinct()
    a = plane_of(augment.augment(scan, ids, "heavy", 4))
    assert len(a) == 6 and any((np.array(a[i]) != page).any() for i in a)
    assert a == plane_of(augment.augment(scan, ids, "heavy", 4))


def test_hash_sees_size_and_pixels(scan_of):
    h = {r.page_id: r.pixel_sha256 for r in augment.pixel_hash(scan_of({1: [[1, 2], [3, 4]], 2: [[1, 2], [3, 4]], 3: [[1, 2, 3, 4]], 4: [[1, 2], [3, 5]]})).collect()}
    assert h[1] == h[2] and len(set(h.values())) == 3
    assert augment.pixel_hash(scan_of({1: [[1]]})).select(F.length("pixel_sha256")).first()[0] == 64


@pytest.mark.parametrize(
    "family, parameters",
    [("blur", dict(radius=12.0)), ("uneven_illumination", dict(strength=0.2, grid_size=14)), ("gaussian_noise", dict(sigma=-1.0)), ("fog", dict(depth=1.0))],
)
def test_out_of_range_steps_are_refused(spark, scan_of, page, family, parameters):
    steps = recipe(spark, family, **parameters)
    assert augment.refused_steps(steps).count() == 1
    with pytest.raises(Exception, match="outside their limits"):
        augment.apply_recipes(scan_of({1: page}), steps).collect()


def test_limits_themselves_are_exact_over_bands(spark, scan_of, plane_of):
    tall = np.random.default_rng(3).integers(0, 256, (300, 40))
    out = np.array(plane_of(augment.apply_recipes(scan_of({1: tall}), recipe(spark, "blur", radius=5.0)))[1])
    from foliolake.operators import stencil

    want = stencil.smooth(tall.astype(float), augment.blur_taps(5.0), "edge")
    np.testing.assert_array_equal(out, np.clip(stencil.to_level(want), 0, 255))


def test_wide_blur_column_is_refused(spark, scan_of, page):
    with pytest.raises(Exception, match="blur radius"):
        augment.blur(scan_of({1: page}).withColumn("sigma", F.lit(6.0))).collect()


def test_unapplied_steps_are_listed(spark):
    rows = augment.unapplied_steps(recipe(spark, "jpeg", quality=80)).collect()
    assert [(r.page_id, r.order, r.family) for r in rows] == [(1, 1, "jpeg")]


@pytest.mark.parametrize("config", ["typo", "custom"])
def test_unknown_preset_is_refused(spark, scan_of, page, config):
    scan = scan_of({1: page})
    with pytest.raises(ValueError, match="unknown preset"):
        augment.augment(scan, scan.select("page_id").distinct(), config)


SCHEMA = "page_id bigint, degradations array<struct<order:int,family:string,seed:bigint,parameters:map<string,double>>>"


def test_one_page_of_long_reach_leaves_the_bands_of_others(spark, scan_of, plane_of):
    draw = np.random.default_rng(8)
    pages = {1: draw.integers(0, 256, (500, 30)), 2: draw.integers(0, 256, (700, 500)), 3: draw.integers(0, 256, (140, 30))}
    small = [(1, "blur", 5, {"radius": 1.0})]
    long = [(1, "stains", 6, {"opacity": 0.3, "blob_count": 4.0, "blob_radius_fraction": 0.1, "speckle_density": 0.0001}), (2, "blur", 7, {"radius": 5.0})]
    facts = augment._recipe_facts(
        spark.createDataFrame([(1, small), (2, long), (3, small)], SCHEMA), augment.page_shape(scan_of(pages)), F.col("degradations")
    )
    classes = {r.page_id: (r._reach, r._rows) for r in facts.collect()}
    assert classes[1] == classes[3] == (4, 128) and classes[2][0] >= 32 and classes[2][1] == max(128, 2 * classes[2][0])
    together = plane_of(augment.apply_recipes(scan_of(pages), spark.createDataFrame([(1, small), (2, long)], SCHEMA)))
    for number, steps in ((1, small), (2, long)):
        alone = plane_of(augment.apply_recipes(scan_of({number: pages[number]}), spark.createDataFrame([(number, steps)], SCHEMA)))
        np.testing.assert_array_equal(together[number], alone[number])
    np.testing.assert_array_equal(together[3], pages[3])
    from foliolake.operators import stencil

    want = stencil.smooth(pages[1].astype(float), augment.blur_taps(1.0), "edge")
    np.testing.assert_array_equal(together[1], np.clip(stencil.to_level(want), 0, 255))


def test_applying_recipes_runs_no_job(spark, scan_of, page):
    tracker = spark.sparkContext.statusTracker()
    scan, steps = scan_of({1: page}), recipe(spark, "blur", radius=1.2)
    spark.sparkContext.setJobGroup("augment-plan", "augment-plan")
    augment.apply_recipes(scan, steps)
    spark.sparkContext.setJobGroup("", "")
    assert not tracker.getJobIdsForGroup("augment-plan")
