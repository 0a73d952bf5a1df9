import hashlib

import pytest
from pyspark.sql import functions as F

from foliolake.constants import FAMILIES, SPLITS
from foliolake.plans import augment, layout, samples, splits

WEIGHTS = {"train": 0.7, "validation": 0.1, "test": 0.1, "challenge": 0.1}


@pytest.fixture
def ids(spark):
    return spark.createDataFrame([(f"source-{i}",) for i in range(100)], "source_id string")


def assign(ids, seed):
    return {r[0]: r[1] for r in ids.select("source_id", splits.split_of(F.col("source_id"), WEIGHTS, seed)).collect()}


def test_split_is_the_hash_of_seed_and_id(ids):
    got = assign(ids, 1234)
    assert set(got.values()) == set(SPLITS)
    edges, edge = [], 0.0
    for w in WEIGHTS.values():
        edge += w / sum(WEIGHTS.values())
        edges.append(edge)
    for source, split in got.items():
        u = int.from_bytes(hashlib.sha256(f"1234:{source}".encode()).digest()[:8], "big") / 2**64
        assert split == next((s for s, e in zip(SPLITS, edges) if u < e), SPLITS[-1])
    assert got == assign(ids.repartition(7), 1234) and got != assign(ids, 1235)


def test_split_arguments():
    with pytest.raises(ValueError):
        splits.split_of(F.col("x"), {"train": 1.0}, 1)
    with pytest.raises(ValueError):
        splits.split_of(F.col("x"), dict.fromkeys(SPLITS, 0.0), 1)
    with pytest.raises(ValueError):
        splits.selected_splits(["train", "holdout"])
    assert splits.selected_splits(["challenge", "train"]) == ("train", "challenge")


def test_layout_seed_is_unsigned(ids):
    rows = layout.layout_grid(ids, layout.LayoutGrid(), 5).collect()
    assert len(rows) == 100 * 16 and len({r.layout_seed for r in rows}) == len(rows)
    one = rows[0]
    text = f"5:{one.source_id}:{one.staff_size}:{one.paper_format}:{one.orientation}:{one.variant_index}"
    assert int(one.layout_seed) == int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    assert all(8.0 <= m <= 16.0 for r in rows for m in r.margins_mm)


@pytest.mark.parametrize("partitions", [1, 5])
def test_plan_does_not_depend_on_partitions(spark, partitions):
    rows = spark.createDataFrame([(f"r{i}", i % 3, SPLITS[i % 4], f"s{i}") for i in range(37)], "render_id string, page int, split string, source_id string")
    plan = samples.sample_plan(rows.repartition(partitions), 100, "d", 9).collect()
    assert sorted(r.sample_index for r in plan) == list(range(100))
    assert len({r.sample_id for r in plan}) == 100
    assert all(r.preset == "random" for r in plan if r.split == "challenge")
    uses = [sum(r.render_id == f"r{i}" for r in plan) for i in range(37)]
    assert max(uses) - min(uses) == 1
    again = samples.sample_plan(rows.repartition(3), 100, "d", 9).collect()
    assert {tuple(r.asDict().items()) for r in plan} == {tuple(r.asDict().items()) for r in again}


@pytest.mark.parametrize("preset,low,high", [("light", 1, 2), ("medium", 2, 3), ("heavy", 3, 5), ("random", 1, 5)])
def test_recipe_counts_and_ranges(spark, preset, low, high):
    families, ranges = augment.preset_config(F.lit(preset))
    rows = augment.augmentation_plan(spark.range(200).select(F.col("id").alias("seed")), families, ranges).collect()
    counts = {len(r.degradations) for r in rows}
    assert counts == set(range(low, high + 1))
    limits = {(f, n): (lo, hi) for p, f, n, lo, hi, _ in augment.preset_rows() if p == preset}
    for row in rows:
        assert [o.order for o in row.degradations] == list(range(1, len(row.degradations) + 1))
        assert len({o.family for o in row.degradations}) == len(row.degradations)
        for o in row.degradations:
            for name, value in o.parameters.items():
                lo, hi = limits[o.family, name]
                unit = 1 if name in ("grid_size", "quality", "blob_count") else 1e6
                assert lo <= round(value * unit) <= hi


def test_more_operations_than_families_repeats(spark):
    row = spark.range(50).select(
        augment.chosen_families(F.array(F.lit("blur"), F.lit("jpeg")), F.lit(4).cast("bigint"), F.col("id")).alias("f")
    ).collect()
    assert all(len(r.f) == 4 and set(r.f) == {"blur", "jpeg"} for r in row)
    assert set(FAMILIES) >= {"blur", "jpeg"}


def test_seeded_sample_ignores_order_and_repeats(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    a = {r.k for r in samples.seeded_sample(rows, "k", 7, 3).collect()}
    b = {r.k for r in samples.seeded_sample(rows.union(rows).repartition(6), "k", 7, 3).collect()}
    assert a == b and len(a) == 7


def test_seeded_sample_is_the_head_of_the_digest_order(spark):
    from foliolake.functions.rand import keyed_digest

    rows = spark.range(5000).selectExpr("id % 3000 AS k")
    order = [r.k for r in rows.distinct().orderBy(keyed_digest(3, F.col("k").cast("string"))).collect()]
    for count in (0, 1, 700, 2999, 3000, 9000):
        found = samples.seeded_sample(rows, "k", count, 3)
        assert {r.k for r in found.collect()} == set(order[:count])
    plan = samples.seeded_sample(rows, "k", 1_000_000, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("preset", ["typo", None])
def test_unknown_preset_raises_where_ranges_are_resolved(spark, preset):
    plan = spark.createDataFrame([(1, "light"), (2, preset)], "config_id bigint, preset string")
    with pytest.raises(Exception, match="unknown preset"):
        augment.resolve_presets(plan).collect()


@pytest.mark.parametrize("family, field, low, high", [("blur", "colour", 1, 2), ("fog", "depth", 1, 2), ("blur", "radius", 2, 1), ("", "operation_count", 0, 3)])
def test_refused_overrides_raise_where_ranges_are_resolved(spark, family, field, low, high):
    plan = spark.createDataFrame([(1, "light")], "config_id bigint, preset string")
    overrides = spark.createDataFrame([(1, family, field, low, high, True)], "config_id bigint, family string, field string, low bigint, high bigint, enabled boolean")
    assert augment.refused_configs(plan, overrides).count() == 1
    with pytest.raises(Exception, match="unknown field|within its limits"):
        augment.resolve_presets(plan, overrides).collect()


def test_run_overlap_of_overlapping_and_odd_runs(spark):
    import numpy as np

    from foliolake.operators import raster

    draw = np.random.default_rng(1)
    sides = []
    for _ in range(2):
        x0 = draw.integers(0, 60, 300)
        sides.append([(int(p), int(y), int(a), int(a + n)) for p, y, a, n in zip(draw.integers(0, 4, 300), draw.integers(0, 3, 300), x0, draw.integers(0, 9, 300))])
    sides[0] += [(None, 0, 0, 5), (9, 0, 0, 3)]
    sides[1] += [(None, 0, 0, 5), (9, 0, 3, 4)]
    want = {}
    for p, y, a, b in sides[0]:
        for q, z, c, d in sides[1]:
            n = min(b, d) - max(a, c)
            if p is not None and (p, y) == (q, z) and n > 0:
                want[p] = want.get(p, 0) + n
    left, right = (spark.createDataFrame(s, "page_id bigint, y int, x0 int, x1 int") for s in sides)
    assert {r.page_id: r.overlap for r in raster.run_overlap(left, right).collect()} == want


def test_line_overlap_is_that_of_the_runs_and_shuffles_none(spark, scan_of):
    import numpy as np

    from pyspark.sql import functions as F

    from foliolake.operators import raster

    draw = np.random.default_rng(2)
    scan = scan_of({p: draw.integers(-9, 256, (5, w)) for p, w in ((1, 64), (2, 1), (3, 7), (4, 300))}).union(
        spark.createDataFrame([(5, 0, []), (5, 1, None), (6, 0, [200, None, 5])], "page_id bigint, y int, values array<int>")
    )
    dark, odd = lambda v: v < 128, lambda v: v % 3 != 0
    found = raster.line_overlap(scan, dark, odd)
    plan = found._jdf.queryExecution().executedPlan().toString()
    want = raster.run_overlap(raster.ink_runs(scan, dark), raster.ink_runs(scan, odd))
    pixels = raster.to_pixels(scan).where(dark(F.col("v")) & odd(F.col("v"))).groupBy("page_id").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) == sorted(map(tuple, pixels.collect()))
    assert plan.count("Exchange") == 1 and "Window" not in plan and plan.count("MapInArrow") == 1
