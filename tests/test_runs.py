import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.operators import crops, losses, lookups, runs, validation


def loop(values, patience):
    best, stale, rows, stop = float("inf"), 0, [], None
    for epoch, loss in enumerate(values, start=1):
        improved = loss < best
        best, stale = (loss, 0) if improved else (best, stale + 1)
        rows.append((epoch, improved, stale))
        if stop is None and stale > patience:
            stop = epoch
    return rows, stop


@pytest.mark.parametrize("block", [4, 1024])
def test_early_stopping_equals_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    rng = np.random.default_rng(5)
    series = {1: rng.random(60).round(1), 2: np.full(30, 0.5), 3: np.linspace(1, 0, 25), 4: np.array([0.3])}
    rows = [(r, e, float(v)) for r, values in series.items() for e, v in enumerate(values, start=1)]
    log = spark.createDataFrame(rows, "run_id int, epoch bigint, loss double").repartition(5)
    got = runs.early_stopping(log, patience=6).collect()
    for run, values in series.items():
        want, stop = loop(values, 6)
        mine = sorted((r.epoch, r.improved, r.stale_epochs) for r in got if r.run_id == run)
        assert mine == want
        assert {r.stop_epoch for r in got if r.run_id == run} == {stop}


def test_batches_weigh_the_same(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 10.0)], "epoch int, batch string, loss double")
    assert runs.epoch_means(rows, ("epoch",), "batch", ("loss",)).first().loss == 6.0


def test_total_rate_is_not_the_mean_of_rates(spark):
    rows = spark.createDataFrame([(1000, 1000, 1.0), (1000, 1000, 3.0)], "width int, height int, latency_seconds double")
    assert runs.total_throughput(rows).first().megapixels_per_second == 0.5


def test_perfect_logits_cost_nothing_and_task_terms(spark):
    rows = [(1, task, c, [40.0, -40.0], [1.0, 0.0]) for task in ("clean", "segment", "multitask") for c in ("cleaning", "background", "staff", "notation", "text")]
    scan = spark.createDataFrame(rows, "item int, task string, channel string, logit array<double>, target array<double>")
    found = {r.task: r for r in losses.task_losses(losses.loss_sums(scan, ("item", "task", "channel")), ()).collect()}
    assert found["clean"].segment_loss is None and found["segment"].clean_loss is None
    assert found["multitask"].total_loss == pytest.approx(0, abs=1e-6)


def test_huge_logits_stay_finite(spark):
    value = spark.range(1).select(losses.bce(F.lit(-900.0), F.lit(1.0)).alias("a"), losses.bce(F.lit(900.0), F.lit(1.0)).alias("b")).first()
    assert value.a == 900.0 and value.b == 0.0


def test_crop_of_a_blank_page_is_uniform_and_padded(spark, scan_of):
    scan = scan_of({1: np.full((10, 12), 9)})
    members = scan.withColumn("member", F.transform("values", lambda v: F.lit(0)))
    draws = spark.createDataFrame([(0, 0, 1, 10, 12), (0, 1, 1, 10, 12)], "epoch int, index int, page_id bigint, height int, width int")
    plan = crops.crop_plan(draws, members, 16, 1.0, 0.5, 3)
    assert {(r.aware, r.attempt, r.top, r.left) for r in plan.collect()} == {(False, 1, 0, 0)}
    rows = crops.extract_crops(plan, scan, 16, 255).where("index = 0").orderBy("cy").collect()
    assert len(rows) == 16 and all(len(r.cells) == 16 for r in rows)
    assert rows[0].cells == [9] * 12 + [255] * 4 and rows[15].cells == [255] * 16


def test_aware_crop_falls_back_to_the_first_draw(spark, scan_of):
    member = np.zeros((60, 60), dtype=int)
    member[0, 0] = 1
    members = scan_of({1: member}).withColumnRenamed("values", "member")
    draws = spark.createDataFrame([(0, i, 1, 60, 60) for i in range(8)], "epoch int, index int, page_id bigint, height int, width int")
    rows = crops.crop_plan(draws, members, 8, 1.0, 0.9, 3).collect()
    assert {(r.aware, r.attempt) for r in rows} == {(True, 0)}


def test_best_checkpoint_and_override(spark):
    rows = spark.createDataFrame(
        [("b/best.pt", "unet", "clean", 0.9, 32, None, None), ("a/best.pt", "unet", "multitask", 0.1, 32, None, None),
         ("c/best.pt", "unet", "segment", 0.0, 32, None, None), ("d/best.pt", "resnet18", "clean", float("nan"), 32, None, None)],
        "path string, backend string, task string, validation_loss double, base_channels int, pretrained boolean, freeze_batch_norm boolean",
    )
    models = spark.createDataFrame([("m1", "unet"), ("m2", "unet"), ("m3", "resnet18")], "model string, backend string")
    overrides = spark.createDataFrame([("m2", "x.pt")], "model string, path string")
    got = {r.model: (r.path, r.selection) for r in lookups.selected_checkpoints(models, rows, overrides).collect()}
    assert got == {"m1": ("a/best.pt", "automatic_lowest_validation_loss"), "m2": ("x.pt", "explicit_override"), "m3": (None, None)}


def test_closure_survives_cycles_and_skips_unsafe(spark):
    files = spark.createDataFrame(
        [("d/a.ly", '\\include "b.ly"\n\\include "english.ly"'), ("d/b.ly", '\\include "c/x.ly" \\include "../up.ly"'), ("d/c/x.ly", '\\include "y.ly"'), ("d/c/y.ly", '\\include "x.ly"')],
        "path string, text string",
    )
    edges = lookups.include_edges(files)
    assert {r.include for r in edges.where("unsafe").collect()} == {"../up.ly"}
    roots = files.where("path = 'd/a.ly'").select("path")
    assert {r.path for r in lookups.include_closure(roots, edges).collect()} == {"d/a.ly", "d/b.ly", "d/c/x.ly", "d/c/y.ly"}


def test_record_rules_work_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"sample_id": "s"}\n\nnot json\n[1]\n')
    lines = spark.readStream.text(str(tmp_path / "in")).select(F.lit("a").alias("file"), F.lit(0).cast("bigint").alias("line_no"), "value")
    query = (
        validation.structural_problems(lines).writeStream.format("memory").queryName("structural")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert sorted(r.rule for r in spark.table("structural").collect()) == ["blank_line", "invalid_json", "not_object"]


def test_nan_loss_never_improves(spark):
    log = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 5.0), (1, 3, float("nan")), (1, 4, 4.0)], "run_id bigint, epoch bigint, loss double")
    rows = {r.epoch: r for r in runs.early_stopping(log, 1).collect()}
    assert [rows[e].improved for e in (1, 2, 3, 4)] == [False, True, False, True]
    assert [rows[e].best_loss for e in (2, 3, 4)] == [5.0, 5.0, 4.0]


def test_covered_members_over_bands_and_a_page_asked_for_often(spark, scan_of):
    draw = np.random.default_rng(4)
    pages = {1: draw.integers(0, 2, (300, 40)), 2: draw.integers(0, 2, (20, 9))}
    asked = []
    for n in range(900):
        page = 1 if n % 9 else 2
        height, width = pages[page].shape
        y, x = int(draw.integers(0, height)), int(draw.integers(0, width))
        asked.append((page, 0, n, 1, y, int(draw.integers(y + 1, height + 1)), x, int(draw.integers(x + 1, width + 1))))
    schema = "page_id bigint, epoch int, `index` int, attempt int, y int, bottom int, `left` int, `right` int"
    members = scan_of(pages).withColumnRenamed("values", "member")
    found = crops.covered_members(spark.createDataFrame(asked, schema), members)
    want = {a[2]: int(pages[a[0]][a[4] : a[5], a[6] : a[7]].sum()) for a in asked}
    assert {r["index"]: r.n for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array<bigint>" not in plan and "integral" not in plan


def test_crops_of_pages_without_lines_or_height(spark, scan_of):
    members = scan_of({1: np.ones((1, 9))}).withColumnRenamed("values", "member")
    schema = "epoch int, index int, page_id bigint, height int, width int"
    draws = spark.createDataFrame([(0, 0, 1, 0, 9), (0, 1, 2, 0, 9), (0, 2, 3, None, 9)], schema)
    rows = {r["index"]: r for r in crops.crop_plan(draws, members, 16, 1.0, 0.5, 3).collect()}
    assert {i: (r.aware, r.top, r.left, r.attempt) for i, r in rows.items()} == {0: (True, 0, 0, 0), 1: (False, 0, 0, 1), 2: (False, 0, 0, 1)}
