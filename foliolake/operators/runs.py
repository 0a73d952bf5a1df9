"""Training-run logs: early stopping, retained rows, batch means, throughput, leaderboards, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.operators.raster import attach_page_values

BLOCK = 1024


def _best_before_block(rows: DataFrame, loss: str) -> DataFrame:
    """Lowest loss of all earlier blocks of the run.

    A run is cut into blocks of epochs; only one row per block meets in a run-wide window, so a run
    that holds a third of the log is still worked on in parallel.
    """
    blocks = rows.groupBy("run_id", "_block").agg(F.min(loss).alias("_min"))
    earlier = Window.partitionBy("run_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("run_id", "_block", F.min("_min").over(earlier).alias("_before_min"))
    return rows.join(before, ["run_id", "_block"])


def early_stopping(log: DataFrame, patience: int, loss: str = "loss") -> DataFrame:
    """Per epoch: best loss so far, whether it improved (strictly), the stale streak, and the stop flag.

    ``log`` has ``run_id, epoch, loss``. The run stops at the first epoch whose streak exceeds
    ``patience``; rows after it are marked ``after_stop``.
    """
    # As if every run began at infinity: a NaN or null loss never improves and never is the best.
    given = F.col(loss)
    log = log.withColumn("_given", given).withColumn(loss, F.coalesce(F.nanvl(given.cast("double"), F.lit(float("inf"))), F.lit(float("inf"))))
    inside = Window.partitionBy("run_id", "_block").orderBy("epoch")
    earlier, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_block", F.floor(F.col("epoch") / BLOCK))
    rows = _best_before_block(rows, loss)
    best = F.least(F.min(loss).over(earlier), F.col("_before_min"))
    rows = rows.withColumn("_best", best).withColumn("improved", F.col(loss) < F.coalesce("_best", F.lit(float("inf"))))
    rows = rows.withColumn("_pos", F.row_number().over(inside)).drop("_before_min")
    hit = F.when(F.col("improved"), F.col("_pos"))
    rows = _with_stale(rows, hit, upto)
    rows = rows.withColumn("best_loss", F.least(F.col(loss), F.col("_best")))
    stop = rows.where(F.col("stale_epochs") > patience).groupBy("run_id").agg(F.min("epoch").alias("stop_epoch"))
    marked = attach_page_values(rows, stop, ("run_id",), deal="epoch", how="left")
    return marked.select(
        "run_id", "epoch", F.col("_given").alias(loss), "best_loss", "improved", "stale_epochs", "stop_epoch",
        F.coalesce(F.col("epoch") > F.col("stop_epoch"), F.lit(False)).alias("after_stop"),
    )


def _with_stale(rows: DataFrame, hit: Column, upto) -> DataFrame:
    """Rows since the last improvement, across blocks."""
    blocks = rows.groupBy("run_id", "_block").agg(F.count(F.lit(1)).alias("_n"), F.max(hit).alias("_hit"))
    order = Window.partitionBy("run_id").orderBy("_block")
    placed = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.max(F.col("_start") + F.col("_hit")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    facts = placed.select("run_id", "_block", "_start", last.alias("_last"))
    joined = rows.join(facts, ["run_id", "_block"])
    own = F.max(F.col("_start") + hit).over(upto)
    return joined.withColumn(
        "stale_epochs", (F.col("_start") + F.col("_pos") - F.coalesce(own, F.col("_last"), F.lit(0))).cast("bigint")
    )


def retained_rows(log: DataFrame, completed: DataFrame) -> DataFrame:
    """Log rows up to the last durable epoch of their run; rows without an integer epoch are dropped."""
    whole = F.col("epoch").isNotNull() & (F.col("epoch") == F.floor("epoch"))
    return attach_page_values(log.where(whole).withColumn("_deal", F.col("epoch").cast("bigint")), completed, ("run_id",), deal="_deal").where(
        F.col("epoch") <= F.col("completed_epoch")
    ).drop("_deal", "completed_epoch")


def epoch_means(batches: DataFrame, keys: Sequence[str], batch: str, terms: Sequence[str]) -> DataFrame:
    """Mean of batch means: every batch weighs the same, whatever its size."""
    per_batch = batches.groupBy(*keys, batch).agg(*[F.avg(t).alias(t) for t in terms])
    return per_batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("batches"), *[F.avg(t).alias(t) for t in terms])


def page_throughput(timings: DataFrame) -> DataFrame:
    """Megapixels per second of each page from its own measured latency."""
    rate = F.try_divide(F.col("width") * F.col("height") / 1e6, F.col("latency_seconds"))
    return timings.withColumn("megapixels_per_second", rate)


def total_throughput(timings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All pixels over the whole time, which is not the mean of the page rates."""
    pixels, seconds = F.sum(F.col("width") * F.col("height")), F.sum("latency_seconds")
    return timings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), pixels.alias("pixels"), seconds.alias("latency_seconds"),
        F.try_divide(pixels / 1e6, seconds).alias("megapixels_per_second"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Best model per metric on validation, and every model's ratio to that best.

    ``scores`` has ``model, split, metric, score``; one row per metric is joined back.
    """
    own = scores.where(F.col("split") == "validation").select("model", "metric", "score")
    best = own.groupBy("metric").agg(F.max(F.struct("score", "model")).alias("b")).select(
        "metric", F.col("b.model").alias("best_model"), F.col("b.score").alias("best_score")
    )
    return own.join(best, "metric").withColumn("ratio", F.try_divide(F.col("score"), F.col("best_score")))


def completed_runs(summaries: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs that can be returned as they are: a numeric summary, a checkpoint, and an equal config.

    ``summaries`` has ``run_id, epochs_completed, best_loss, has_checkpoint, config_signature``.
    """
    wanted = configs.select("run_id", F.col("config_signature").alias("_wanted"))
    joined = summaries.join(wanted, "run_id")
    usable = F.col("epochs_completed").isNotNull() & F.col("best_loss").isNotNull() & F.coalesce("has_checkpoint", F.lit(False))
    compatible = F.col("config_signature").isNull() | (F.col("config_signature") == F.col("_wanted"))
    status = F.when(~usable, F.lit("incomplete")).when(compatible, F.lit("complete")).otherwise(F.lit("different configuration"))
    return joined.select("run_id", status.alias("status"))


def loss_curves(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Curves in long form with each run's overall low and high for scaling.

    A field that is absent from the first row of a run is left out for the whole run.
    """
    first = log.groupBy("run_id").agg(F.min_by(F.struct(*fields), "epoch").alias("_first"))
    known = lambda f: F.when(F.col(f"_first.{f}").isNotNull(), F.col(f))
    marked = attach_page_values(log, first, ("run_id",), deal="epoch").withColumns({f: known(f) for f in fields})
    low, high = [F.least(*[F.col(f) for f in fields]), F.greatest(*[F.col(f) for f in fields])] if len(fields) > 1 else [F.col(fields[0])] * 2
    scale = marked.groupBy("run_id").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    long = marked.unpivot(["run_id", "epoch"], list(fields), "field", "value").where("value IS NOT NULL")
    return attach_page_values(long, scale, ("run_id",), deal="epoch")
