"""Run logs, losses and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.cleaning_metrics import rounded
from foliolake.catalog.kernels import CLEAN_SQL, with_clean
from foliolake.catalog.masks import layer_sql, layers
from foliolake.catalog.planning import S, docs, key, vsql
from foliolake.catalog.rasters import DENSE, SEED, TEXT, dense, r6_sql, textpage, u_sql
from foliolake.catalog.registry import query, table
from foliolake.constants import CLASSES
from foliolake.functions.score import r6
from foliolake.operators import crops, losses, raster, runs
from foliolake.operators.ranking import rank_within


def log(spark, sf):
    """Events as an epoch log: run = user, epoch = rank in time, loss = value."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return rank_within(rows, "user_id", ("ts", "event_id"), "epoch").select(
        F.col("user_id").alias("run_id"), "epoch", F.col("value").alias("loss"), "event_id"
    )


LOG = "log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss, event_id FROM events)"


@query(
    "early_stopping",
    sql=f"WITH {LOG}, b AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM log), "
    "i AS (SELECT *, coalesce(loss < prev, true) AS improved FROM b), "
    "l AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stale FROM i), "
    "s AS (SELECT run_id, min(epoch) AS stop_epoch FROM l WHERE stale > 5 GROUP BY run_id) "
    "SELECT l.run_id, epoch, loss, least(loss, prev) AS best_loss, improved, stale AS stale_epochs, stop_epoch, coalesce(epoch > stop_epoch, false) AS after_stop FROM l LEFT JOIN s USING (run_id)",
)
def early_stopping(spark, sf):
    return runs.early_stopping(log(spark, sf), patience=5)


@query("retained_rows", sql=f"WITH {LOG} SELECT run_id, CAST(epoch AS DOUBLE) AS epoch, loss FROM log WHERE epoch <= 10 + run_id % 7 AND event_id % 9 <> 0")
def retained_rows(spark, sf):
    e = F.col("event_id")
    rows = log(spark, sf).select("run_id", F.when(e % 9 == 0, F.col("epoch") + 0.5).otherwise(F.col("epoch") * 1.0).alias("epoch"), "loss")
    completed = rows.select("run_id").distinct().withColumn("completed_epoch", F.lit(10) + F.col("run_id") % 7)
    return runs.retained_rows(rows, completed)


@query(
    "epoch_means",
    sql="WITH b AS (SELECT conv_id % 5 AS run_id, conv_id % 3 AS epoch, role AS phase, conv_id AS batch, avg(length(text)) AS loss FROM conversations GROUP BY conv_id, role) "
    f"SELECT run_id, epoch, phase, count(*) AS batches, {r6_sql('avg(loss)')} AS loss FROM b GROUP BY run_id, epoch, phase",
)
def epoch_means(spark, sf):
    c = F.col("conv_id")
    rows = table(spark, sf, "conversations").select(
        (c % 5).alias("run_id"), (c % 3).alias("epoch"), F.col("role").alias("phase"), c.alias("batch"), F.length("text").alias("loss")
    )
    return rounded(runs.epoch_means(rows, ("run_id", "epoch", "phase"), "batch", ("loss",)), ("loss",))


def timings(spark, sf):
    d = F.col("doc_id")
    return docs(spark, sf).select(
        F.col("lang").alias("run"), d.alias("page_id"), F.lit(64).alias("width"), F.ceil(F.col("n_chars") / 64).cast("int").alias("height"),
        ((d % 10 + 1) / 8.0).alias("latency_seconds"),
    )


TIMINGS = "t AS (SELECT lang AS run, doc_id AS page_id, 64 AS width, CAST(ceil(n_chars / 64.0) AS INT) AS height, (doc_id % 10 + 1) / 8.0 AS latency_seconds FROM documents)"


@query("page_throughput", sql=f"WITH {TIMINGS} SELECT run, page_id, width, height, latency_seconds, {r6_sql('width * height / 1e6 / latency_seconds')} AS megapixels_per_second FROM t")
def page_throughput(spark, sf):
    return rounded(runs.page_throughput(timings(spark, sf)), ("megapixels_per_second",))


@query(
    "total_throughput",
    sql=f"WITH {TIMINGS} SELECT run, count(*) AS pages, CAST(sum(width * height) AS BIGINT) AS pixels, CAST(sum(latency_seconds) AS DOUBLE) AS latency_seconds, {r6_sql('sum(width * height) / 1e6 / sum(latency_seconds)')} AS megapixels_per_second FROM t GROUP BY run",
)
def total_throughput(spark, sf):
    return rounded(runs.total_throughput(timings(spark, sf), ("run",)), ("megapixels_per_second",))


SCORES = "sc AS (SELECT event_type AS model, 'validation' AS split, 'm' || (user_id % 4) AS metric, avg(value) AS score FROM events GROUP BY event_type, user_id % 4)"


@query(
    "leaderboard",
    sql=f"WITH {SCORES}, b AS (SELECT metric, max(score) AS best_score FROM sc GROUP BY metric) SELECT sc.model, sc.metric, {r6_sql('sc.score')} AS score, w.model AS best_model, "
    f"{r6_sql('best_score')} AS best_score, {r6_sql('sc.score / best_score')} AS ratio FROM sc JOIN b USING (metric) JOIN sc w ON w.metric = sc.metric AND w.score = best_score",
)
def leaderboard(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("metric")).agg(F.avg("value").alias("score"))
    both = rows.withColumn("split", F.explode(F.array(F.lit("validation"), F.lit("test"))))
    return rounded(runs.leaderboard(both), ("score", "best_score", "ratio"))


@query(
    "completed_runs",
    sql="SELECT user_id AS run_id, CASE WHEN user_id % 6 = 0 OR user_id % 7 = 0 THEN 'incomplete' WHEN user_id % 5 = 0 OR user_id % 4 <> 0 THEN 'complete' ELSE 'different configuration' END AS status FROM (SELECT DISTINCT user_id FROM events)",
)
def completed_runs(spark, sf):
    u = F.col("run_id")
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("epochs_completed"), F.min("value").alias("best_loss"))
    summaries = rows.select(
        "run_id", F.when(u % 6 != 0, F.col("epochs_completed")).alias("epochs_completed"), "best_loss", (u % 7 != 0).alias("has_checkpoint"),
        F.when(u % 5 != 0, F.when(u % 4 == 0, F.lit("b")).otherwise(F.lit("a"))).alias("config_signature"),
    )
    return runs.completed_runs(summaries, rows.select("run_id", F.lit("a").alias("config_signature")))


@query(
    "loss_curves",
    sql=f"WITH {LOG}, w AS (SELECT run_id, epoch, loss AS train_loss, CASE WHEN run_id % 2 = 0 THEN loss * 2 WHEN epoch > 1 THEN loss * 2 END AS validation_loss FROM log), "
    "l AS (SELECT run_id, epoch, 'train_loss' AS field, train_loss AS value FROM w UNION ALL SELECT run_id, epoch, 'validation_loss', validation_loss FROM w WHERE run_id % 2 = 0) "
    "SELECT *, min(value) OVER (PARTITION BY run_id) AS low, max(value) OVER (PARTITION BY run_id) AS high FROM l",
)
def loss_curves(spark, sf):
    late = F.when((F.col("run_id") % 2 == 0) | (F.col("epoch") > 1), F.col("loss") * 2)
    rows = log(spark, sf).select("run_id", "epoch", F.col("loss").alias("train_loss"), late.alias("validation_loss"))
    return runs.loss_curves(rows, ("train_loss", "validation_loss"))


# --- losses ----------------------------------------------------------------------------------------

LOGITS = {"cleaning": (2, -4), "background": (-2, 4), "staff": (1, -3), "notation": (-1, 2), "text": (-3, 4)}
TASK = "(['clean', 'segment', 'multitask'])[CAST(page_id % 3 + 1 AS INT)]"
LOSS_ROWS = "lr AS (" + " UNION ALL ".join(
    f"SELECT page_id, {TASK} AS task, '{c}' AS channel, {a} + {b} * (v / 255.0) AS z, "
    + (f"1 - ({CLEAN_SQL}) / 255.0" if c == "cleaning" else f"({layer_sql(c, CLEAN_SQL)}) / 255.0")
    + " AS t FROM dense" for c, (a, b) in LOGITS.items()
) + """),
ls AS (SELECT page_id, task, channel, sum(t / (1 + exp(-z))) AS pt, sum(1 / (1 + exp(-z))) AS p, sum(t) AS t,
       sum(greatest(z, 0) - z * t + ln(1 + exp(-abs(z)))) AS bce, count(*) AS n FROM lr GROUP BY page_id, task, channel),
ld AS (SELECT *, 1 - (2 * pt + 1e-6) / (p + t + 1e-6) AS dice, CASE channel WHEN 'staff' THEN 2.0 WHEN 'text' THEN 0.5 ELSE 1.0 END AS w FROM ls)"""
WEIGHTS = {"background": 1.0, "staff": 2.0, "notation": 1.0, "text": 0.5}


def _linear(a, b):
    return lambda v: a + b * (v / 255.0)


def loss_rows(spark, sf):
    scan = layers(with_clean(dense(spark, sf)).select("page_id", "y", "values", "clean"), "clean")
    task = F.element_at(F.array(*[F.lit(t) for t in ("clean", "segment", "multitask")]), (F.col("page_id") % 3 + 1).cast("int"))
    cells = []
    for channel, (a, b) in LOGITS.items():
        target = F.transform("clean", lambda v: 1 - v / 255.0) if channel == "cleaning" else F.transform(channel, lambda v: v / 255.0)
        logit = F.transform("values", _linear(a, b))
        cells.append(F.struct(F.lit(channel).alias("channel"), logit.alias("logit"), target.alias("target")))
    return scan.select(F.col("page_id").alias("item"), task.alias("task"), F.inline(F.array(*cells)))


@query("soft_dice_loss", sql=f"WITH {DENSE}, {LOSS_ROWS} SELECT task, {r6_sql('sum(w * dice) / sum(w)')} AS dice_loss FROM ld WHERE channel <> 'cleaning' GROUP BY task")
def soft_dice_loss(spark, sf):
    sums = losses.loss_sums(loss_rows(spark, sf), ("item", "task", "channel")).where("channel <> 'cleaning'")
    return rounded(losses.soft_dice(sums, ("task",), WEIGHTS), ("dice_loss",))


@query("bce_loss", sql=f"WITH {DENSE}, {LOSS_ROWS} SELECT channel, {r6_sql('sum(bce) / sum(n)')} AS bce FROM ld GROUP BY channel")
def bce_loss(spark, sf):
    sums = losses.loss_sums(loss_rows(spark, sf), ("channel",))
    return sums.select("channel", r6(F.col("bce") / F.col("n")).alias("bce"))


@query(
    "task_losses",
    sql=f"WITH {DENSE}, {LOSS_ROWS}, g AS (SELECT task, sum(bce) FILTER (WHERE channel = 'cleaning') / sum(n) FILTER (WHERE channel = 'cleaning') + avg(dice) FILTER (WHERE channel = 'cleaning') AS c, "
    "sum(w * bce) FILTER (WHERE channel <> 'cleaning') / sum(n) FILTER (WHERE channel <> 'cleaning') + sum(w * dice) FILTER (WHERE channel <> 'cleaning') / sum(w) FILTER (WHERE channel <> 'cleaning') AS s FROM ld GROUP BY task) "
    f"SELECT task, CASE WHEN task <> 'segment' THEN {r6_sql('c')} END AS clean_loss, CASE WHEN task <> 'clean' THEN {r6_sql('s')} END AS segment_loss, "
    f"{r6_sql('CASE task WHEN ' + repr('clean') + ' THEN c WHEN ' + repr('segment') + ' THEN 2 * s ELSE c + 2 * s END')} AS total_loss FROM g",
)
def task_losses(spark, sf):
    sums = losses.loss_sums(loss_rows(spark, sf), ("item", "task", "channel"))
    return rounded(losses.task_losses(sums, (), class_weights=WEIGHTS, segment_task=2.0), ("clean_loss", "segment_loss", "total_loss"))


# --- crops -----------------------------------------------------------------------------------------

SIZE = 24


def members(spark, sf):
    """Sparse foreground on document pages; every fourth page has none."""
    ink = F.transform("values", lambda v: F.when((v < 60) & (F.col("page_id") % 4 != 0), F.lit(1)).otherwise(F.lit(0)))
    return textpage(spark, sf).withColumn("member", ink)


def draws(spark, sf):
    d = docs(spark, sf)
    return d.select(
        F.lit(3).alias("epoch"), (F.col("doc_id") * 5).alias("index"), F.col("doc_id").alias("page_id"),
        F.ceil(F.col("n_chars") / 64).cast("int").alias("height"), F.lit(64).alias("width"),
    )


def plan(spark, sf):
    return crops.crop_plan(draws(spark, sf), members(spark, sf), SIZE, 0.8, 0.16, SEED)


def _origin(axis: str, length: str) -> str:
    return f"CAST(floor({u_sql(S, chr(39) + '3' + chr(39), vsql('index'), repr(axis), vsql('attempt'))} * greatest({length} - {SIZE} + 1, 1)) AS INT)".replace("CAST(index", 'CAST("index"')


CROPS = f"""
draws AS (SELECT 3 AS epoch, doc_id * 5 AS "index", doc_id AS page_id, CAST(ceil(n_chars / 64.0) AS INT) AS height, 64 AS width FROM documents),
ink AS MATERIALIZED (SELECT page_id, y, x FROM textpage WHERE v < 60 AND page_id % 4 <> 0),
aware AS (
  SELECT d.*, {u_sql(S, "'3'", 'CAST("index" AS VARCHAR)', "'aware'")} < 0.8 AND page_id IN (SELECT page_id FROM ink) AS aware FROM draws d
),
attempts AS (SELECT *, unnest(CASE WHEN aware THEN range(0, 21) ELSE range(0, 2) END) AS attempt FROM aware),
tries AS MATERIALIZED (SELECT *, {_origin('top', 'height')} AS top, {_origin('left', 'width')} AS "left" FROM attempts),
rowcount AS MATERIALIZED (
  SELECT t.page_id, t."index", t.attempt, count(*) AS hits FROM tries t JOIN ink i ON i.page_id = t.page_id AND i.y >= t.top AND i.y < t.top + {SIZE}
   AND i.x >= t."left" AND i.x < t."left" + {SIZE} WHERE t.aware AND t.attempt > 0 GROUP BY t.page_id, t."index", t.attempt
),
judged AS (
  SELECT t.*, CASE WHEN aware THEN attempt > 0 AND coalesce(hits, 0) / {SIZE * SIZE}.0 >= 0.16 ELSE attempt = 1 END AS good
  FROM tries t LEFT JOIN rowcount r USING (page_id, "index", attempt)
),
plan AS (
  SELECT epoch, "index", page_id, aware, top, "left", attempt FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, "index" ORDER BY good DESC, attempt) AS rn FROM judged) WHERE rn = 1
)"""


@query("crop_plan", sql=f"WITH {TEXT}, {CROPS} SELECT * FROM plan")
def crop_plan(spark, sf):
    return plan(spark, sf)


@query(
    "integral_image",
    sql=f"WITH {TEXT}, a AS (SELECT page_id, y, x, sum(CAST(v < 60 AND page_id % 4 <> 0 AS INT)) OVER (PARTITION BY page_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS n FROM textpage), "
    "b AS (SELECT page_id, y, x, sum(n) OVER (PARTITION BY page_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS n FROM a) "
    "SELECT page_id, y, CAST(sum(n * (x + 1)) AS BIGINT) AS weighted, CAST(max(n) AS BIGINT) AS total FROM b GROUP BY page_id, y",
)
def integral_image(spark, sf):
    lines = raster.line_moments(crops.integral_rows(members(spark, sf)), "integral", ("page_id", "y"))
    return lines.groupBy("page_id", "y").agg(F.sum(F.col("moment") + F.col("mass")).alias("weighted"), F.max("most").alias("total"))


@query(
    "extracted_crops",
    sql=f"WITH {TEXT}, {CROPS}, cells AS (SELECT p.*, c.cy, d.cx FROM plan p, range({SIZE}) c(cy), range({SIZE}) d(cx)) "
    f"SELECT c.epoch, c.\"index\", c.page_id, CAST(sum(coalesce(t.v, 255)) AS BIGINT) AS mass, CAST(sum(coalesce(t.v, 255) * (c.cy * {SIZE} + c.cx)) AS BIGINT) AS weighted, count(*) AS cells "
    "FROM cells c LEFT JOIN textpage t ON t.page_id = c.page_id AND t.y = c.top + c.cy AND t.x = c.\"left\" + c.cx GROUP BY c.epoch, c.\"index\", c.page_id",
)
def extracted_crops(spark, sf):
    cut = crops.extract_crops(plan(spark, sf), textpage(spark, sf), SIZE, 255)
    lines = raster.line_moments(cut, "cells", ("epoch", "index", "page_id", "cy"))
    return lines.groupBy("epoch", "index", "page_id").agg(
        F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("cy") * SIZE + F.col("moment")).alias("weighted"), F.sum("n").alias("cells")
    )
