"""Lookups between assets, samples, manifests, registries, checkpoints and planned outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.constants import BUILTIN_INCLUDES, CLASSES, COMPARABLE_IGNORES, INCLUDE_PATTERN
from foliolake.functions.paths import is_confined, page_dir, stem
from foliolake.operators.ranking import hash_rank, sorted_rank
from foliolake.operators.skew import dealt_join
from foliolake.session import checkpointed


def select_sources(spark: SparkSession, assets: DataFrame, ids: Sequence[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(assets in list order, ids that do not exist). Spark broadcasts the list if it is small."""
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(ids)], f"pos int, {key} string")
    found = assets.join(asked, key).orderBy("pos")
    missing = asked.join(assets.select(key).distinct(), key, "left_anti")
    return found, missing


def source_hash_problems(samples: DataFrame, assets: DataFrame) -> DataFrame:
    """Samples whose source is unknown or has another hash. A source of many samples is dealt over tasks."""
    own = assets.select("source_id", F.col("source_sha256").alias("asset_sha256"))
    joined = dealt_join(samples, own, ["source_id"], "left")
    problem = F.when(F.col("asset_sha256").isNull(), F.lit("source is absent")).when(
        F.col("asset_sha256") != F.col("source_sha256"), F.lit("source SHA-256 differs")
    )
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("sample_id", "source_id", "problem")


def locate_samples(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where each wanted sample id occurs over many manifests; anything but one place is an error.

    Records are counted before the join, so an id that fills many manifests meets it as one row.
    """
    hits = records.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("matches"), F.min("file").alias("file")
    )
    status = F.when(F.col("matches").isNull(), F.lit("not found")).when(F.col("matches") > 1, F.lit("occurs in multiple datasets")).otherwise(F.lit("ok"))
    return wanted.join(hits, "sample_id", "left").select(
        "sample_id", F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"),
        F.when(F.col("matches") == 1, F.col("file")).alias("file"), status.alias("status"),
    )


def invalid_existing_ids(records: DataFrame) -> DataFrame:
    """Stored records that cannot be resumed: empty ids, and ids that occur more than once."""
    bad = F.coalesce(F.length("sample_id") == 0, F.lit(True))
    counted = records.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(bad, F.lit("invalid sample_id")).when(F.col("n") > 1, F.lit("repeated sample_id"))
    return counted.withColumn("problem", problem).where("problem IS NOT NULL")


# --- registry --------------------------------------------------------------------------------------


def classify_names(names: DataFrame, registry: DataFrame, default: str = "notation") -> DataFrame:
    """Semantic class of each name; names outside the registry take the default and are flagged.

    The registry is a lookup table of names. Where it is too large to be broadcast, a name that fills the table
    is dealt over tasks.
    """
    known = registry.select("name", F.col("class").alias("_class"))
    return dealt_join(names, known, ["name"], "left").withColumns(
        {"class": F.coalesce("_class", F.lit(default)), "known": F.col("_class").isNotNull()}
    ).drop("_class")


def unknown_names(classified: DataFrame, by: Sequence[str]) -> DataFrame:
    """Strict mode: every unregistered name of every group, one row each; no row means the group passes."""
    return classified.where(~F.col("known")).select(*by, "name").distinct()


# --- include closure -------------------------------------------------------------------------------


def include_edges(files: DataFrame, pattern: str = INCLUDE_PATTERN, builtin: Sequence[str] = BUILTIN_INCLUDES) -> DataFrame:
    """``path -> target`` edges from file text; built-in names are dropped and unsafe targets flagged."""
    raw = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("include"))
    parent = F.regexp_extract("path", r"^(.*/)", 1)
    return raw.where(~F.col("include").isin(*builtin)).select(
        "path", "include", F.concat(parent, "include").alias("target"), (~is_confined(F.col("include"))).alias("unsafe")
    )


def include_closure(roots: DataFrame, edges: DataFrame, checkpoint_every: int = 3) -> DataFrame:
    """Every file reachable from each root: ``root, path``. Rounds go on until nothing is new.

    A round joins only the newest pairs with the edges; a file that many roots reach is dealt over tasks.
    Lineage is cut by reliable checkpoints; the number of rounds is the depth of the include tree, not its
    size. The result has every pair of a root and a file it needs, which is what the closure is.
    """
    # Kept once: reading the edges again each round would scan the text they come from.
    links = checkpointed(edges.where(~F.col("unsafe")).select("path", "target").distinct())
    seen = roots.select(F.col("path").alias("root"), "path").distinct()
    newest, depth = seen, 0
    while True:
        reached = dealt_join(newest, links, ["path"]).select("root", F.col("target").alias("path")).distinct()
        newest = checkpointed(reached.join(seen, ["root", "path"], "left_anti"))
        if newest.isEmpty():
            return seen
        depth += 1
        seen = seen.unionByName(newest)
        if depth % checkpoint_every == 0:
            seen = checkpointed(seen)


# --- models and checkpoints ------------------------------------------------------------------------


def eligible_checkpoints(checkpoints: DataFrame, tasks: Sequence[str] = ("clean", "multitask")) -> DataFrame:
    """Checkpoints with a finite numeric loss that were trained for cleaning."""
    loss = F.col("validation_loss")
    finite = loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    return with_checkpoint_defaults(checkpoints).where(finite & F.col("task").isin(*tasks))


CHECKPOINT_DEFAULTS = {"backend": "unet", "pretrained": False, "freeze_batch_norm": True}


def with_checkpoint_defaults(checkpoints: DataFrame, defaults: Mapping[str, object] = CHECKPOINT_DEFAULTS) -> DataFrame:
    """Missing model settings filled in."""
    return checkpoints.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def checkpoint_problems(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints that cannot be loaded: the width of the network has no default."""
    return checkpoints.where("base_channels IS NULL").select("path", F.lit("checkpoint lacks base_channels").alias("problem"))


def best_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Lowest loss per backend, ties by path. A mergeable minimum, so no backend is gathered anywhere."""
    best = F.min(F.struct("validation_loss", "path"))
    return eligible_checkpoints(checkpoints).groupBy("backend").agg(best.alias("b")).select(
        "backend", F.col("b.path").alias("path"), F.col("b.validation_loss").alias("validation_loss")
    )


def selected_checkpoints(models: DataFrame, checkpoints: DataFrame, overrides: DataFrame) -> DataFrame:
    """Explicit checkpoint, else the best of the model's backend: ``model, path, selection``."""
    best = best_checkpoints(checkpoints).select("backend", F.col("path").alias("_auto"))
    joined = models.join(overrides.select("model", F.col("path").alias("_explicit")), "model", "left").join(best, "backend", "left")
    selection = F.when(F.col("_explicit").isNotNull(), F.lit("explicit_override")).when(
        F.col("_auto").isNotNull(), F.lit("automatic_lowest_validation_loss")
    )
    return joined.select("model", "backend", F.coalesce("_explicit", "_auto").alias("path"), selection.alias("selection"))


def unknown_overrides(models: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(models, "model", "left_anti").select("model")


def comparable_config(config: Column) -> Column:
    """A model's training config without the settings a controlled comparison may vary."""
    return F.array_sort(F.map_entries(F.map_filter(config, lambda k, _: ~k.isin(*COMPARABLE_IGNORES))))


def model_pairs(models: DataFrame) -> DataFrame:
    """Every unordered pair of models, which is what the comparison report lists.

    Names are ranked and each model emits the ranks after its own, so the pairs come from an equality
    join spread over the cluster instead of a nested loop or one task holding all models.
    """
    ranked = hash_rank(models, F.sha2("name", 256), ["name"], "rank")
    total = models.agg(F.count(F.lit(1))).scalar()
    left = ranked.withColumn("_total", total).where(F.col("rank") < F.col("_total")).withColumn(
        "other", F.explode(F.sequence(F.col("rank") + 1, F.col("_total")))
    )
    right = ranked.select(F.col("rank").alias("other"), F.struct(*models.columns).alias("b"))
    pairs = left.select("other", F.struct(*models.columns).alias("a")).join(right, "other").drop("other")
    ordered = F.col("a.name") < F.col("b.name")
    return pairs.select(
        F.when(ordered, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ordered, F.col("b")).otherwise(F.col("a")).alias("b")
    )


def controlled_comparisons(models: DataFrame) -> DataFrame:
    """Comparison type and whether it is controlled, for models ``name, task, backend, config map``."""
    pairs = model_pairs(models)
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    both = lambda f, x, y: ((a(f) == x) & (b(f) == y)) | ((a(f) == y) & (b(f) == x))
    kind = (
        F.when(both("task", "clean", "multitask") & (a("backend") == "unet") & (b("backend") == "unet"), F.lit("cleaning_only_vs_multitask_custom_unet"))
        .when(both("backend", "unet", "resnet18"), F.lit("custom_unet_vs_resnet18_transfer"))
        .otherwise(F.lit("unqualified"))
    )
    filled = (F.size(a("config")) > 0) & (F.size(b("config")) > 0)
    controlled = F.coalesce(filled & (comparable_config(a("config")) == comparable_config(b("config"))), F.lit(False))
    return pairs.select(
        F.concat(a("name"), F.lit("_vs_"), b("name")).alias("comparison"), a("name").alias("left_model"), b("name").alias("right_model"),
        F.coalesce(kind, F.lit("unqualified")).alias("comparison_type"), controlled.alias("controlled"),
    )


# --- names and planned outputs ---------------------------------------------------------------------


def source_keys(sources: DataFrame, path: str = "path") -> DataFrame:
    """A distinct key per source: its stem, plus its rank among all sorted sources when stems collide."""
    ranked = sorted_rank(sources.withColumn("stem", stem(F.col(path))), [path], "position")
    crowded = ranked.groupBy("stem").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("stem", F.lit(True).alias("_shared"))
    keyed = dealt_join(ranked, crowded, ["stem"], "left", deal=F.col("position"))
    key = F.when(F.coalesce("_shared", F.lit(False)), F.concat("stem", F.lit("-"), F.col("position").cast("string"))).otherwise(F.col("stem"))
    return keyed.select(path, key.alias("key"))


def planned_outputs(pages: DataFrame, overlay: bool) -> DataFrame:
    """The exact files a run will write for ``root, page_number``, without touching storage."""
    names = ["metadata.json", "cleaned.png", "probabilities/cleaning.png"]
    names += [f"probabilities/{c}.png" for c in CLASSES] + [f"masks/{c}.png" for c in CLASSES]
    names += ["overlay.png"] if overlay else []
    files = pages.select("root", F.concat("root", F.lit("/"), page_dir(F.col("page_number")), F.lit("/")).alias("_dir"), F.explode(F.array(*[F.lit(n) for n in names])).alias("_name"))
    shared = pages.select("root").distinct().select("root", F.concat("root", F.lit("/metadata.json")).alias("path"))
    return files.select("root", F.concat("_dir", "_name").alias("path")).unionByName(shared)


def overwrite_set(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned outputs that already exist."""
    return planned.join(existing.select("path"), "path", "left_semi")
