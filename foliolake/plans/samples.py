"""Sample plan: seeded order, round robin over candidates, config choice, seeds and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.constants import CLASSES
from foliolake.functions.canonical import stable_id
from foliolake.functions.paths import page_stem
from foliolake.functions.rand import keyed_digest, pick, seed63
from foliolake.operators.ranking import hash_rank


def seeded_order(candidates: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Candidates with their place in a seeded shuffle (``place`` from 0)."""
    text = [F.col(k).cast("string") for k in keys]
    return hash_rank(candidates, keyed_digest(seed, "shuffle", *text), keys, "place").withColumn(
        "place", F.col("place") - 1
    )


def round_robin(ordered: DataFrame, target: Column | int) -> DataFrame:
    """Deal ``target`` samples over the ordered candidates: sample i goes to place i mod count.

    Each candidate lists its own sample indices, so nothing is joined; the total is a scalar subquery.
    """
    total = ordered.agg(F.count(F.lit(1))).scalar()
    goal = target if isinstance(target, Column) else F.lit(target)
    sized = ordered.withColumn("_total", total).withColumn("_goal", goal.cast("bigint"))
    return (
        sized.where(F.col("place") < F.col("_goal"))
        .withColumn("sample_index", F.explode(F.sequence(F.col("place"), F.col("_goal") - 1, F.col("_total"))))
        .drop("_total", "_goal")
    )


def choose_config(index: Column, split: Column, configs: Sequence[str], challenge: str, seed: int) -> Column:
    """Seeded pick with replacement; challenge rows always take the challenge config."""
    drawn = pick(F.array(*[F.lit(c) for c in configs]), seed, "config", index.cast("string"))
    return F.when(split == "challenge", F.lit(challenge)).otherwise(drawn)


def sample_plan(
    candidates: DataFrame, target: Column | int, dataset_id: str, seed: int,
    configs: Sequence[str] = ("light", "medium", "heavy"), challenge: str = "random",
) -> DataFrame:
    """One row per planned sample from candidates ``(render_id, page, split, ...)``."""
    dealt = round_robin(seeded_order(candidates, ("render_id", "page"), seed), target)
    planned = dealt.withColumn(
        "preset", choose_config(F.col("sample_index"), F.col("split"), configs, challenge, seed)
    ).withColumn("seed", seed63(seed, "sample", F.col("sample_index").cast("string")))
    identity = {
        "dataset_id": F.lit(dataset_id), "degradation_config": F.col("preset"), "page": F.col("page"),
        "render_id": F.col("render_id"), "seed": F.col("seed"),
    }
    return planned.withColumn("sample_id", stable_id("sample", identity))


def sample_records(
    plan: DataFrame, assets: DataFrame, hashes: DataFrame, dataset_id: str, generator_version: str
) -> DataFrame:
    """Manifest records: plan, source rights and artifact hashes joined on their ids."""
    own = hashes.select("sample_id", "input", "clean", "recipe", *[f"mask_{c}" for c in CLASSES])
    rights = assets.select("source_id", "source_path", "source_sha256", "source_license_status", "source_url")
    stem = page_stem(F.col("render_id"), F.col("page"))
    mask_paths = F.map_from_arrays(
        F.array(*[F.lit(c) for c in CLASSES]),
        F.array(*[F.concat(F.lit(f"masks/{c}/"), stem, F.lit(".png")) for c in CLASSES]),
    )
    roles = ("input", "clean", "recipe", *[f"mask_{c}" for c in CLASSES])
    return (
        plan.join(rights, "source_id", "left").join(own, "sample_id", "left")
        .select(
            F.lit(1).alias("schema_version"), "sample_id", F.lit(dataset_id).alias("dataset_id"), "source_id",
            "source_path", "source_sha256", "source_license_status",
            F.struct("source_url").alias("source_provenance"), "page", "split",
            F.lit(generator_version).alias("generator_version"), "seed", "render_id",
            F.col("preset").alias("degradation_preset"),
            F.concat(F.lit("input/"), "sample_id", F.lit(".png")).alias("input_path"),
            F.concat(F.lit("clean/"), stem, F.lit(".png")).alias("clean_target_path"),
            mask_paths.alias("mask_paths"),
            F.concat(F.lit("manifests/recipes/"), "sample_id", F.lit(".json")).alias("recipe_path"),
            F.map_from_arrays(F.array(*[F.lit(r) for r in roles]), F.array(*roles)).alias("hashes"),
        )
    )


def full_sample_records(
    plan: DataFrame, assets: DataFrame, hashes: DataFrame, renders: DataFrame, dataset_id: str,
    generator_version: str, lilypond_version: str, created_at: str,
) -> DataFrame:
    """Records with every required field, ready for ``sinks.write_manifest``.

    Beside what ``sample_records`` needs, ``plan`` has ``degradations``, ``assets`` the two rights structs and
    ``verified_date``, and ``renders`` gives ``render_id, page, width, height, dpi, render_parameters``.
    """
    rows = sample_records(plan, assets, hashes, dataset_id, generator_version).drop("source_provenance")
    provenance = F.struct("source_url", "composition_rights", "source_file_rights", "verified_date")
    facts = renders.select("render_id", "page", F.struct("width", "height").alias("dimensions"), "dpi", "render_parameters")
    return (
        rows.join(plan.select("sample_id", "degradations"), "sample_id", "left")
        .join(facts, ["render_id", "page"], "left")
        .join(assets.select("source_id", provenance.alias("source_provenance")), "source_id", "left")
        .withColumns({"lilypond_version": F.lit(lilypond_version), "created_at": F.lit(created_at)})
    )


def id_collisions(plan: DataFrame) -> DataFrame:
    """Stable ids that were produced more than once."""
    return plan.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Hex digits of a digest that make a bucket of the seeded sample; 65,536 counts are broadcast at most.
BUCKET_DIGITS = 4


def seeded_sample(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` distinct ids without replacement, whatever the order or repetition of the input.

    The ids with the smallest digests are taken. Counts per digest prefix tell which buckets are taken whole and
    which one is cut; only that one is ranked, so neither all ids nor the sample are ever sorted or gathered. A null
    is an id like others.
    """
    digest = keyed_digest(seed, F.col(key).cast("string"))
    ids = rows.select(key).distinct().withColumn("_digest", digest)
    ids = ids.withColumn("_bucket", F.conv(F.substring("_digest", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = ids.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    ).where(F.col("_before") < count)
    placed = ids.join(F.broadcast(buckets), "_bucket")
    whole = placed.where(F.col("_before") + F.col("_n") <= count)
    cut = placed.where(F.col("_before") + F.col("_n") > count)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    cut = cut.withColumn("_rank", F.col("_before") + rank).where(F.col("_rank") <= count)
    return whole.select(key).unionByName(cut.select(key))


def epoch_draws(
    records: DataFrame, draws: DataFrame, key: str, seed: int, salt_key: str = "epoch", index_key: str = "index"
) -> DataFrame:
    """One record per (epoch, index) draw, picked uniformly with replacement.

    Records are ranked once; a draw is an equality join on the drawn rank.
    """
    from foliolake.functions.rand import unit_uniform

    ranked = hash_rank(records, keyed_digest(seed, "records", F.col(key).cast("string")), [key], "rank")
    total = records.agg(F.count(F.lit(1))).scalar()
    u = unit_uniform(seed, F.col(salt_key).cast("string"), F.col(index_key).cast("string"), "record")
    drawn = draws.withColumn("_total", total).withColumn("rank", (F.floor(u * F.col("_total")) + 1).cast("bigint")).drop("_total")
    return drawn.join(ranked, "rank")
