"""Augmentation plans: preset resolution and the ordered operations of each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.constants import CUSTOM_BASE_PRESET, FAMILIES, INTEGER_FIELDS, LIMITS, MICRO, PRESETS
from foliolake.functions.rand import int_between, keyed_digest, pick, seed63

FIELDS = {family: tuple(PRESETS[CUSTOM_BASE_PRESET][family]) for family in FAMILIES}
RANGE_SCHEMA = "preset string, family string, field string, low bigint, high bigint, enabled boolean"


def _units(field: str, value: float) -> int:
    return int(value) if field in INTEGER_FIELDS else round(value * MICRO)


def preset_rows() -> list[tuple]:
    """All preset ranges as rows: integer fields in units, the others in micro-units."""
    rows = []
    for preset in (*PRESETS, "custom"):
        table = PRESETS[CUSTOM_BASE_PRESET if preset == "custom" else preset]
        enabled = preset != "custom"
        low, high = (1, 1) if preset == "custom" else table["operation_count"]
        rows.append((preset, "", "operation_count", low, high, True))
        for family in FAMILIES:
            for field, (lo, hi) in table[family].items():
                rows.append((preset, family, field, _units(field, lo), _units(field, hi), enabled))
    return rows


def preset_table(spark: SparkSession) -> DataFrame:
    """The preset dimension (fixed size)."""
    return spark.createDataFrame(preset_rows(), RANGE_SCHEMA)


KNOWN_PRESETS = (*PRESETS, "custom")


def _preset_problem() -> Column:
    unknown = F.col("preset").isNull() | ~F.col("preset").isin(*KNOWN_PRESETS)
    return F.when(unknown, F.concat(F.lit("unknown preset "), F.coalesce("preset", F.lit("null"))))


def _override_problem() -> Column:
    """Why an override may not stand: an unknown family or field, or a range not ordered inside its limits."""
    name = F.when(F.col("family") == "", F.col("field")).otherwise(F.concat_ws(".", "family", "field"))
    top = 2**62
    limits = [("operation_count", 1, top)] + [
        (f"{family}.{field}", _units(field, low), _units(field, high))
        for family, fields in LIMITS.items() for field, (low, high) in fields.items()
    ]
    table = F.create_map(*[x for key, low, high in limits for x in (F.lit(key), F.array(F.lit(low).cast("bigint"), F.lit(high).cast("bigint")))])
    span = table[name]
    wrong = F.coalesce(F.col("low") < span[0], F.lit(False)) | F.coalesce(F.col("high") > span[1], F.lit(False)) | F.coalesce(
        F.col("low") > F.col("high"), F.lit(False)
    )
    return F.when(span.isNull(), F.concat(F.lit("unknown field "), F.coalesce(name, F.lit("null")))).when(
        wrong, F.concat(name, F.lit(" must be ordered within its limits"))
    )


def refused_configs(plan: DataFrame, overrides: DataFrame) -> DataFrame:
    """(config_id, problem) of plan rows with an unknown preset and of overrides that no config may have.

    An override is refused for an unknown family or field, and for a range that is not ordered inside the
    field's limits. ``resolve_presets`` raises on all of these, so drop the configs listed here first.
    """
    unknown = plan.select("config_id", _preset_problem().alias("problem"))
    return unknown.unionByName(overrides.select("config_id", _override_problem().alias("problem"))).where("problem IS NOT NULL")


def _raising(problem: Column, value: str) -> Column:
    return F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col(value))


def resolve_presets(plan: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Ranges of each plan row's preset, with per-field overrides of its ``config_id`` laid over them.

    ``overrides`` has ``config_id, family, field, low, high, enabled``; NULLs keep the preset's value. An unknown
    preset, and an override that ``refused_configs`` lists, raises when the ranges are read: nothing vanishes.
    """
    named = plan.withColumn("preset", _raising(_preset_problem(), "preset"))
    base = named.join(F.broadcast(preset_table(plan.sparkSession)), "preset", "left")
    if overrides is None:
        return base
    laid = overrides.select(
        "config_id", _raising(_override_problem(), "family").alias("family"), "field",
        F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("enabled").alias("_enabled"),
    )
    joined = base.join(laid, ["config_id", "family", "field"], "left")
    for name in ("low", "high", "enabled"):
        joined = joined.withColumn(name, F.coalesce(F.col(f"_{name}"), F.col(name))).drop(f"_{name}")
    return joined


def configs_without_family(resolved: DataFrame) -> DataFrame:
    """Configs that end up with every family switched off, which is an error."""
    on = F.max(F.when(F.col("family") != "", F.col("enabled")))
    return resolved.groupBy("config_id").agg(on.alias("on")).where(~F.col("on")).select("config_id")


def config_column(resolved: DataFrame) -> DataFrame:
    """One row per config: ``operation_count`` range, enabled families in canonical order, all ranges.

    A config has at most ten ranges, so its group is bounded.
    """
    key = F.concat_ws(".", F.nullif("family", F.lit("")), "field")
    families = F.collect_set(F.when(F.col("enabled") & (F.col("family") != ""), F.col("family")))
    canonical = F.array(*[F.lit(f) for f in FAMILIES])
    return resolved.groupBy("config_id").agg(
        families.alias("_families"),
        F.map_from_entries(F.collect_list(F.struct(key, F.array("low", "high")))).alias("ranges"),
    ).select(
        "config_id", "ranges",
        F.filter(canonical, lambda f: F.array_contains(F.col("_families"), f)).alias("families"),
    )


def preset_config(preset: Column) -> tuple[Column, Column]:
    """(families, ranges) of a built-in preset as literal maps, so no join is needed."""
    built = {}
    for name, family, field, low, high, _ in preset_rows():
        key = f"{family}.{field}" if family else field
        built.setdefault(name, []).extend([F.lit(key), F.array(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))])
    ranges = None
    for name in PRESETS:
        literal = F.create_map(*built[name])
        ranges = F.when(preset == name, literal) if ranges is None else ranges.when(preset == name, literal)
    return F.array(*[F.lit(f) for f in FAMILIES]), ranges


def chosen_families(families: Column, count: Column, seed: Column) -> Column:
    """``count`` families in application order.

    Up to the number of enabled families they are drawn without replacement, in draw order. Beyond
    that, all of them plus draws with replacement, shuffled. All of it happens inside the row.
    """
    text, enabled = seed.cast("string"), F.size(families)
    ranked = F.array_sort(F.transform(families, lambda f: F.struct(keyed_digest(text, "family", f).alias("h"), f.alias("f"))))
    distinct = F.transform(F.slice(ranked, 1, F.least(count, enabled).cast("int")), lambda r: r["f"])
    extra = F.transform(
        F.sequence(F.lit(1).cast("bigint"), count - enabled), lambda i: pick(families, text, "extra", i.cast("string"))
    )
    order = lambda f, i: F.struct(keyed_digest(text, "order", i.cast("string")).alias("h"), i.alias("i"), f.alias("f"))
    shuffled = F.transform(F.array_sort(F.transform(F.concat(distinct, extra), order)), lambda r: r["f"])
    return F.when(count <= enabled, distinct).otherwise(shuffled)


def _parameters(family: Column, op_seed: Column, ranges: Column) -> Column:
    drawn = None
    for name, fields in FIELDS.items():
        entries = []
        for field in fields:
            span = ranges[f"{name}.{field}"]
            unit = 1.0 if field in INTEGER_FIELDS else float(MICRO)
            value = int_between(span[0], span[1], op_seed.cast("string"), field) / F.lit(unit)
            entries += [F.lit(field), value]
        literal = F.create_map(*entries)
        drawn = F.when(family == name, literal) if drawn is None else drawn.when(family == name, literal)
    return drawn


def augmentation_plan(samples: DataFrame, families: Column, ranges: Column) -> DataFrame:
    """Adds ``degradations array<struct<order,family,seed,parameters>>`` drawn from each row's ``seed``."""
    seed = F.col("seed")
    span = ranges["operation_count"]
    counted = samples.withColumn("_ranges", ranges).withColumn(
        "_count", int_between(span[0], span[1], seed.cast("string"), "count")
    )
    chosen = counted.withColumn("_chosen", chosen_families(families, F.col("_count"), seed))
    operations = F.transform(
        "_chosen",
        lambda f, i: F.struct(
            (i + 1).alias("order"), f.alias("family"),
            seed63(seed.cast("string"), "operation", (i + 1).cast("string")).alias("seed"),
        ),
    )
    with_parameters = F.transform(
        "_operations",
        lambda o: F.struct(
            o["order"].alias("order"), o["family"].alias("family"), o["seed"].alias("seed"),
            _parameters(o["family"], o["seed"], F.col("_ranges")).alias("parameters"),
        ),
    )
    return (
        chosen.withColumn("_operations", operations)
        .withColumn("degradations", with_parameters)
        .drop("_ranges", "_count", "_chosen", "_operations")
    )
