"""Seeded draws, splits, layouts, sample and augmentation plans, resume checks, curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.rasters import SEED, WEIGHTS, h64_sql, r6_sql, split_sql, u_sql
from foliolake.catalog.registry import query, table
from foliolake.constants import FAMILIES, SPLITS
from foliolake.functions import rand
from foliolake.functions.score import r6
from foliolake.plans import augment, curation, layout, resume, samples, splits

S = f"'{SEED}'"


def docs(spark, sf):
    return table(spark, sf, "documents")


def key(name: str):
    return F.col(name).cast("string")


def vsql(name: str) -> str:
    return f"CAST({name} AS VARCHAR)"


@query(
    "hashed_uniforms",
    sql=f"SELECT doc_id, {u_sql(S, chr(39) + 'u' + chr(39), vsql('doc_id'))} AS u FROM documents",
)
def hashed_uniforms(spark, sf):
    return docs(spark, sf).select("doc_id", rand.unit_uniform(SEED, "u", key("doc_id")).alias("u"))


def seed63_sql(*parts: str) -> str:
    return f"CAST({h64_sql(*parts)} // 2 AS BIGINT)"


@query(
    "hashed_seeds",
    sql=f"SELECT doc_id, {seed63_sql(S, vsql('doc_id'))} AS seed, {seed63_sql(S, chr(39) + '3' + chr(39), vsql('doc_id'))} AS epoch_seed, "
    f"CAST({h64_sql(S, vsql('doc_id'))} AS VARCHAR) AS u64 FROM documents",
)
def hashed_seeds(spark, sf):
    return docs(spark, sf).select(
        "doc_id", rand.seed63(SEED, key("doc_id")).alias("seed"),
        rand.sample_seed(SEED, 3, key("doc_id")).alias("epoch_seed"),
        rand.hash_u64(SEED, key("doc_id")).cast("string").alias("u64"),
    )


def int_sql(low: str, high: str, *parts: str) -> str:
    return f"CAST(({low}) + floor({u_sql(*parts)} * (({high}) - ({low}) + 1)) AS BIGINT)"


@query(
    "hashed_ranges",
    sql=f"SELECT doc_id, {int_sql('3', '17', S, chr(39) + 'i' + chr(39), vsql('doc_id'))} AS i, "
    f"{int_sql('300000', '2400000', S, chr(39) + 'f' + chr(39), vsql('doc_id'))} / 1000000.0 AS f FROM documents",
)
def hashed_ranges(spark, sf):
    return docs(spark, sf).select(
        "doc_id", rand.int_between(3, 17, SEED, "i", key("doc_id")).alias("i"),
        rand.float_between(0.3, 2.4, SEED, "f", key("doc_id")).alias("f"),
    )


@query("split_by_source", sql=f"SELECT source AS source_id, count(*) AS n, {split_sql('source')} AS split FROM documents GROUP BY source")
def split_by_source(spark, sf):
    rows = docs(spark, sf).groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("split", splits.split_of(F.col("source_id"), WEIGHTS, SEED))


@query("split_by_document", sql=f"SELECT doc_id, {split_sql(vsql('doc_id'))} AS split FROM documents")
def split_by_document(spark, sf):
    return docs(spark, sf).select("doc_id", splits.split_of(key("doc_id"), WEIGHTS, SEED).alias("split"))


@query(
    "selected_splits",
    sql=f"WITH t AS (SELECT doc_id, {split_sql(vsql('doc_id'))} AS split FROM documents) "
    "SELECT doc_id, split, CASE split WHEN 'validation' THEN 2 ELSE 4 END AS split_order FROM t WHERE split IN ('challenge', 'validation')",
)
def selected_splits(spark, sf):
    rows = docs(spark, sf).select("doc_id", splits.split_of(key("doc_id"), WEIGHTS, SEED).alias("split"))
    return splits.filter_splits(rows, ("challenge", "validation"))


@query(
    "split_leaks",
    sql=f"WITH t AS (SELECT source AS source_id, CASE WHEN doc_id % 50 = 0 THEN {split_sql(vsql('doc_id'))} ELSE {split_sql('source')} END AS split FROM documents) "
    "SELECT source_id, min(split) AS first_split, max(split) AS last_split FROM t GROUP BY source_id HAVING min(split) <> max(split)",
)
def split_leaks(spark, sf):
    own = splits.split_of(F.col("source"), WEIGHTS, SEED)
    moved = splits.split_of(key("doc_id"), WEIGHTS, SEED)
    rows = docs(spark, sf).select(F.col("source").alias("source_id"), F.when(F.col("doc_id") % 50 == 0, moved).otherwise(own).alias("split"))
    return splits.split_leaks(rows)


# --- layouts ---------------------------------------------------------------------------------------

_side = lambda s: (
    f"{int_sql('8000', '16000', 'CAST(layout_seed AS VARCHAR)', repr(s))} / 1000.0 AS {s}_margin"
)
LAYOUT = f"""
layouts AS (
  SELECT source_id, staff_size, paper_format, orientation, variant_index,
         {h64_sql(S, 'source_id', 'staff_size', 'paper_format', 'orientation', 'CAST(variant_index AS VARCHAR)')} AS layout_seed
  FROM (SELECT DISTINCT source AS source_id FROM documents),
       (VALUES ('12.0'), ('16.0'), ('20.0'), ('24.0')) a(staff_size), (VALUES ('a4'), ('letter')) b(paper_format),
       (VALUES ('portrait'), ('landscape')) c(orientation), (VALUES (0), (1)) d(variant_index)
)"""


@query(
    "layout_grid",
    sql=f"WITH {LAYOUT} SELECT source_id, CAST(staff_size AS DOUBLE) AS staff_size, paper_format, orientation, variant_index, "
    f"CAST(layout_seed AS VARCHAR) AS layout_seed, {', '.join(_side(s) for s in ('top', 'bottom', 'left', 'right'))} FROM layouts",
)
def layout_grid(spark, sf):
    sources = docs(spark, sf).select(F.col("source").alias("source_id")).distinct()
    rows = layout.layout_grid(sources, layout.LayoutGrid(variants_per_combination=2), SEED)
    return rows.select(
        "source_id", "staff_size", "paper_format", "orientation", "variant_index", F.col("layout_seed").cast("string").alias("layout_seed"),
        *[F.col(f"margins_mm.{s}").alias(f"{s}_margin") for s in ("top", "bottom", "left", "right")],
    )


@query(
    "stable_ids",
    sql="SELECT doc_id, 'render-' || substr(sha256('{\"n_chars\":' || n_chars || ',\"note\":null,\"source\":\"' || source || '\"}'), 1, 24) AS render_id FROM documents",
)
def stable_ids(spark, sf):
    from foliolake.functions.canonical import stable_id

    fields = {"source": F.col("source"), "n_chars": F.col("n_chars"), "note": F.lit(None).cast("string")}
    return docs(spark, sf).select("doc_id", stable_id("render", fields).alias("render_id"))


@query("canonical_json", sql="SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user\":{\"a\":' || user_id || ',\"z\":' || event_id || '}}' AS text FROM events")
def canonical_json(spark, sf):
    from foliolake.functions.canonical import canonical_json as to_text

    fields = {"user": F.struct(F.col("user_id").alias("a"), F.col("event_id").alias("z")), "event_type": F.col("event_type")}
    return table(spark, sf, "events").select("event_id", to_text(fields).alias("text"))


# --- samples ---------------------------------------------------------------------------------------


def candidates(spark, sf):
    """Pages as rendered candidates."""
    page = table(spark, sf, "pages")
    source = F.concat(F.lit("host-"), (F.col("page_id") % 40).cast("string"))
    return page.select(
        F.concat(F.lit("render-"), key("page_id")).alias("render_id"),
        (F.col("page_id") % 7 + 1).cast("int").alias("page"), source.alias("source_id"),
        splits.split_of(source, WEIGHTS, SEED).alias("split"),
    )


CANDIDATES = f"""
candidates AS (
  SELECT 'render-' || page_id AS render_id, CAST(page_id % 7 + 1 AS INT) AS page, 'host-' || (page_id % 40) AS source_id,
         {split_sql("'host-' || (page_id % 40)")} AS split FROM pages
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(':', {S}, 'shuffle', render_id, CAST(page AS VARCHAR))), render_id, page) - 1 AS place,
         count(*) OVER () AS total FROM candidates
)"""
PLAN = f"""
{CANDIDATES},
dealt AS (SELECT *, unnest(range(place, 3 * total + 5, total)) AS sample_index FROM placed),
drawn AS (
  SELECT *, CASE WHEN split = 'challenge' THEN 'random' ELSE
      (['light', 'medium', 'heavy'])[CAST(floor({u_sql(S, "'config'", 'CAST(sample_index AS VARCHAR)')} * 3) + 1 AS INT)] END AS preset,
    {seed63_sql(S, "'sample'", 'CAST(sample_index AS VARCHAR)')} AS seed FROM dealt
),
plan AS (
  SELECT *, 'sample-' || substr(sha256('{{"dataset_id":"demo","degradation_config":"' || preset || '","page":' || page || ',"render_id":"' || render_id
    || '","seed":' || seed || '}}'), 1, 24) AS sample_id FROM drawn
)"""


@query("seeded_shuffle", sql=f"WITH {CANDIDATES} SELECT render_id, page, place FROM placed")
def seeded_shuffle(spark, sf):
    return samples.seeded_order(candidates(spark, sf), ("render_id", "page"), SEED).select("render_id", "page", "place")


def plan(spark, sf):
    rows = candidates(spark, sf)
    goal = rows.agg(3 * F.count(F.lit(1)) + 5).scalar()
    return samples.sample_plan(rows, goal, "demo", SEED)


@query("sample_plan", sql=f"WITH {PLAN} SELECT render_id, page, source_id, split, place, sample_index, preset, seed, sample_id FROM plan")
def sample_plan(spark, sf):
    return plan(spark, sf)


@query("sample_id_collisions", sql=f"WITH {PLAN}, d AS (SELECT sample_id FROM plan UNION ALL SELECT sample_id FROM plan WHERE sample_index % 10 = 3) SELECT sample_id, count(*) AS n FROM d GROUP BY sample_id HAVING count(*) > 1")
def sample_id_collisions(spark, sf):
    rows = plan(spark, sf).select("sample_id", "sample_index")
    return samples.id_collisions(rows.unionByName(rows.where("sample_index % 10 = 3")))


@query(
    "sample_records",
    sql=f"WITH {PLAN}, m AS (SELECT *, sha256(source_id) AS source_sha256, 'https://example.org/' || source_id AS url, "
    "render_id || printf('-p%03d', page) AS stem FROM plan) "
    "SELECT sample_id, 'demo' AS dataset_id, source_id, source_id || '.ly' AS source_path, source_sha256, 'public_domain' AS source_license_status, url AS source_url, page, split, "
    "seed, render_id, preset AS degradation_preset, 'input/' || sample_id || '.png' AS input_path, 'clean/' || stem || '.png' AS clean_target_path, "
    "'masks/staff/' || stem || '.png' AS staff_path, 'manifests/recipes/' || sample_id || '.json' AS recipe_path, "
    "sha256(sample_id || 'input') AS input_hash, sha256(sample_id || 'mask_text') AS text_hash FROM m",
)
def sample_records(spark, sf):
    planned = plan(spark, sf)
    assets = planned.select("source_id").distinct().select(
        "source_id", F.concat("source_id", F.lit(".ly")).alias("source_path"), F.sha2("source_id", 256).alias("source_sha256"),
        F.lit("public_domain").alias("source_license_status"), F.concat(F.lit("https://example.org/"), "source_id").alias("source_url"),
    )
    roles = ("input", "clean", "recipe", "mask_background", "mask_staff", "mask_notation", "mask_text")
    hashes = planned.select("sample_id", *[F.sha2(F.concat("sample_id", F.lit(r)), 256).alias(r) for r in roles])
    rows = samples.sample_records(planned, assets, hashes, "demo", "0.1.0")
    return rows.select(
        "sample_id", "dataset_id", "source_id", "source_path", "source_sha256", "source_license_status",
        F.col("source_provenance.source_url").alias("source_url"), "page", "split", "seed", "render_id", "degradation_preset",
        "input_path", "clean_target_path", F.col("mask_paths")["staff"].alias("staff_path"), "recipe_path",
        F.col("hashes")["input"].alias("input_hash"), F.col("hashes")["mask_text"].alias("text_hash"),
    )


@query(
    "records_validate",
    sql=f"WITH {PLAN} SELECT sample_id, 'dimensions' AS rule, 'dimensions must contain positive integer width and height' AS message FROM plan WHERE page % 7 = 3 "
    "UNION ALL SELECT sample_id, 'provenance_fields', 'source_provenance requires verified_date' FROM plan WHERE source_id IN (SELECT max(source_id) FROM plan)",
)
def records_validate(spark, sf):
    """Complete records of the plan pass our own rules; broken page sizes and one unverified source do not."""
    from foliolake.operators import validation

    planned = augment.augmentation_plan(plan(spark, sf), *augment.preset_config(F.col("preset")))
    last = planned.agg(F.max("source_id")).first()[0]
    rights = F.struct(F.lit("public_domain").alias("status"), F.lit("old").alias("basis"))
    assets = planned.select("source_id").distinct().select(
        "source_id", F.concat("source_id", F.lit(".ly")).alias("source_path"), F.sha2("source_id", 256).alias("source_sha256"),
        F.lit("public_domain").alias("source_license_status"), F.concat(F.lit("https://example.org/"), "source_id").alias("source_url"),
        rights.alias("composition_rights"), rights.alias("source_file_rights"),
        F.when(F.col("source_id") != last, F.lit("2026-08-13")).alias("verified_date"),
    )
    roles = ("input", "clean", "recipe", "mask_background", "mask_staff", "mask_notation", "mask_text")
    hashes = planned.select("sample_id", *[F.sha2(F.concat("sample_id", F.lit(r)), 256).alias(r) for r in roles])
    seed = rand.hash_u64(SEED, F.col("render_id"))
    parameters = F.struct(
        F.lit(16.0).alias("staff_size"), F.lit("a4").alias("paper_format"), F.lit("portrait").alias("orientation"),
        F.struct(*[F.lit(10.0).alias(side) for side in ("top", "right", "bottom", "left")]).alias("margins_mm"),
        seed.alias("layout_seed"), F.lit(300).alias("dpi"), F.lit(0.5).alias("mask_threshold"), F.lit(True).alias("strict_unknown_grobs"),
    )
    renders = planned.select("render_id", "page").distinct().select(
        "render_id", "page", F.when(F.col("page") % 7 == 3, 0).otherwise(2480).alias("width"), F.lit(3508).alias("height"),
        F.lit(300).alias("dpi"), parameters.alias("render_parameters"),
    )
    rows = samples.full_sample_records(planned, assets, hashes, renders, "demo", "0.1.0", "2.26.0", "2026-08-13T00:00:00Z")
    lines = rows.select(
        F.col("sample_id").alias("file"), F.lit(1).cast("bigint").alias("line_no"),
        F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "true"}).alias("value"),
    )
    return validation.record_problems(lines).select(F.col("file").alias("sample_id"), "rule", "message")


@query(
    "seeded_sample",
    sql=f"SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY sha256(concat_ws(':', {S}, CAST(user_id AS VARCHAR))), user_id LIMIT 25",
)
def seeded_sample(spark, sf):
    return samples.seeded_sample(table(spark, sf, "events"), "user_id", 25, SEED)


@query(
    "epoch_record_draws",
    sql=f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws(':', {S}, 'records', CAST(doc_id AS VARCHAR))), doc_id) AS rank, count(*) OVER () AS total FROM documents), "
    f"d AS (SELECT user_id AS epoch, event_id AS \"index\", floor({u_sql(S, vsql('user_id'), vsql('event_id'), chr(39) + 'record' + chr(39))} * (SELECT count(*) FROM documents)) + 1 AS rank FROM events) "
    "SELECT epoch, \"index\", doc_id FROM d JOIN r USING (rank)",
)
def epoch_record_draws(spark, sf):
    draws = table(spark, sf, "events").select(F.col("user_id").alias("epoch"), F.col("event_id").alias("index"))
    drawn = samples.epoch_draws(docs(spark, sf).select("doc_id"), draws, "doc_id", SEED)
    return drawn.select("epoch", "index", "doc_id")


# --- augmentation plans ------------------------------------------------------------------------------

PRESET_VALUES = ", ".join(
    f"('{p}', '{fam}', '{field}', {lo}, {hi}, {str(on).lower()})" for p, fam, field, lo, hi, on in augment.preset_rows()
)
PRESETS = f"presets(preset, family, field, low, high, enabled) AS (VALUES {PRESET_VALUES})"
FAMILY_LIST = "['blur', 'gaussian_noise', 'uneven_illumination', 'jpeg', 'stains']"
PER_DOC = f"""
docplan AS (
  SELECT doc_id, {seed63_sql(S, "'sample'", vsql('doc_id'))} AS seed,
         (['light', 'medium', 'heavy', 'random', 'light'])[CAST(doc_id % 5 + 1 AS INT)] AS preset FROM documents
)"""
OPS = f"""
{PRESETS}, {PER_DOC},
counted AS (
  SELECT d.*, {int_sql('low', 'high', vsql('d.seed'), "'count'")} AS n FROM docplan d JOIN presets p ON p.preset = d.preset AND p.field = 'operation_count'
),
ranked AS (
  SELECT c.*, f.family, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(concat_ws(':', CAST(seed AS VARCHAR), 'family', f.family)), f.family) AS "order"
  FROM counted c, (SELECT unnest({FAMILY_LIST}) AS family) f
),
ops AS (
  SELECT doc_id, preset, "order", family, {seed63_sql(vsql('seed'), "'operation'", 'CAST("order" AS VARCHAR)')} AS seed FROM ranked WHERE "order" <= n
),
drawn_params AS (
  SELECT o.*, p.field, {int_sql('p.low', 'p.high', 'CAST(o.seed AS VARCHAR)', 'p.field')} AS units
  FROM ops o JOIN presets p ON p.preset = o.preset AND p.family = o.family
)"""


def doc_samples(spark, sf):
    presets = F.array(*[F.lit(p) for p in ("light", "medium", "heavy", "random", "light")])
    return docs(spark, sf).select(
        "doc_id", rand.seed63(SEED, "sample", key("doc_id")).alias("seed"),
        F.element_at(presets, (F.col("doc_id") % 5 + 1).cast("int")).alias("preset"),
    )


def parameter_rows(planned, *keys):
    ops = planned.select(*keys, F.inline("degradations"))
    return ops.select(*keys, "order", "family", "seed", F.explode("parameters").alias("field", "value"))


@query(
    "augmentation_plan",
    sql=f"WITH {OPS} SELECT doc_id, CAST(\"order\" AS INT) AS \"order\", family, seed, field, "
    "CASE WHEN field IN ('grid_size', 'quality', 'blob_count') THEN units * 1.0 ELSE units / 1000000.0 END AS value FROM drawn_params",
)
def augmentation_plan(spark, sf):
    families, ranges = augment.preset_config(F.col("preset"))
    rows = doc_samples(spark, sf)
    return parameter_rows(augment.augmentation_plan(rows, families, ranges).select("doc_id", "degradations"), "doc_id")


CUSTOM = f"""
{PRESETS},
owned AS (
  SELECT doc_id AS config_id, CASE WHEN doc_id % 23 = 5 THEN 'typo' WHEN doc_id % 23 <> 7 THEN (['light', 'medium', 'heavy', 'custom'])[CAST(doc_id % 4 + 1 AS INT)] END AS preset
  FROM documents),
overrides AS (
  SELECT doc_id AS config_id, 'blur' AS family, 'radius' AS field, 500000 AS low, CAST(NULL AS BIGINT) AS high, true AS enabled FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'jpeg', 'quality', CAST(NULL AS BIGINT), 99, CASE WHEN doc_id % 8 = 7 THEN true END FROM documents WHERE doc_id % 4 = 3
  UNION ALL SELECT doc_id, '', 'operation_count', 2, 4, NULL FROM documents WHERE doc_id % 4 = 3
),
resolved AS (
  SELECT o.config_id, p.preset, p.family, p.field, coalesce(v.low, p.low) AS low, coalesce(v.high, p.high) AS high, coalesce(v.enabled, p.enabled) AS enabled
  FROM owned o JOIN presets p USING (preset) LEFT JOIN overrides v ON v.config_id = o.config_id AND v.family = p.family AND v.field = p.field
)"""


def resolved(spark, sf):
    d, doc = docs(spark, sf), F.col("doc_id")
    presets = F.array(*[F.lit(p) for p in ("light", "medium", "heavy", "custom")])
    preset = F.when(doc % 23 == 5, F.lit("typo")).when(doc % 23 != 7, F.element_at(presets, (doc % 4 + 1).cast("int")))
    owned = d.select(doc.alias("config_id"), preset.alias("preset"))
    null = F.lit(None).cast("bigint")
    whole = lambda v: F.lit(v).cast("bigint")
    rows = [
        F.when(doc % 3 == 0, F.struct(F.lit("blur").alias("family"), F.lit("radius").alias("field"), whole(500000).alias("low"), null.alias("high"), F.lit(True).alias("enabled"))),
        F.when(doc % 4 == 3, F.struct(F.lit("jpeg").alias("family"), F.lit("quality").alias("field"), null.alias("low"), whole(99).alias("high"), F.when(doc % 8 == 7, F.lit(True)).alias("enabled"))),
        F.when(doc % 4 == 3, F.struct(F.lit("").alias("family"), F.lit("operation_count").alias("field"), whole(2).alias("low"), whole(4).alias("high"), F.lit(None).cast("boolean").alias("enabled"))),
    ]
    overrides = d.select(doc.alias("config_id"), F.inline(F.array_compact(F.array(*rows))))
    refused = augment.refused_configs(owned, overrides).select("config_id")
    return augment.resolve_presets(owned.join(refused, "config_id", "left_anti"), overrides.join(refused, "config_id", "left_anti"))


@query("resolved_presets", sql=f"WITH {CUSTOM} SELECT * FROM resolved")
def resolved_presets(spark, sf):
    return resolved(spark, sf)


@query(
    "refused_configs",
    sql="SELECT doc_id AS config_id, 'unknown preset ' || CASE WHEN doc_id % 14 = 0 THEN 'null' ELSE 'typo' END AS problem FROM documents WHERE doc_id % 7 = 0 "
    "UNION ALL SELECT doc_id, 'blur.radius must be ordered within its limits' FROM documents WHERE doc_id % 5 = 0 AND (doc_id % 9 > 5 OR doc_id % 9 < doc_id % 4) "
    "UNION ALL SELECT doc_id, 'unknown field blur.colour' FROM documents WHERE doc_id % 5 = 1 "
    "UNION ALL SELECT doc_id, 'unknown field fog.depth' FROM documents WHERE doc_id % 5 = 2 "
    "UNION ALL SELECT doc_id, 'operation_count must be ordered within its limits' FROM documents WHERE doc_id % 5 = 3 AND doc_id % 3 = 0",
)
def refused_configs(spark, sf):
    """Unknown presets, families and fields, and ranges outside their limits."""
    d, doc = docs(spark, sf), F.col("doc_id")
    name = F.when(doc % 14 == 0, F.lit(None)).when(doc % 7 == 0, F.lit("typo")).otherwise(F.lit("light"))
    part = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (doc % 5 + 1).cast("int"))
    micro = F.when(doc % 5 == 0, F.lit(1_000_000)).otherwise(F.lit(1))
    overrides = d.select(
        doc.alias("config_id"), part("blur", "blur", "fog", "", "jpeg").alias("family"),
        part("radius", "colour", "depth", "operation_count", "quality").alias("field"),
        F.when(doc % 5 == 0, (doc % 4) * micro).when(doc % 5 == 3, doc % 3).otherwise(F.lit(30)).cast("bigint").alias("low"),
        F.when(doc % 5 == 0, (doc % 9) * micro).otherwise(F.lit(40)).cast("bigint").alias("high"),
    )
    return augment.refused_configs(d.select(doc.alias("config_id"), name.alias("preset")), overrides)


@query("configs_without_family", sql=f"WITH {CUSTOM} SELECT config_id FROM resolved WHERE family <> '' GROUP BY config_id HAVING NOT bool_or(enabled)")
def configs_without_family(spark, sf):
    return augment.configs_without_family(resolved(spark, sf))


@query(
    "augmentation_plan_custom",
    sql=f"WITH {CUSTOM}, fam AS (SELECT config_id, [f for f in {FAMILY_LIST} if list_contains(list(family) FILTER (WHERE enabled AND family <> ''), f)] AS families, "
    "max(low) FILTER (WHERE field = 'operation_count') AS clow, max(high) FILTER (WHERE field = 'operation_count') AS chigh FROM resolved GROUP BY config_id), "
    f"seeded AS (SELECT *, {seed63_sql(S, chr(39) + 'sample' + chr(39), vsql('config_id'))} AS seed, len(families) AS enabled_n FROM fam WHERE len(families) > 0), "
    f"counted AS (SELECT *, {int_sql('clow', 'chigh', vsql('seed'), chr(39) + 'count' + chr(39))} AS n FROM seeded), "
    "base AS (SELECT c.*, f.family, row_number() OVER (PARTITION BY config_id ORDER BY sha256(concat_ws(':', CAST(seed AS VARCHAR), 'family', f.family)), f.family) AS i FROM counted c, unnest(c.families) f(family)), "
    f"more AS (SELECT c.*, families[CAST(floor({u_sql(vsql('seed'), chr(39) + 'extra' + chr(39), vsql('e.e'))} * enabled_n) + 1 AS INT)] AS family, enabled_n + e.e AS i FROM counted c, unnest(range(1, n - enabled_n + 1)) e(e)), "
    "every AS (SELECT * FROM base WHERE i <= n UNION ALL SELECT * FROM more), "
    "placed AS (SELECT config_id, seed, family, CASE WHEN n <= enabled_n THEN i ELSE row_number() OVER (PARTITION BY config_id ORDER BY sha256(concat_ws(':', CAST(seed AS VARCHAR), 'order', CAST(i - 1 AS VARCHAR)))) END AS \"order\" FROM every), "
    f"ops AS (SELECT config_id, \"order\", family, {seed63_sql(vsql('seed'), chr(39) + 'operation' + chr(39), 'CAST(%s AS VARCHAR)' % chr(34).join(['', 'order', '']))} AS seed FROM placed) "
    f"SELECT o.config_id, CAST(\"order\" AS INT) AS \"order\", o.family, o.seed, r.field, "
    f"CASE WHEN r.field IN ('grid_size', 'quality', 'blob_count') THEN {int_sql('low', 'high', 'CAST(o.seed AS VARCHAR)', 'r.field')} * 1.0 "
    f"ELSE {int_sql('low', 'high', 'CAST(o.seed AS VARCHAR)', 'r.field')} / 1000000.0 END AS value "
    "FROM ops o JOIN resolved r ON r.config_id = o.config_id AND r.family = o.family",
)
def augmentation_plan_custom(spark, sf):
    """Overridden configs, including more operations than enabled families."""
    configs = augment.config_column(resolved(spark, sf)).where(F.size("families") > 0)
    rows = configs.withColumn("seed", rand.seed63(SEED, "sample", key("config_id")))
    planned = augment.augmentation_plan(rows, F.col("families"), F.col("ranges"))
    return parameter_rows(planned.select("config_id", "degradations"), "config_id")


# --- resume ----------------------------------------------------------------------------------------


@query(
    "config_compatibility",
    sql="SELECT event_id, event_id % 3 <> 0 AS compatible FROM events",
)
def config_compatibility(spark, sf):
    """Stored configs against current ones that differ in worker count, and every third in substance."""
    rows = table(spark, sf, "events").select(
        "event_id", "props",
        F.concat(
            F.lit('{"workers": '), (F.col("event_id") % 5).cast("string"), F.lit(', "k": '),
            (F.get_json_object("props", "$.k").cast("bigint") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("}"),
        ).alias("current"),
    )
    same = resume.config_signature(F.col("props")) == resume.config_signature(F.col("current"))
    return rows.select("event_id", same.alias("compatible"))


STORED = f"{PLAN}, stored AS (SELECT sample_id, sample_index % 4 <> 0 AS valid FROM plan WHERE sample_index % 3 <> 0)"


@query("resume_remaining", sql=f"WITH {STORED} SELECT sample_id, sample_index AS task_index FROM plan WHERE sample_id NOT IN (SELECT sample_id FROM stored WHERE valid)")
def resume_remaining(spark, sf):
    tasks = plan(spark, sf).select("sample_id", F.col("sample_index").alias("task_index"))
    valid = tasks.where("task_index % 3 <> 0 AND task_index % 4 <> 0")
    return resume.remaining_tasks(tasks, valid)


@query("resume_merged", sql=f"WITH {STORED} SELECT sample_id, sample_index AS task_index, sample_id IN (SELECT sample_id FROM stored WHERE valid) AS reused FROM plan")
def resume_merged(spark, sf):
    tasks = plan(spark, sf).select("sample_id", F.col("sample_index").alias("task_index"))
    valid = tasks.where("task_index % 3 <> 0 AND task_index % 4 <> 0").select("sample_id")
    made = resume.remaining_tasks(tasks, valid).select("sample_id")
    return resume.merged_records(tasks, valid, made)


@query(
    "completed_datasets",
    sql="WITH m AS (SELECT user_id AS dataset_id, count(*) + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS target, count(*) AS sample_count FROM events GROUP BY user_id), "
    "p AS (SELECT DISTINCT user_id AS dataset_id FROM events WHERE event_type = 'error' AND value > 60) "
    "SELECT CAST(dataset_id AS VARCHAR) AS dataset_id, sample_count, 1 AS train_count, 0 AS validation_count, 2 AS test_count, 0 AS challenge_count, "
    "sample_count = target AND p.dataset_id IS NULL AND dataset_id % 5 <> 0 AS complete FROM m LEFT JOIN p USING (dataset_id)",
)
def completed_datasets(spark, sf):
    events = table(spark, sf, "events").withColumn("dataset_id", key("user_id"))
    problems = events.where("event_type = 'error' AND value > 60")
    user = F.col("dataset_id").cast("bigint")
    metadata = events.groupBy("dataset_id").agg((F.count(F.lit(1))).alias("n")).select(
        "dataset_id", (F.col("n") + F.when(user % 3 == 0, 1).otherwise(0)).alias("target_samples"),
        F.create_map(F.lit("train"), F.lit(1), F.lit("test"), F.lit(2)).alias("split_counts"),
        F.when(user % 5 != 0, F.lit(0)).alias("skipped_page_count"),
    )
    return resume.completed_datasets(events, problems, metadata)


@query(
    "reproduction_audit",
    sql="SELECT doc_id AS sample_id, CASE WHEN doc_id % 11 = 3 THEN 'not recomputed' ELSE array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'environment' END, "
    "CASE WHEN doc_id % 4 = 1 THEN 'input' END, CASE WHEN doc_id % 6 = 1 THEN 'clean' END], lambda c: c IS NOT NULL), ',') END AS differences, "
    "CASE WHEN doc_id % 11 = 3 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'best-effort' WHEN doc_id % 4 = 1 OR doc_id % 6 = 1 THEN 'failed' ELSE 'exact' END AS status FROM documents",
)
def reproduction_audit(spark, sf):
    doc = F.col("doc_id")
    made = lambda salt, step: F.sha2(F.concat(F.col("text"), F.when(doc % step == 1, F.lit(salt)).otherwise(F.lit(""))), 256)
    stored = docs(spark, sf).select(doc.alias("sample_id"), F.sha2("text", 256).alias("input"), F.sha2("text", 256).alias("clean"), F.lit("1").alias("version"))
    again = docs(spark, sf).select(
        doc.alias("sample_id"), made("x", 4).alias("input"), made("y", 6).alias("clean"), F.when(doc % 5 == 0, F.lit("2")).otherwise(F.lit("1")).alias("version")
    ).where(doc % 11 != 3)
    audit = resume.reproduction_audit(stored, again, ("input", "clean"), ("version",))
    return audit.withColumn("differences", F.array_join("differences", ","))


@query(
    "dataset_summary",
    sql=f"WITH t AS (SELECT source, {split_sql('source')} AS split FROM documents) SELECT 'demo' AS dataset_id, count(*) AS sample_count, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_count" for s in SPLITS)
    + ", count(DISTINCT source) AS source_count, sha256('{\"seed\":1}') AS config_sha256 FROM t",
)
def dataset_summary(spark, sf):
    rows = docs(spark, sf).select(F.col("source").alias("source_id"), splits.split_of(F.col("source"), WEIGHTS, SEED).alias("split"))
    return resume.dataset_summary(rows, '{"seed":1}', "demo")


@query(
    "source_assignments",
    sql=f"SELECT source AS source_id, arg_min({split_sql(vsql('doc_id'))}, doc_id) AS split FROM documents GROUP BY source",
)
def source_assignments(spark, sf):
    rows = docs(spark, sf).select(F.col("source").alias("source_id"), splits.split_of(key("doc_id"), WEIGHTS, SEED).alias("split"), F.col("doc_id").alias("line_no"))
    return resume.source_assignments(rows)


# --- curation --------------------------------------------------------------------------------------

TEMPLATE = "https://example.org/{commit}/{path}"


@query(
    "catalogue_assets",
    sql="SELECT 'work-' || p_partkey AS id, p_name AS title, p_brand AS composer, p_name AS work_identifier, "
    "'https://example.org/abc123/ftp/' || p_partkey || '/main.ly' AS source_url, 'sources/work-' || p_partkey || '/main.ly' AS source_file, "
    "sha256(p_name || p_type) AS source_sha256, 'public_domain' AS status, p_brand || ' died in ' || (1750 + p_size) || '; the composition is public domain.' AS basis, "
    "'pinned repository' AS file_basis, DATE '2026-08-13' AS verified_date, 'Curated V1 coverage: ' || p_type || '.' AS notes FROM part",
)
def catalogue_assets(spark, sf):
    part = table(spark, sf, "part")
    path = F.concat(F.lit("ftp/"), key("p_partkey"), F.lit("/main.ly"))
    catalogue = part.select(
        F.concat(F.lit("work-"), key("p_partkey")).alias("id"), F.col("p_brand").alias("composer"),
        (F.col("p_size") + 1750).alias("death_year"), F.col("p_name").alias("work"), path.alias("path"), F.col("p_type").alias("coverage"),
    )
    contents = part.select(path.alias("path"), F.concat("p_name", "p_type").cast("binary").alias("content"))
    rows = curation.catalogue_assets(catalogue, contents, TEMPLATE, "abc123", "pinned repository", "2026-08-13")
    return rows.select(
        "id", "title", "composer", "work_identifier", "source_url", "source_file", "source_sha256",
        F.col("composition_rights.status").alias("status"), F.col("composition_rights.basis").alias("basis"),
        F.col("source_file_rights.basis").alias("file_basis"), "verified_date", "notes",
    )


FILES = "files AS (SELECT DISTINCT 'supplier-' || l_suppkey AS id, 'part-' || l_partkey || '.ly' AS path FROM lineitem)"


def work_files(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    path = F.concat(F.lit("part-"), key("l_partkey"), F.lit(".ly"))
    return rows.select(F.concat(F.lit("supplier-"), key("l_suppkey")).alias("id"), path.alias("path"), path.cast("binary").alias("content"))


@query(
    "curation_report",
    sql=f"WITH {FILES} SELECT id, path AS repository_path, 'https://example.org/abc123/' || path AS source_url, sha256(path) AS sha256 FROM files",
)
def curation_report(spark, sf):
    return curation.curation_report(work_files(spark, sf), TEMPLATE, "abc123")


@query("curation_totals", sql=f"WITH {FILES} SELECT count(DISTINCT id) AS work_count, count(*) AS file_count FROM files")
def curation_totals(spark, sf):
    return curation.curation_totals(work_files(spark, sf))
