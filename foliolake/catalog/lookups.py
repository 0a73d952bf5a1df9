"""Lookups, registry, include closure, checkpoints, model pairs, keys and planned outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.planning import S, docs, key, vsql
from foliolake.catalog.rasters import SEED
from foliolake.catalog.registry import query, table
from foliolake.operators import lookups

IDS = ("src7", "src3", "nowhere", "src11", "src0")
_ids = ", ".join(f"({i}, '{s}')" for i, s in enumerate(IDS))


def sources(spark, sf):
    return docs(spark, sf).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("sources_by_list", sql=f"SELECT pos, source AS id, count(*) AS n FROM documents JOIN (VALUES {_ids}) v(pos, id) ON id = source GROUP BY pos, source")
def sources_by_list(spark, sf):
    return lookups.select_sources(spark, sources(spark, sf), IDS)[0]


@query("sources_missing", sql=f"SELECT pos, id FROM (VALUES {_ids}) v(pos, id) WHERE id NOT IN (SELECT source FROM documents)")
def sources_missing(spark, sf):
    return lookups.select_sources(spark, sources(spark, sf), IDS)[1]


@query(
    "source_hash_problems",
    sql="SELECT doc_id AS sample_id, CASE WHEN doc_id % 13 = 0 THEN 'ghost' ELSE source END AS source_id, "
    "CASE WHEN doc_id % 13 = 0 THEN 'source is absent' ELSE 'source SHA-256 differs' END AS problem FROM documents WHERE doc_id % 13 = 0 OR doc_id % 17 = 0",
)
def source_hash_problems(spark, sf):
    d = F.col("doc_id")
    samples = docs(spark, sf).select(
        d.alias("sample_id"), F.when(d % 13 == 0, F.lit("ghost")).otherwise(F.col("source")).alias("source_id"),
        F.sha2(F.concat("source", F.when(d % 17 == 0, F.lit("!")).otherwise(F.lit(""))), 256).alias("source_sha256"),
    )
    assets = sources(spark, sf).select(F.col("id").alias("source_id"), F.sha2("id", 256).alias("source_sha256"))
    return lookups.source_hash_problems(samples, assets)


@query(
    "located_samples",
    sql="WITH r AS (SELECT event_type AS file, CAST(user_id * 100 + event_id % 7 AS VARCHAR) AS sample_id FROM events), "
    "w AS (SELECT CAST(user_id * 100 + 3 AS VARCHAR) AS sample_id FROM events UNION SELECT 'x' || event_id FROM events) "
    "SELECT w.sample_id, count(r.file) AS matches, CASE WHEN count(r.file) = 1 THEN min(r.file) END AS file, "
    "CASE count(r.file) WHEN 0 THEN 'not found' WHEN 1 THEN 'ok' ELSE 'occurs in multiple datasets' END AS status FROM w LEFT JOIN r USING (sample_id) GROUP BY w.sample_id",
)
def located_samples(spark, sf):
    events = table(spark, sf, "events")
    records = events.select(F.col("event_type").alias("file"), (F.col("user_id") * 100 + F.col("event_id") % 7).cast("string").alias("sample_id"))
    wanted = events.select((F.col("user_id") * 100 + 3).cast("string").alias("sample_id")).union(
        events.select(F.concat(F.lit("x"), F.col("event_id").cast("string")))
    ).distinct()
    return lookups.locate_samples(records, wanted)


@query(
    "invalid_existing_ids",
    sql="WITH r AS (SELECT CASE WHEN event_id % 100 = 0 THEN '' ELSE CAST(event_id % 5000 AS VARCHAR) END AS sample_id FROM events) "
    "SELECT sample_id, count(*) AS n, CASE WHEN sample_id = '' THEN 'invalid sample_id' ELSE 'repeated sample_id' END AS problem FROM r GROUP BY sample_id HAVING sample_id = '' OR count(*) > 1",
)
def invalid_existing_ids(spark, sf):
    e = F.col("event_id")
    return lookups.invalid_existing_ids(
        table(spark, sf, "events").select(F.when(e % 100 == 0, F.lit("")).otherwise((e % 5000).cast("string")).alias("sample_id"))
    )


REGISTRY = (("click", "staff"), ("view", "text"), ("purchase", "notation"))
_registry = ", ".join(f"('{n}', '{c}')" for n, c in REGISTRY)


def classified(spark, sf):
    registry = spark.createDataFrame(list(REGISTRY), "name string, class string")
    names = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("name"))
    return lookups.classify_names(names, registry)


@query(
    "classified_names",
    sql=f"SELECT event_id, user_id, event_type AS name, coalesce(class, 'notation') AS class, class IS NOT NULL AS known FROM events LEFT JOIN (VALUES {_registry}) r(n, class) ON n = event_type",
)
def classified_names(spark, sf):
    return classified(spark, sf)


@query("unknown_names", sql="SELECT DISTINCT user_id, event_type AS name FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def unknown_names(spark, sf):
    return lookups.unknown_names(classified(spark, sf), ["user_id"])


# --- includes: a page's links lead to the page numbered by the link text --------------------------------

HREF = r'href="/([^"]+)"'
LINKS = f"""
raw AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{HREF}', 1))) AS include FROM pages),
links AS (SELECT DISTINCT page_id, length(include) * 7 + ascii(include) AS target FROM raw WHERE include NOT IN ('the', 'de')),
closure AS (
  SELECT page_id AS root, page_id AS path FROM pages UNION SELECT c.root, l.target FROM closure c JOIN links l ON l.page_id = c.path
)"""


@query(
    "include_edges",
    sql=f"WITH raw AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{HREF}', 1))) AS include FROM pages) "
    "SELECT 'p/' || page_id AS path, include, 'p/' || include AS target, (include LIKE '/%' OR list_contains(string_split(include, '/'), '..')) AS unsafe FROM raw WHERE include NOT IN ('the', 'de')",
)
def include_edges(spark, sf):
    files = table(spark, sf, "pages").select(F.concat(F.lit("p/"), key("page_id")).alias("path"), F.col("html").alias("text"))
    return lookups.include_edges(files, HREF, ("the", "de"))


@query("include_closure", sql=f"WITH RECURSIVE {LINKS} SELECT root, path FROM closure")
def include_closure(spark, sf):
    files = table(spark, sf, "pages").select(F.concat(F.lit("p/"), key("page_id")).alias("path"), F.col("html").alias("text"))
    edges = lookups.include_edges(files, HREF, ("the", "de"))
    page = lambda c: F.substring(c, 3, 20).cast("bigint")
    target = (F.length("include") * 7 + F.ascii("include")).cast("bigint")
    numbered = edges.select(page("path").alias("path"), target.alias("target"), "unsafe")
    return lookups.include_closure(table(spark, sf, "pages").select(F.col("page_id").alias("path")), numbered)


# --- checkpoints ---------------------------------------------------------------------------------------


def checkpoints(spark, sf):
    e, bad = F.col("event_id"), F.col("event_id") % 11
    loss = F.when(bad == 0, F.lit(None).cast("double")).when(bad == 1, F.lit(float("nan"))).when(bad == 2, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("runs/"), key("event_id"), F.lit("/best.pt")).alias("path"),
        F.when(e % 3 == 0, F.lit("resnet18")).when(e % 3 == 1, F.lit("unet")).alias("backend"),
        F.element_at(F.array(*[F.lit(t) for t in ("clean", "segment", "multitask")]), (e % 5 % 3 + 1).cast("int")).alias("task"),
        loss.alias("validation_loss"), F.when(e % 7 != 0, F.lit(32)).alias("base_channels"),
        F.when(e % 2 == 0, F.lit(True)).alias("pretrained"), F.lit(None).cast("boolean").alias("freeze_batch_norm"),
    )


CHECKPOINTS = """
ck AS (
  SELECT 'runs/' || event_id || '/best.pt' AS path, CASE WHEN event_id % 3 = 0 THEN 'resnet18' ELSE 'unet' END AS backend,
         (['clean', 'segment', 'multitask'])[CAST(event_id % 5 % 3 + 1 AS INT)] AS task, value AS validation_loss, event_id,
         CASE WHEN event_id % 7 <> 0 THEN 32 END AS base_channels, event_id % 2 = 0 AS pretrained, true AS freeze_batch_norm FROM events
),
fit AS (SELECT * FROM ck WHERE event_id % 11 NOT IN (0, 1, 2) AND task <> 'segment'),
best AS (SELECT backend, path, validation_loss FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY validation_loss, path) AS rn FROM fit) WHERE rn = 1)"""


@query("eligible_checkpoints", sql=f"WITH {CHECKPOINTS} SELECT path, backend, task, validation_loss, base_channels, pretrained, freeze_batch_norm FROM fit")
def eligible_checkpoints(spark, sf):
    return lookups.eligible_checkpoints(checkpoints(spark, sf))


@query("checkpoint_problems", sql="SELECT 'runs/' || event_id || '/best.pt' AS path, 'checkpoint lacks base_channels' AS problem FROM events WHERE event_id % 7 = 0")
def checkpoint_problems(spark, sf):
    return lookups.checkpoint_problems(checkpoints(spark, sf))


@query("best_checkpoints", sql=f"WITH {CHECKPOINTS} SELECT * FROM best")
def best_checkpoints(spark, sf):
    return lookups.best_checkpoints(checkpoints(spark, sf))


def models(spark, sf):
    nation = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    return nation.select(F.col("n_name").alias("model"), F.when(k % 4 == 0, F.lit("vit")).when(k % 2 == 0, F.lit("unet")).otherwise(F.lit("resnet18")).alias("backend"), k.alias("k"))


def overrides(spark, sf):
    return models(spark, sf).where("k % 5 = 0").select("model", F.concat(F.lit("given/"), "model").alias("path")).unionByName(
        table(spark, sf, "region").select(F.concat(F.lit("x-"), "r_name").alias("model"), F.lit("given/x").alias("path"))
    )


@query(
    "selected_checkpoints",
    sql=f"WITH {CHECKPOINTS}, m AS (SELECT n_name AS model, CASE WHEN n_nationkey % 4 = 0 THEN 'vit' WHEN n_nationkey % 2 = 0 THEN 'unet' ELSE 'resnet18' END AS backend, n_nationkey AS k FROM nation) "
    "SELECT model, backend, CASE WHEN k % 5 = 0 THEN 'given/' || model ELSE path END AS path, "
    "CASE WHEN k % 5 = 0 THEN 'explicit_override' WHEN path IS NOT NULL THEN 'automatic_lowest_validation_loss' END AS selection FROM m LEFT JOIN best USING (backend)",
)
def selected_checkpoints(spark, sf):
    return lookups.selected_checkpoints(models(spark, sf).drop("k"), checkpoints(spark, sf), overrides(spark, sf))


@query("unknown_overrides", sql="SELECT 'x-' || r_name AS model FROM region")
def unknown_overrides(spark, sf):
    return lookups.unknown_overrides(models(spark, sf), overrides(spark, sf))


@query(
    "controlled_comparisons",
    sql="WITH m AS (SELECT n_name AS name, n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'clean' ELSE 'multitask' END AS task, "
    "CASE WHEN n_nationkey % 2 = 0 THEN 'unet' ELSE 'resnet18' END AS backend FROM nation) "
    "SELECT a.name || '_vs_' || b.name AS comparison, a.name AS left_model, b.name AS right_model, "
    "CASE WHEN a.task <> b.task AND a.backend = 'unet' AND b.backend = 'unet' THEN 'cleaning_only_vs_multitask_custom_unet' "
    "WHEN a.backend <> b.backend THEN 'custom_unet_vs_resnet18_transfer' ELSE 'unqualified' END AS comparison_type, "
    "a.k % 7 <> 6 AND b.k % 7 <> 6 AND a.k % 4 = b.k % 4 AS controlled FROM m a JOIN m b ON a.name < b.name",
)
def controlled_comparisons(spark, sf):
    k = F.col("n_nationkey")
    task = F.when(k % 3 == 0, F.lit("clean")).otherwise(F.lit("multitask"))
    backend = F.when(k % 2 == 0, F.lit("unet")).otherwise(F.lit("resnet18"))
    config = F.when(k % 7 == 6, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("task"), task, F.lit("model_backend"), backend, F.lit("lr"), (k % 4).cast("string"))
    )
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("name"), task.alias("task"), backend.alias("backend"), config.alias("config"))
    return lookups.controlled_comparisons(rows)


@query(
    "source_keys",
    sql="WITH s AS (SELECT 'in/' || page_id || '/' || regexp_extract(url, '([0-9]+)([?#].*)?$', 1) || '.pdf' AS path FROM pages), "
    "r AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, row_number() OVER (ORDER BY path) AS position FROM s), "
    "c AS (SELECT stem, count(*) AS n FROM r GROUP BY stem) SELECT path, CASE WHEN n > 1 THEN r.stem || '-' || position ELSE r.stem END AS key FROM r JOIN c ON c.stem = r.stem",
)
def source_keys(spark, sf):
    number = F.regexp_extract("url", r"([0-9]+)([?#].*)?$", 1)
    paths = table(spark, sf, "pages").select(F.concat(F.lit("in/"), key("page_id"), F.lit("/"), number, F.lit(".pdf")).alias("path"))
    return lookups.source_keys(paths)


OUTPUTS = ["metadata.json", "cleaned.png", "probabilities/cleaning.png"] + [f"{k}/{c}.png" for k in ("probabilities", "masks") for c in ("background", "staff", "notation", "text")] + ["overlay.png"]
PLANNED = "planned AS (SELECT 'out/' || (page_id % 3) AS root, 'out/' || (page_id % 3) || printf('/page-%04d/', page_id) || n.n AS path FROM pages, (VALUES " + ", ".join(f"('{o}')" for o in OUTPUTS) + ") n(n) UNION ALL SELECT DISTINCT 'out/' || (page_id % 3), 'out/' || (page_id % 3) || '/metadata.json' FROM pages)"


def planned(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("out/"), (F.col("page_id") % 3).cast("string")).alias("root"), F.col("page_id").alias("page_number"))
    return lookups.planned_outputs(pages, overlay=True)


@query("planned_outputs", sql=f"WITH {PLANNED} SELECT * FROM planned")
def planned_outputs(spark, sf):
    return planned(spark, sf)


@query("overwrite_set", sql=f"WITH {PLANNED} SELECT * FROM planned WHERE path IN (SELECT 'out/' || (page_id % 3) || printf('/page-%04d/cleaned.png', page_id) FROM pages WHERE page_id % 4 = 0)")
def overwrite_set(spark, sf):
    p = F.col("page_id")
    existing = table(spark, sf, "pages").where(p % 4 == 0).select(
        F.concat(F.lit("out/"), (p % 3).cast("string"), F.format_string("/page-%04d/cleaned.png", p.cast("int"))).alias("path")
    )
    return lookups.overwrite_set(planned(spark, sf), existing)


@query(
    "page_order_by_suffix",
    sql="SELECT 'score-page' || n_nationkey || '.png' AS name, n_nationkey AS page, row_number() OVER (ORDER BY n_nationkey) AS position FROM nation",
)
def page_order_by_suffix(spark, sf):
    """Rendered pages in numeric order (page2 before page10)."""
    from foliolake.functions.paths import page_number_of
    from foliolake.operators.ranking import sorted_rank

    names = table(spark, sf, "nation").select(F.concat(F.lit("score-page"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("name"))
    return sorted_rank(names.withColumn("page", page_number_of(F.col("name"))), ["page"], "position")
