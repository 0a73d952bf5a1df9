"""Tall pages, scorers that see their place, page facts, file headers and finished work, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliolake.catalog.augment import recipes
from foliolake.catalog.cleaning_metrics import rounded
from foliolake.catalog.kernels import ADAPTIVE, NORMALIZED, chain_sql, pixels_of, with_clean
from foliolake.catalog.planning import docs, key
from foliolake.catalog.rasters import DENSE, SEED, SHAPE, WEIGHTS, dense, r6_sql, split_sql
from foliolake.catalog.registry import SQL, query, spread, table
from foliolake.catalog.reports import classical_suite_rows  # noqa: F401  its SQL is used below
from foliolake.catalog.sources import scratch
from foliolake.catalog.tiles import starts_sql
from foliolake.functions.score import r6
from foliolake.operators import augment, kernels, lookups, raster, stencil, tiles
from foliolake.plans import reports, resume, splits
from foliolake.sources import headers, manifests, sinks

# --- pages of several bands ----------------------------------------------------------------------------


def tall(spark, sf, times: int):
    """Pages of ``50 * times`` rows: the dense page again and again, each time with other levels."""
    rows = dense(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.select(
        "page_id", (F.col("y") + 50 * F.col("k")).cast("int").alias("y"), F.transform("values", lambda v: (v * 3 + 17 * F.col("k")) % 256).alias("values")
    )


def tall_sql(times: int) -> str:
    base = DENSE.replace("dense AS (", "base AS (", 1)
    return f"{base}, dense AS MATERIALIZED (SELECT page_id, CAST(y + 50 * k AS INT) AS y, x, CAST((v * 3 + 17 * k) % 256 AS INT) AS v FROM base, range({times}) r(k))"


@query("adaptive_binarized_tall", sql=f"WITH {tall_sql(7)}, {SHAPE}, {ADAPTIVE} SELECT page_id, y, x, v FROM adaptive")
def adaptive_binarized_tall(spark, sf):
    """350 rows are three bands, so halos and cuts are seen."""
    return pixels_of(kernels.adaptive_binarize(tall(spark, sf, 7)), "binary")


@query(
    "morphology_tall",
    sql=f"WITH {tall_sql(7)}, bin AS (SELECT page_id, y, x, CASE WHEN v > 110 THEN 255 ELSE 0 END AS v FROM dense), "
    f"{chain_sql('bin', 'cleaned', 'open_close')} SELECT page_id, y, x, v FROM cleaned",
)
def morphology_tall(spark, sf):
    binary = tall(spark, sf, 7).withColumn("binary", kernels.binarize(F.col("values"), F.lit(110)))
    return pixels_of(kernels.morphology(binary), "binary")


@query("illumination_normalized_tall", sql=f"WITH {tall_sql(7)}, {NORMALIZED} SELECT page_id, y, x, v FROM normalized")
def illumination_normalized_tall(spark, sf):
    return pixels_of(kernels.normalize_illumination(tall(spark, sf, 7)), "normalized")


@query("classical_suite_rows_tall", sql=SQL["classical_suite_rows"].replace(DENSE, tall_sql(3)))
def classical_suite_rows_tall(spark, sf):
    """The whole suite on pages of two bands."""
    return rounded(reports.classical_rows(with_clean(tall(spark, sf, 3))), (*reports.SCORES, "ssim"))


def above_and_below(planes):
    """A user's own kernel: the darkest of a pixel and its vertical neighbours."""
    padded = np.pad(planes["values"], ((1, 1), (0, 0)), mode="edge")
    return {"values": np.minimum(np.minimum(padded[:-2], padded[2:]), planes["values"])}


@query(
    "custom_kernel_pages",
    sql=f"WITH {tall_sql(7)} SELECT page_id, y, x, least(v, lag(v, 1, v) OVER w, lead(v, 1, v) OVER w) AS v FROM dense WINDOW w AS (PARTITION BY page_id, x ORDER BY y)",
)
def custom_kernel_pages(spark, sf):
    """Any function from planes to planes runs over bands like the library's own kernels."""
    return raster.to_pixels(stencil.map_bands(tall(spark, sf, 7), above_and_below, 1, ("values",), {"values": "int"}, levels=("values",)))


# --- scorers that see their place ----------------------------------------------------------------------

#: Per channel: factors of the level, one, the row and the column in the tile, and the level at the opposite place.
PLACED = {
    "cleaning": (-4.0, 2.0, 0.02, -0.03, 0.5), "background": (4.0, -2.0, -0.01, 0.02, -0.25), "staff": (1.0, -0.5, 0.03, 0.0, 1.0),
    "notation": (2.0, -1.0, 0.0, 0.05, -1.0), "text": (3.0, -2.0, 0.01, 0.01, 2.0),
}


def placed(values: np.ndarray) -> np.ndarray:
    """A stand-in for a model whose logits depend on the place in the tile and on what lies opposite, padding included."""
    size = values.shape[1]
    row, column = np.arange(size)[None, :, None], np.arange(size)[None, None, :]
    opposite = values[:, ::-1, ::-1]
    return np.stack([a * values + b + c * row + d * column + e * opposite for a, b, c, d, e in PLACED.values()], axis=1)


def placed_sql(tile: int, overlap: int) -> str:
    """Tiles, their padding, the scorer and the blend, pixel by pixel."""
    fold = lambda at, n: f"least(({at}) % (2 * ({n} - 1)), 2 * ({n} - 1) - ({at}) % (2 * ({n} - 1)))"
    window = lambda at: f"greatest(0.5 - 0.5 * cos(2 * pi() * {at} / {tile - 1}.0), 1e-3)"
    z = ", ".join(
        f"sum(wt * ({a} * v + {b} + {c} * ty + {d} * tx + {e} * o)) / sum(wt) AS {name}" for name, (a, b, c, d, e) in PLACED.items()
    )
    return (
        f"{SHAPE}, tops AS (SELECT page_id, h, w, CAST(unnest({starts_sql('h', tile, overlap)}) AS INT) AS top FROM shape), "
        f"grid AS (SELECT page_id, top, CAST(unnest({starts_sql('w', tile, overlap)}) AS INT) AS lft, least({tile}, h - top) AS th, w FROM tops), "
        f"cut AS (SELECT *, least({tile}, w - lft) AS tw FROM grid), "
        "inside AS (SELECT d.page_id, d.y, d.x, d.v / 255.0 AS v, d.y - top AS ty, d.x - lft AS tx, "
        f"top + {fold(f'{tile - 1} - (d.y - top)', 'th')} AS oy, lft + {fold(f'{tile - 1} - (d.x - lft)', 'tw')} AS ox "
        f"FROM dense d JOIN cut c ON c.page_id = d.page_id AND d.y >= top AND d.y < top + {tile} AND d.x >= lft AND d.x < lft + {tile}), "
        f"seen AS (SELECT i.*, o.v / 255.0 AS o, {window('ty')} * {window('tx')} AS wt FROM inside i JOIN dense o ON o.page_id = i.page_id AND o.y = oy AND o.x = ox), "
        f"blended AS (SELECT page_id, y, x, {z} FROM seen GROUP BY page_id, y, x)"
    )


PLACED_COLUMNS = ", ".join(f"{r6_sql(c)} AS {c}" for c in tiles.CHANNELS)


def placed_pixels(spark, sf, tile, overlap):
    logits = tiles.score_pages(dense(spark, sf), placed, tile, overlap, logits="double")
    px = logits.select("page_id", "y", *tiles.CHANNELS[1:], F.posexplode("cleaning").alias("x", "c0"))
    return px.select("page_id", "y", "x", r6(F.col("c0")).alias("cleaning"), *[r6(F.get(F.col(c), F.col("x"))).alias(c) for c in tiles.CHANNELS[1:]])


@query("placed_logits", sql=f"WITH {DENSE}, {placed_sql(32, 8)} SELECT page_id, y, x, {PLACED_COLUMNS} FROM blended")
def placed_logits(spark, sf):
    """Six tiles a page: a wrong window, order or start would be seen."""
    return placed_pixels(spark, sf, 32, 8)


@query("placed_logits_padded", sql=f"WITH {DENSE}, {placed_sql(80, 16)} SELECT page_id, y, x, {PLACED_COLUMNS} FROM blended")
def placed_logits_padded(spark, sf):
    """One tile larger than the page: what lies opposite is mostly padding."""
    return placed_pixels(spark, sf, 80, 16)


# --- page facts ------------------------------------------------------------------------------------------


def numbered_pages(spark, sf):
    """Source, page number and resolution of every second dense page, and their sizes."""
    p = F.col("page_id")
    return raster.page_shape(dense(spark, sf)).select(
        "page_id", F.concat(F.lit("in/s"), (p % 3).cast("string"), F.lit(".pdf")).alias("source"), F.floor(p / 3 + 1).cast("int").alias("page_number"),
        F.lit(300).alias("dpi"), "height", "width",
    )


@query(
    "scored_page_facts",
    sql=f"WITH {DENSE}, {SHAPE} SELECT page_id, CAST(h AS INT) AS height, CAST(w AS INT) AS width, 32 AS tile_size, 8 AS overlap, "
    f"len({starts_sql('h', 32, 8)}) * len({starts_sql('w', 32, 8)}) AS tile_count, CASE WHEN page_id % 5 <> 4 THEN CAST(page_id // 3 + 1 AS INT) END AS page_number, "
    "CASE WHEN page_id % 5 <> 4 THEN 300 END AS dpi, CAST(0.4 AS DOUBLE) AS cleaning_threshold, CAST(0.7 AS DOUBLE) AS segmentation_threshold FROM shape",
)
def scored_page_facts(spark, sf):
    """Facts and thresholds beside the tile settings; some pages have no facts."""
    known = numbered_pages(spark, sf).where("page_id % 5 <> 4")
    return tiles.page_facts(dense(spark, sf), known, 32, 8, 0.4, 0.7)


INDEX = f"""
{SHAPE}, index AS (
  SELECT 'in/s' || (page_id % 3) || '.pdf' AS source, CAST(page_id // 3 + 1 AS INT) AS page_number, 300 AS input_dpi, CAST(w AS INT) AS width, CAST(h AS INT) AS height,
    'original/s' || (page_id % 3) || printf('/page-%04d.png', page_id // 3 + 1) AS original, p.id AS comparison_id,
    p.id || '/s' || (page_id % 3) || printf('/page-%04d.png', page_id // 3 + 1) AS cleaned,
    CASE p.id WHEN 'unet' THEN len({starts_sql('h', 32, 8)}) * len({starts_sql('w', 32, 8)}) WHEN 'resnet' THEN len({starts_sql('h', 48, 16)}) * len({starts_sql('w', 48, 16)}) END AS tile_count
  FROM shape, (VALUES ('classical_cleaned'), ('unet'), ('resnet')) p(id))"""


def index(spark, sf):
    pages = numbered_pages(spark, sf).withColumnRenamed("dpi", "input_dpi")
    keys = lookups.source_keys(pages.select("source").distinct(), "source")
    return reports.page_index(pages, keys, [("classical_cleaned", None, 0), ("unet", 32, 8), ("resnet", 48, 16)])


@query("page_index", sql=f"WITH {DENSE}, {INDEX} SELECT * FROM index")
def page_index(spark, sf):
    return index(spark, sf)


@query(
    "comparison_totals",
    sql=f"WITH {DENSE}, {INDEX} SELECT count(DISTINCT source) AS source_count, count(DISTINCT source || page_number) AS page_count, CAST(sum(tile_count) AS BIGINT) AS tile_count FROM index",
)
def comparison_totals(spark, sf):
    return reports.comparison_totals(index(spark, sf))


# --- recipes and hashes ----------------------------------------------------------------------------------


@query(
    "recipe_details",
    sql=f"WITH {DENSE}, {SHAPE}, steps AS (SELECT page_id, h, w, s.i AS \"order\", s.family FROM shape JOIN (VALUES (0, 1, 'blur'), (0, 2, 'gaussian_noise'), "
    "(1, 1, 'uneven_illumination'), (1, 2, 'stains'), (1, 3, 'jpeg'), (2, 1, 'gaussian_noise'), (2, 2, 'blur'), (2, 3, 'uneven_illumination')) s(k, i, family) ON page_id % 4 = s.k) "
    "SELECT page_id, \"order\", family, CASE WHEN family = 'stains' THEN CAST(round_even(h * w * 0.002, 0) AS INT) END AS speckle_count, "
    f"CASE WHEN family = 'stains' THEN {r6_sql('greatest(0.5, greatest(1.0, least(h, w) * 0.09) * 0.18)')} END AS edge_blur_radius, "
    "CASE WHEN family = 'uneven_illumination' THEN 'smooth_shadow_field' END AS kind, CASE WHEN family = 'jpeg' THEN false END AS optimize, "
    "CASE WHEN family = 'jpeg' THEN false END AS progressive FROM steps",
)
def recipe_details(spark, sf):
    fixed = F.create_map(F.lit("speckle_density"), F.lit(0.002), F.lit("blob_radius_fraction"), F.lit(0.09))
    planned = recipes(spark, sf).withColumn("degradations", F.transform("degradations", lambda o: o.withField("parameters", fixed)))
    steps = augment.recipe_details(planned, raster.page_shape(dense(spark, sf)))
    return steps.drop("seed", "parameters").withColumn("edge_blur_radius", r6(F.col("edge_blur_radius")))


@query(
    "image_hashes",
    sql=f"WITH {DENSE}, lines AS (SELECT page_id, y, max(x) + 1 AS w, string_agg(printf('%02X', v), '' ORDER BY x) AS b FROM dense GROUP BY page_id, y) "
    "SELECT page_id, sha256(unhex('4C00' || hex(CAST(max(w) AS VARCHAR)) || '78' || hex(CAST(count(*) AS VARCHAR)) || '00' || string_agg(b, '' ORDER BY y))) AS pixel_sha256 FROM lines GROUP BY page_id",
)
def image_hashes(spark, sf):
    """Mode, size and raw bytes of 50 x 64 pages held as image structs."""
    line = F.array_join(F.transform("values", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    rows = dense(spark, sf).select("page_id", "y", F.size("values").alias("w"), line.alias("b"))
    data = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "b"))), lambda r: r["b"]), ""))
    images = rows.groupBy("page_id").agg(F.struct(F.max("w").alias("width"), F.count(F.lit(1)).cast("int").alias("height"), data.alias("data")).alias("image"))
    return augment.image_hash(images)


@query(
    "reproduced_pages",
    sql=f"WITH {DENSE}, ids AS (SELECT DISTINCT page_id FROM dense) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'exact' END AS status FROM ids",
)
def reproduced_pages(spark, sf):
    """Pages made again from plan and kernels; every third stored hash belongs to another recipe."""
    planned = recipes(spark, sf)
    stored = augment.pixel_hash(augment.apply_recipes(dense(spark, sf), planned)).withColumn(
        "pixel_sha256", F.when(F.col("page_id") % 3 == 0, F.sha2("pixel_sha256", 256)).otherwise(F.col("pixel_sha256"))
    )
    return resume.reproduction_from_plan(stored, dense(spark, sf).repartition(5, "page_id", "y"), planned)


# --- finished work ---------------------------------------------------------------------------------------


@query(
    "completed_evaluations",
    sql="SELECT DISTINCT user_id AS run, CASE user_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'unfinished' WHEN 2 THEN 'altered' ELSE 'unfinished' END AS status FROM events",
)
def completed_evaluations(spark, sf):
    """Finished, unfinished, altered and torn runs, told apart by row counts and fingerprints."""
    columns = ("sample_id", "dice")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("sample_id"), F.round("value", 6).alias("dice"))
    told = resume.fingerprint(rows, columns, ("run",))
    summaries = told.select(
        "run", F.when(F.col("run") % 4 == 1, F.col("row_count") + 1).when(F.col("run") % 4 != 3, F.col("row_count")).alias("sample_count"), "digest"
    )
    latest = rows.groupBy("run").agg(F.max("sample_id").alias("last"))
    stored = rows.join(latest, "run").withColumn(
        "dice", F.when((F.col("run") % 4 == 2) & (F.col("sample_id") == F.col("last")), F.coalesce("dice", F.lit(0.0)) + 1).otherwise(F.col("dice"))
    )
    return resume.completed_evaluations(stored, summaries, columns)


@query(
    "dataset_metadata",
    sql=f"WITH t AS (SELECT doc_id, source, {split_sql('source')} AS split FROM documents) SELECT 1 AS schema_version, 'demo' AS dataset_id, count(*) AS sample_count, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_count" for s in WEIGHTS)
    + ", count(DISTINCT source) AS source_count, sha256('{\"seed\":1}') AS config_sha256, CAST(7 AS BIGINT) AS skipped_page_count, 'lilypond=2.26.0,numpy=2' AS versions, "
    "count(*) AS source_manifest_lines, CAST(sum(CAST('0x' || substr(sha256('v' || doc_id || chr(31) || 'v' || source), 1, 13) AS UBIGINT)) AS VARCHAR) AS source_manifest_digest FROM t",
)
def dataset_metadata(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.col("source").alias("source_id"), splits.split_of(F.col("source"), WEIGHTS, SEED).alias("split"))
    manifest = rows.select(F.col("doc_id").alias("line_no"), F.col("source_id").alias("value"))
    made = resume.dataset_metadata(rows, manifest, '{"seed":1}', "demo", 7, {"numpy": "2", "lilypond": "2.26.0"})
    pairs = F.transform(F.array_sort(F.map_entries("software_versions")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return made.withColumn("versions", F.array_join(pairs, ",")).drop("software_versions")


# --- files -----------------------------------------------------------------------------------------------


@query(
    "metadata_file_problems",
    sql="SELECT s_suppkey AS id, (['invalid dataset metadata JSON', 'dataset metadata root must be an object', 'dataset metadata schema_version must be 1', "
    "'dataset metadata schema_version must be 1'])[CAST(s_suppkey % 5 AS INT)] AS message FROM supplier WHERE s_suppkey % 5 <> 0",
)
def metadata_file_problems(spark, sf):
    """One description per supplier: sound, broken, no object, another version, a version that is no number.

    Every description is a file of its own. The files lie in a hundred folders and are written by all cores.
    """
    path, k = scratch(spark), F.col("s_suppkey")
    value = F.when(k % 5 == 1, F.lit("{oops")).when(k % 5 == 2, F.lit("[1]")).when(k % 5 == 3, F.lit('{"schema_version":2}')).when(
        k % 5 == 4, F.lit('{"schema_version":true}')).otherwise(F.lit('{"schema_version":1}'))
    name = F.concat((k % 100).cast("string"), F.lit("/"), k.cast("string"), F.lit(".json"))
    sinks.write_files(spread(table(spark, sf, "supplier"), "s_suppkey").select(name.alias("path"), value.alias("content")), path)
    found = manifests.metadata_file_problems(spark, f"{path}/*")
    return found.select(F.regexp_extract("file", "([0-9]+)[.]json$", 1).cast("bigint").alias("id"), "message")


@query(
    "absolute_line_numbers",
    sql="SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no FROM documents",
)
def absolute_line_numbers(spark, sf):
    """One file per source, written in the order of ids and read back with its line numbers, in small splits."""
    path = scratch(spark)
    rows = docs(spark, sf).select("source", key("doc_id").alias("value"), "doc_id").repartition("source").sortWithinPartitions("source", "doc_id")
    rows.drop("doc_id").write.partitionBy("source").text(path)
    name = F.regexp_extract("file", "source=([^/]+)", 1)
    return manifests.read_lines(spark, path).select(name.alias("source"), F.col("value").cast("bigint").alias("doc_id"), "line_no")


@query(
    "raster_headers",
    sql="SELECT s_suppkey AS id, (['png', 'jpeg', 'tiff', 'tiff'])[CAST(s_suppkey % 5 AS INT)] AS format, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(100 + s_suppkey % 150 AS INT) END AS width, "
    "CASE WHEN s_suppkey % 5 <> 0 THEN CAST(40 + s_suppkey % 211 AS INT) END AS height FROM supplier WHERE s_suppkey % 7 <> 0",
)
def raster_headers(spark, sf):
    """Headers of image files of three kinds, and of one that is no image; another suffix is not listed."""
    path, k = scratch(spark), F.col("s_suppkey")
    width, height = 100 + k % 150, 40 + k % 211
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    pair = lambda c: F.lpad(F.hex(c), 4, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D494844520000"), pair(width), F.lit("0000"), pair(height), F.lit("08000000"))
    # A comment segment comes before the frame header of the JPEG.
    jpeg = F.concat(F.lit("FFD8FFFE0005414243"), F.lit("FFC0001108"), pair(height), pair(width), F.lit("03"))
    entry = lambda tag, c: F.concat(F.lit(f"{tag}030001000000"), byte(c), F.lit("000000"))
    tiff = F.concat(F.lit("49492A0010000000"), F.lit("41" * 8), F.lit("0200"), entry("0001", width), entry("0101", height))
    motorola = lambda tag, c: F.concat(F.lit(f"{tag}000400000001"), F.lit("0000"), pair(c))
    big = F.concat(F.lit("4D4D002A00000008"), F.lit("0002"), motorola("0100", width), motorola("0101", height))
    content = F.when(k % 5 == 1, png).when(k % 5 == 2, jpeg).when(k % 5 == 3, tiff).when(k % 5 == 4, big).otherwise(F.lit("41414141"))
    name = F.concat(F.lit("d"), (k % 10).cast("string"), F.lit("/"), k.cast("string"), F.when(k % 7 == 0, F.lit(".txt")).otherwise(F.lit(".IMG")))
    sinks.write_files(table(spark, sf, "supplier").select(name.alias("path"), F.unhex(content).alias("content")), path)
    found = headers.read_headers(spark, path, ".png,.img")
    return found.select(F.regexp_extract("path", "([0-9]+)[.]IMG$", 1).cast("bigint").alias("id"), "format", "width", "height")
