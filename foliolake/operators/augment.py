"""Augmentation kernels and the ordered chain of a page's recipe.

Every operation keeps the page size. Random values come from hashed seeds, so a page gives the same
pixels whatever the partitioning; JPEG stays in the plan as a parameter because its codec is outside
this package.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolake.constants import LIMITS, PRESETS
from foliolake.functions.rand import keyed_digest, unit_uniform
from foliolake.operators import stencil
from foliolake.operators.raster import PAGE, attach_page_values, byte_line, page_shape

PRIME = 2**31 - 1
MAX_RADIUS = LIMITS["blur"]["radius"][1]


def _rows(column: pa.Array, dtype) -> list[np.ndarray]:
    return [r.values.to_numpy(zero_copy_only=False).astype(dtype) for r in column]


def _list_array(rows: list[np.ndarray], type_: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=type_))


def _clip(values: np.ndarray) -> np.ndarray:
    return np.clip(stencil.to_level(values), 0, 255)


# --- blur -------------------------------------------------------------------------------------------


def blur_taps(sigma: float) -> np.ndarray:
    """True Gaussian taps out to three sigma."""
    reach = max(1, int(np.ceil(3 * sigma)))
    return stencil.gaussian_taps(2 * reach + 1, max(sigma, 1e-6))


def blur(scan: DataFrame, values: str = "values", sigma: str = "sigma") -> DataFrame:
    """Gaussian blur with a page-wide ``sigma`` column; edges are replicated. A sigma above the limit is refused."""
    wide = F.col(sigma) > MAX_RADIUS
    scan = scan.withColumn(sigma, F.when(wide, F.raise_error(F.lit(f"blur radius is above {MAX_RADIUS}"))).otherwise(F.col(sigma)))

    def kernel(planes):
        return {values: _clip(stencil.smooth(planes[values], blur_taps(float(planes["_sigma"][0, 0])), "edge"))}

    rows = scan.select(PAGE, "y", values, F.array(F.col(sigma).cast("double")).alias("_sigma"))
    return stencil.map_bands(rows, kernel, int(np.ceil(3 * MAX_RADIUS)), (values, "_sigma"), {values: "int"}, levels=(values,))


# --- noise ------------------------------------------------------------------------------------------


def noise_coefficients(seed: Column, y: Column) -> Column:
    """Eight 31-bit coefficients of one scanline, all from a single hash."""
    digest = keyed_digest(seed.cast("string"), "noise", y.cast("string"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint") % PRIME,
    )


def _normal(c: np.ndarray, width: int) -> np.ndarray:
    """Standard normal values of scanlines from their coefficients ``(rows, 8)``."""
    x = np.arange(1, width + 1, dtype=np.int64)[None, :]
    c = c.astype(np.int64)[:, :, None]
    first = (((c[:, 3] * x + c[:, 2]) % PRIME * x + c[:, 1]) % PRIME * x + c[:, 0]) % PRIME
    second = (((c[:, 7] * x + c[:, 6]) % PRIME * x + c[:, 5]) % PRIME * x + c[:, 4]) % PRIME
    return np.sqrt(-2 * np.log((first + 1) / PRIME)) * np.cos(2 * np.pi * (second / PRIME))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _add_noise(rows: pa.Array, coefficients: pa.Array, sigma: pa.Array) -> pa.Array:
    out = []
    for row, c, s in zip(_rows(rows, np.float64), _rows(coefficients, np.int64), sigma.to_pylist()):
        out.append(_clip(row + s * _normal(c[None, :], len(row))[0]))
    return _list_array(out, pa.int32())


def gaussian_noise(values: Column, seed: Column, sigma: Column) -> Column:
    """Additive Gaussian noise (Box-Muller over a hashed cubic sequence), rounded and clipped."""
    return _add_noise(values, noise_coefficients(seed, F.col("y")), sigma.cast("double"))


# --- illumination -----------------------------------------------------------------------------------


def light_grid(seed: Column, strength: Column, size: Column) -> Column:
    """``size`` x ``size`` seeded light levels in [1 - strength, 1], row by row."""
    level = lambda i: F.lit(1.0) - strength * unit_uniform(seed.cast("string"), "grid", i.cast("string"))
    return F.transform(F.sequence(F.lit(0), (size * size - 1).cast("int")), level)


def cubic_weights(position: np.ndarray, size: int, length: int) -> np.ndarray:
    """Bicubic weights (a = -0.5) of ``length`` output places over ``size`` grid cells, normalized."""
    centre = (position[:, None] + 0.5) * (size / length)
    d = np.abs(np.arange(size)[None, :] + 0.5 - centre)
    near, far = (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2
    w = np.where(d < 1, near, np.where(d < 2, far, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def _light(y: np.ndarray, height: int, width: int, cells: np.ndarray) -> np.ndarray:
    """Light field of the rows ``y`` from a flat square grid."""
    g = int(np.sqrt(len(cells)))
    return cubic_weights(y, g, height) @ cells.reshape(g, g) @ cubic_weights(np.arange(width), g, width).T


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _shade(rows: pa.Array, y: pa.Array, height: pa.Array, grid: pa.Array) -> pa.Array:
    out = []
    for row, at, tall, cells in zip(_rows(rows, np.float64), y.to_pylist(), height.to_pylist(), _rows(grid, np.float64)):
        out.append(_clip(row * _light(np.array([at]), tall, len(row), cells)[0]))
    return _list_array(out, pa.int32())


def uneven_illumination(values: Column, y: Column, height: Column, grid: Column) -> Column:
    """Multiply by a smooth light field interpolated from the page's grid."""
    return _shade(values, y, height, grid)


# --- stains -----------------------------------------------------------------------------------------


def stain_shapes(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Seeded ellipses in draw order for pages ``page_id, seed, height, width`` and stain parameters.

    Blobs come first, then speckles; every shape is one row, so a page with many of them spreads.
    """
    half_even = lambda c: F.rint(c)
    base = F.greatest(F.lit(1.0), F.least("height", "width") * F.col("blob_radius_fraction"))
    ink_limit = F.greatest(F.lit(1), half_even(F.col("opacity") * 255))
    speckles = half_even(F.col("height") * F.col("width") * F.col("speckle_density")).cast("int")
    total = F.col("blob_count").cast("int") + speckles
    shapes = pages.where(total > 0).withColumn("shape", F.explode(F.sequence(F.lit(1), total)))
    u = lambda tag: unit_uniform(F.col("seed").cast("string"), "stain", F.col("shape").cast("string"), tag)
    blob = F.col("shape") <= F.col("blob_count")
    ranged = lambda tag, low, high: F.lit(low) + u(tag) * (high - low)
    rx = F.when(blob, F.greatest(F.lit(1), half_even(base * ranged("rx", 0.7, 2.2)))).otherwise(F.floor(u("rx") * 2))
    ry = F.when(blob, F.greatest(F.lit(1), half_even(base * ranged("ry", 0.5, 1.8)))).otherwise(rx)
    strength = F.when(blob, ranged("ink", 0.55, 1.0)).otherwise(ranged("ink", 0.4, 1.0))
    return shapes.select(
        PAGE, "shape", F.floor(u("x") * F.col("width")).cast("int").alias("cx"), F.floor(u("y") * F.col("height")).cast("int").alias("cy"),
        rx.cast("int").alias("rx"), ry.cast("int").alias("ry"), F.greatest(F.lit(1), half_even(ink_limit * strength)).cast("int").alias("ink"),
        "height", *keep,
    )


def stain_spans(shapes: DataFrame, step: str | None = None) -> DataFrame:
    """Shapes as spans per row, flat ``step, x0, x1, ink`` in draw order.

    A group holds the shapes that touch one row of one page.
    """
    rows = shapes.withColumn("_step", F.lit(0) if step is None else F.col(step)).withColumn(
        "y", F.explode(F.sequence(F.greatest(F.col("cy") - F.col("ry"), F.lit(0)), F.least(F.col("cy") + F.col("ry"), F.col("height") - 1)))
    )
    slope = F.coalesce(F.try_divide((F.col("y") - F.col("cy")) * 1.0, F.col("ry")), F.lit(0.0))
    half = F.floor(F.col("rx") * F.sqrt(F.greatest(1 - slope * slope, F.lit(0.0))) + 1e-9).cast("int")
    cell = F.struct("shape", "_step", (F.col("cx") - half).alias("x0"), (F.col("cx") + half + 1).alias("x1"), "ink")
    spread = F.transform(F.array_sort(F.collect_list(cell)), lambda c: F.array(c["_step"], c["x0"], c["x1"], c["ink"]))
    return rows.groupBy(PAGE, "y").agg(F.flatten(spread).alias("spans"))


STAIN_PARAMETERS = ("opacity", "blob_count", "blob_radius_fraction", "speckle_density")


def stain_sigma(height: Column, width: Column, fraction: Column) -> Column:
    base = F.greatest(F.lit(1.0), F.least(height, width) * fraction)
    return F.rint(F.greatest(F.lit(0.5), base * 0.18) * 1e6) / 1e6


def stains(scan: DataFrame, pages: DataFrame, values: str = "values") -> DataFrame:
    """Ellipses drawn last-wins, softened, and subtracted from the page.

    ``pages`` has ``page_id, seed, height, width, opacity, blob_count, blob_radius_fraction,
    speckle_density`` for the pages to stain; the others come through unchanged. The softening radius follows
    the page size, and each page is banded with the halo of its own radius.
    """
    parameters = F.create_map(*[x for p in STAIN_PARAMETERS for x in (F.lit(p), F.col(p).cast("double"))])
    step = F.struct(F.lit(1).alias("order"), F.lit("stains").alias("family"), F.col("seed"), parameters.alias("parameters"))
    return _chained(scan, pages.select(PAGE, F.array(step).alias("degradations")), values)


# --- chain ------------------------------------------------------------------------------------------

PARAMETERS = ("radius", "sigma", "strength", "grid_size", *STAIN_PARAMETERS)
CODES = {"jpeg": 0, "blur": 1, "gaussian_noise": 2, "uneven_illumination": 3, "stains": 4}
_FACTS, _SPANS, _LINE = 0, 1, 2


def _recipe_facts(recipes: DataFrame, shape: DataFrame, ops: Column) -> DataFrame:
    """Per page: operation codes, one softening number per step, light grids, and its halo class.

    ``_reach`` is the power of two that holds the summed reach of the page's steps, ``_rows`` the height of its
    bands. Bands are at least twice as tall as a halo, so no line is copied more than once on average.
    """
    each = lambda f: F.transform("_ops", f)
    code = lambda o: F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), o["family"])
    soft = lambda o: stain_sigma(F.col("height"), F.col("width"), o["parameters"]["blob_radius_fraction"])
    number = lambda o: (
        F.when(o["family"] == "blur", o["parameters"]["radius"]).when(o["family"] == "gaussian_noise", o["parameters"]["sigma"])
        .when(o["family"] == "stains", soft(o)).otherwise(F.lit(0.0))
    )
    lit_up = lambda o: o["family"] == "uneven_illumination"
    grid = lambda o: F.when(lit_up(o), light_grid(o["seed"], o["parameters"]["strength"], o["parameters"]["grid_size"])).otherwise(
        F.array().cast("array<double>")
    )
    halo = F.aggregate(
        F.filter("_ops", lambda o: o["family"].isin("blur", "stains")), F.lit(0.0), lambda a, o: a + F.greatest(F.lit(1.0), F.ceil(number(o) * 3))
    )
    ordered = recipes.select(PAGE, ops.alias("_ops"))
    facts = ordered.join(shape, PAGE).select(
        PAGE, "height", "width", "_ops", each(code).alias("_codes"), each(number).alias("_numbers"), each(grid).alias("_grids"),
        each(lambda o: F.when(o["family"] == "gaussian_noise", o["seed"])).alias("_seeds"), halo.alias("_halo"),
    )
    reach = F.when(F.col("_halo") > 0, F.pow(F.lit(2), F.ceil(F.log2("_halo") - 1e-9))).otherwise(0).cast("int")
    return facts.withColumn("_reach", reach).withColumn("_rows", F.greatest(F.lit(stencil.BAND_ROWS), F.col("_reach") * 2))


def _recipe_stains(facts: DataFrame) -> DataFrame:
    """Stain spans of every step of every recipe."""
    ops = facts.select(PAGE, "height", "width", F.posexplode("_ops").alias("_step", "o")).where(F.col("o.family") == "stains")
    pages = ops.select(
        PAGE, "height", "width", "_step", F.col("o.seed").alias("seed"), *[F.col("o.parameters")[p].alias(p) for p in STAIN_PARAMETERS]
    )
    return stain_spans(stain_shapes(pages, ("_step",)), "_step")


def _masks(spans: pa.Table, step: int, y: np.ndarray, width: int) -> np.ndarray:
    """The stain mask of one step on the lines ``y``, painted from spans; the last shape wins."""
    mask = np.zeros((len(y), width), np.int32)
    for at, flat in zip(spans.column("y").to_pylist(), spans.column("spans")):
        row = at - int(y[0])
        if 0 <= row < len(y):
            for own, x0, x1, ink in np.array(flat.as_py(), np.int64).reshape(-1, 4):
                if own == step:
                    mask[row, max(x0, 0) : max(x1, 0)] = ink
    return mask


def _apply(facts: dict, lines: pa.Table, spans: pa.Table) -> np.ndarray:
    """All operations of one page's recipe on one band, in order."""
    values, y = stencil.plane_of(lines.column("values")), lines.column("y").to_numpy()
    width, draws, noise = values.shape[1], 8, None
    for step, (code, number) in enumerate(zip(facts["_codes"], facts["_numbers"])):
        if code == CODES["blur"]:
            values = _clip(stencil.smooth(values, blur_taps(number), "edge"))
        elif code == CODES["gaussian_noise"]:
            noise = stencil.plane_of(lines.column("noise")) if noise is None else noise
            values = _clip(values + number * _normal(noise[:, draws * step : draws * (step + 1)], width))
        elif code == CODES["uneven_illumination"]:
            values = _clip(values * _light(y, facts["height"], width, np.array(facts["_grids"][step])))
        elif code == CODES["stains"]:
            mask = _masks(spans, step, y, width)
            values = np.maximum(values - _clip(stencil.smooth(mask, blur_taps(number), "edge")), 0)
    return values


def _band_applied(table: pa.Table) -> pa.Table | None:
    """The own lines of one band after its page's recipe."""
    kind = table.column("kind").to_numpy()
    first_span, first_line = np.searchsorted(kind, [_SPANS, _LINE])
    facts = table.column("facts")[0].as_py() if first_span else None
    lines, band = table.slice(first_line), table.column("band")[0].as_py()
    if facts is None or not lines.num_rows:
        return None
    low, high = np.searchsorted(lines.column("y").to_numpy(), [band * facts["_rows"], (band + 1) * facts["_rows"]])
    if low == high:
        return None
    done = _apply(facts, lines, table.slice(first_span, first_line - first_span))
    own = lines.slice(low, high - low)
    return pa.table({PAGE: own.column(PAGE), "y": own.column("y"), "values": stencil.list_of(done[low:high], pa.int32())})


def _chained(scan: DataFrame, recipes: DataFrame, values: str, ops: Column | None = None) -> DataFrame:
    """Recipes applied in one band pass; lines, the facts of their page and its stain spans meet in a band."""
    ops = F.array_sort("degradations", lambda a, b: a["order"] - b["order"]) if ops is None else ops
    facts = _recipe_facts(recipes, page_shape(scan, values), ops)
    planned = recipes.select(PAGE).distinct().withColumn("_planned", F.lit(True))
    untouched = attach_page_values(scan.select(PAGE, "y", values), planned, how="left").where("_planned IS NULL").drop("_planned")
    narrow = facts.select(PAGE, "_reach", "_rows", "_seeds")

    def bands(rows: DataFrame) -> DataFrame:
        first = F.greatest(F.floor((F.col("y") - F.col("_reach")) / F.col("_rows")), F.lit(0))
        last = F.floor((F.col("y") + F.col("_reach")) / F.col("_rows"))
        return rows.withColumn("band", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_reach", "_rows", "_seeds")

    noise = F.flatten(F.transform(
        "_seeds", lambda s: F.when(s.isNotNull(), noise_coefficients(s, F.col("y"))).otherwise(F.array_repeat(F.lit(0).cast("bigint"), 8))
    ))
    noisy = F.exists("_seeds", lambda s: s.isNotNull())
    lines = attach_page_values(scan.select(PAGE, "y", byte_line(F.col(values)).alias("values")), narrow)
    lines = bands(lines.withColumn("noise", F.when(noisy, noise)).withColumn("kind", F.lit(_LINE)))
    spans = bands(attach_page_values(_recipe_stains(facts), narrow).withColumn("kind", F.lit(_SPANS)))
    number = F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / F.col("_rows")).cast("int")))
    head = facts.select(
        PAGE, F.lit(_FACTS).alias("kind"), F.struct("height", "_rows", "_codes", "_numbers", "_grids").alias("facts"), number.alias("band")
    )
    rows = lines.unionByName(spans, allowMissingColumns=True).unionByName(head, allowMissingColumns=True)
    schema = T.StructType([scan.schema[PAGE], scan.schema["y"], T.StructField("values", T.ArrayType(T.IntegerType()))])
    done = stencil.map_groups(rows, [PAGE, "band"], ["kind", "y"], lambda groups: [_band_applied(t) for t in groups], schema)
    return done.withColumnRenamed("values", values).unionByName(untouched)


#: Families whose pixels this package does not make.
UNAPPLIED = ("jpeg",)


def unapplied_steps(recipes: DataFrame) -> DataFrame:
    """(page_id, order, family) of the recipe steps that ``apply_recipes`` leaves out."""
    return recipes.select(PAGE, F.explode("degradations").alias("o")).where(F.col("o.family").isin(*UNAPPLIED)).select(
        PAGE, F.col("o.order").alias("order"), F.col("o.family").alias("family")
    )


def _bounds() -> Column:
    """(low, high) of every ``family.field``."""
    return F.create_map(*[
        item for family, fields in LIMITS.items() for field, (low, high) in fields.items()
        for item in (F.lit(f"{family}.{field}"), F.array(F.lit(float(low)), F.lit(float(high))))
    ])


def _out_of_bounds(bounds: Column, family: Column, field: Column, value: Column) -> Column:
    span = bounds[F.concat_ws(".", family, field)]
    return F.coalesce((value < span[0]) | (value > span[1]), F.lit(False))


def refused_steps(recipes: DataFrame) -> DataFrame:
    """(page_id, order, family, field, value) of parameters outside their limits, and of unknown families.

    Parameters that a family does not use are not looked at.
    """
    steps = recipes.select(PAGE, F.explode("degradations").alias("o"))
    each = steps.select(
        PAGE, F.col("o.order").alias("order"), F.col("o.family").alias("family"), F.explode_outer("o.parameters").alias("field", "value")
    )
    known = F.col("family").isin(*LIMITS)
    return each.where(~known | _out_of_bounds(_bounds(), F.col("family"), F.col("field"), F.col("value")))


def _checked_steps(steps: Column) -> Column:
    """``steps`` in their order; a step that ``refused_steps`` lists raises when the recipe is read."""
    bounds = _bounds()
    wrong = F.exists(steps, lambda o: ~o["family"].isin(*LIMITS) | F.exists(
        F.map_entries(o["parameters"]), lambda e: _out_of_bounds(bounds, o["family"], e["key"], e["value"])
    ))
    refused = F.raise_error(F.lit("recipe parameters are outside their limits; refused_steps lists them"))
    return F.when(F.coalesce(wrong, F.lit(False)), refused).otherwise(F.array_sort(steps, lambda a, b: a["order"] - b["order"]))


def apply_recipes(scan: DataFrame, recipes: DataFrame, values: str = "values") -> DataFrame:
    """Apply each page's ordered operations; pages without a recipe come through unchanged.

    Steps outside the limits of ``refused_steps`` raise when the pages are made. Steps of a family in
    ``UNAPPLIED`` are left out; ``unapplied_steps`` lists them.
    ``recipes`` has ``page_id, degradations array<struct<order,family,seed,parameters map<string,double>>>``.
    The whole chain of a page runs in one band pass with the summed reach of its own steps, so one page of long
    reach changes no other page's bands. Lines travel as bytes; page facts come once per band, and stain masks
    are painted from spans inside it.
    """
    return _chained(scan, recipes, values, _checked_steps(F.col("degradations")))


def recipe_details(recipes: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per step of a recipe, with the fields that follow from the page's size or from the family alone.

    ``sizes`` has ``page_id, height, width``. Stains tell how many speckles they have and how wide their edges
    are softened; uneven light is a smooth shadow field; JPEG is neither optimized nor progressive.
    """
    steps = recipes.join(sizes.select(PAGE, "height", "width"), PAGE, "left").select(PAGE, "height", "width", F.explode("degradations").alias("o"))
    of = lambda family, value: F.when(F.col("o.family") == family, value)
    number = lambda name: F.col("o.parameters")[name]
    return steps.select(
        PAGE, F.col("o.order").alias("order"), F.col("o.family").alias("family"), F.col("o.seed").alias("seed"), F.col("o.parameters").alias("parameters"),
        of("stains", F.rint(F.col("height") * F.col("width") * number("speckle_density")).cast("int")).alias("speckle_count"),
        of("stains", stain_sigma(F.col("height"), F.col("width"), number("blob_radius_fraction"))).alias("edge_blur_radius"),
        of("uneven_illumination", F.lit("smooth_shadow_field")).alias("kind"),
        of("jpeg", F.lit(False)).alias("optimize"), of("jpeg", F.lit(False)).alias("progressive"),
    )


def pixel_hash(scan: DataFrame, values: str = "values", fan: int = 1024) -> DataFrame:
    """One hash per page over mode, size and pixels, folded from scanline hashes.

    Hashing the whole pixel string would put a page in one row. Each line is hashed where it lies,
    ``fan`` line hashes fold into one, and the page folds those, so a group stays small.
    """
    line = F.sha2(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""), 256)
    lines = scan.select(PAGE, "y", F.size(values).alias("w"), line.alias("h"))

    def joined(key: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda r: r["h"]), "")

    folds = lines.groupBy(PAGE, F.floor(F.col("y") / fan).alias("fold")).agg(
        F.max("w").alias("w"), (F.max("y") + 1).alias("rows"), F.sha2(joined("y"), 256).alias("h")
    )
    head = F.concat(F.lit("L|"), F.max("w").cast("string"), F.lit("x"), F.max("rows").cast("string"), F.lit("|"))
    return folds.groupBy(PAGE).agg(F.sha2(F.concat(head, joined("fold")), 256).alias("pixel_sha256"))


def image_hash(images: DataFrame, page_id: str = PAGE) -> DataFrame:
    """Pixel hash of gray images held in Spark's image struct: mode, size and bytes in one SHA-256."""
    head = F.concat(F.lit("L\0"), F.col("image.width").cast("string"), F.lit("x"), F.col("image.height").cast("string"), F.lit("\0"))
    return images.select(page_id, F.sha2(F.concat(head.cast("binary"), F.col("image.data")), 256).alias("pixel_sha256"))


def augment(scan: DataFrame, samples: DataFrame, config: str = "medium", seed: int = 0) -> DataFrame:
    """Plan and apply a preset's augmentation to pages: ``samples`` gives ``page_id`` and maybe its own ``seed``.

    The one call most users need; use the plan and ``apply_recipes`` apart to keep the recipe.
    """
    from foliolake.functions.rand import seed63
    from foliolake.plans.augment import augmentation_plan, preset_config

    if config not in PRESETS:
        raise ValueError(f"unknown preset {config!r}; expected one of: {', '.join(PRESETS)}")
    families, ranges = preset_config(F.lit(config))
    own = F.col("seed") if "seed" in samples.columns else seed63(seed, F.col(PAGE).cast("string"))
    planned = augmentation_plan(samples.select(PAGE, own.alias("seed")), families, ranges)
    return apply_recipes(scan, planned.select(PAGE, "degradations"))
