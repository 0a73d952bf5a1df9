"""Manifest rules: every problem of every row becomes an error row, nothing stops at the first one.

A rule is (name, message, failing condition) over a parsed line, so all rules of a line are checked in
one pass inside the scanning stage. Only the rules that compare lines with each other shuffle, and they
shuffle small per-key facts that are dealt out again over copies, so a hot id or source cannot pile up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import (
    ARTIFACT_ROLES, CLASSES, DISTRIBUTABLE, MANIFEST_SCHEMA_VERSION, REQUIRED_ASSET_TEXT, REQUIRED_RENDER_FIELDS,
    REQUIRED_SAMPLE_FIELDS, SPLITS,
)
from foliolake.functions.paths import is_confined, is_http_url
from foliolake.operators.raster import attach_page_values
from foliolake.session import checkpointed, shared

Rule = tuple[str, Column, Column]
LINE = ("file", "line_no")


def rule(name: str, message: str | Column, failing: Column) -> Rule:
    return name, message if isinstance(message, Column) else F.lit(message), F.coalesce(failing, F.lit(True))


def rule_rows(rows: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per broken rule."""
    found = [
        F.when(bad, F.struct(F.lit(name).alias("rule"), message.alias("message"))) for name, message, bad in rules
    ]
    return rows.select(*keys, F.inline(F.array_compact(F.array(*found))))


# --- parsed lines -----------------------------------------------------------------------------------

DOC, RAW = "doc", "raw"
_MAP = "map<string,string>"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds the line as VARIANT, which keeps the JSON types a typed read would coerce away, and as raw fields.

    These two are the only times that a line is parsed; every rule reads one of them.
    """
    return lines.withColumns({DOC: F.try_parse_json("value"), RAW: F.from_json("value", _MAP)})


def field(path: str) -> Column:
    return F.try_variant_get(F.col(DOC), f"$.{path}", "variant")


def kind(path: str) -> Column:
    return F.schema_of_variant(field(path))


def text(path: str) -> Column:
    """The string at ``path``, NULL when it is missing or not a string."""
    return F.when(kind(path) == "STRING", F.try_variant_get(F.col(DOC), f"$.{path}", "string"))


def raw(path: str) -> Column:
    """The JSON text at ``path``; the fields of an object inside come from its own text, not from the line."""
    head, _, rest = path.partition(".")
    return F.from_json(F.col(RAW)[head], _MAP)[rest] if rest else F.col(RAW)[head]


def integer(path: str) -> Column:
    """The integer at ``path``; booleans and 1.0 are not integers."""
    number = kind(path).rlike(r"^(BIGINT|DECIMAL)")
    whole = F.coalesce(number & raw(path).rlike(r"^-?\d+$"), F.lit(False))
    return F.when(whole, F.try_variant_get(F.col(DOC), f"$.{path}", "decimal(38,0)"))


def is_object(path: str) -> Column:
    return F.coalesce(kind(path).startswith("OBJECT"), F.lit(False))


def object_keys(path: str | None = None) -> Column:
    source = F.col(RAW) if path is None else F.try_variant_get(F.col(DOC), f"$.{path}", "map<string,variant>")
    return F.coalesce(F.map_keys(source), F.array().cast("array<string>"))


def nonempty(path: str) -> Column:
    return F.length(text(path)) > 0


def structural_problems(lines: DataFrame) -> DataFrame:
    """Blank lines, broken JSON and lines that are not objects."""
    blank = F.col("value").rlike(r"^\s*$")
    broken = ~blank & F.col(DOC).isNull()
    other = F.col(DOC).isNotNull() & ~F.schema_of_variant(DOC).startswith("OBJECT")
    return rule_rows(
        parse_lines(lines), LINE,
        [
            rule("blank_line", "blank JSONL lines are not allowed", blank),
            rule("invalid_json", "invalid JSON", broken),
            rule("not_object", "record must be an object", other),
        ],
    )


def missing_fields(required: Sequence[str], path: str | None = None) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(f) for f in required]), object_keys(path)))


def _rights_rules(name: str) -> list[Rule]:
    where = f"source_provenance.{name}"
    mapping = is_object(where)
    status_ok = F.coalesce(text(f"{where}.status").isin(*DISTRIBUTABLE), F.lit(False))
    basis_ok = F.coalesce(F.length(F.trim(text(f"{where}.basis"))) > 0, F.lit(False))
    provenance = is_object("source_provenance")
    return [
        rule("rights_mapping", f"{where} must be a mapping", provenance & ~mapping),
        rule("rights_status", f"{where}.status is not distributable", provenance & mapping & ~status_ok),
        rule("rights_basis", f"{where}.basis is required", provenance & mapping & status_ok & ~basis_ok),
    ]


def timestamp_ok(value: Column) -> Column:
    """Parseable ISO-8601 with a zone."""
    zoned = value.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.coalesce(F.try_to_timestamp(value).isNotNull() & zoned, F.lit(False))


PROVENANCE_FIELDS = ("source_url", "composition_rights", "source_file_rights", "verified_date")


def sample_rules() -> list[Rule]:
    """All rules that look at one record only."""
    masks_ok = F.col("masks_ok")
    width, height = integer("dimensions.width"), integer("dimensions.height")
    dimensions_ok = F.coalesce(is_object("dimensions") & (width > 0) & (height > 0), F.lit(False))
    provenance = is_object("source_provenance")
    absent = missing_fields(PROVENANCE_FIELDS, "source_provenance")
    rules = [
        *[rule(f"{f}_text", f"{f} must be a nonempty string", ~nonempty(f)) for f in ("sample_id", "dataset_id", "source_id")],
        rule("split", f"split must be one of {', '.join(SPLITS)}", ~text("split").isin(*SPLITS)),
        rule("dimensions", "dimensions must contain positive integer width and height", ~dimensions_ok),
        rule("degradations", "degradations must be a list", ~kind("degradations").startswith("ARRAY")),
        rule("schema_version", f"schema_version must be {MANIFEST_SCHEMA_VERSION}", integer("schema_version") != MANIFEST_SCHEMA_VERSION),
        rule("license_status", "source_license_status is not distributable", ~text("source_license_status").isin(*DISTRIBUTABLE)),
        rule("source_sha256", "source_sha256 must be lowercase SHA-256", ~text("source_sha256").rlike("^[0-9a-f]{64}$")),
        *[rule(f, f"{f} must be a positive integer", integer(f) < 1) for f in ("page", "dpi")],
        rule("seed", "seed must be an integer", integer("seed").isNull()),
        *[
            rule(f"{f}_text", f"{f} must be a nonempty string", ~nonempty(f))
            for f in ("generator_version", "lilypond_version", "degradation_preset")
        ],
        rule(
            "render_parameters", "render_parameters is incomplete",
            ~is_object("render_parameters") | (F.size(missing_fields(REQUIRED_RENDER_FIELDS, "render_parameters")) > 0),
        ),
        rule("created_at_text", "created_at must be an ISO-8601 string", text("created_at").isNull()),
        rule(
            "created_at_zone", "created_at must be a timezone-aware ISO-8601 timestamp",
            text("created_at").isNotNull() & ~timestamp_ok(text("created_at")),
        ),
        rule("provenance", "source_provenance must be a mapping", ~provenance),
        *[
            rule("provenance_fields", f"source_provenance requires {f}", provenance & F.array_contains(absent, f))
            for f in PROVENANCE_FIELDS
        ],
        *_rights_rules("composition_rights"), *_rights_rules("source_file_rights"),
        rule("mask_paths", "mask_paths must contain exactly background, notation, staff, text", ~masks_ok),
        rule("hashes", "hashes must be a mapping", masks_ok & ~is_object("hashes")),
    ]
    for role in ARTIFACT_ROLES:
        path = text(artifact_field(role))
        given = F.coalesce(F.length(path) > 0, F.lit(False))
        rules.append(rule("path_text", f"{role} path must be a nonempty string", masks_ok & ~given))
        rules.append(rule("path_confined", f"{role} path must stay inside the dataset", masks_ok & given & ~is_confined(path)))
        hash_ok = F.coalesce(F.length(text(f"hashes.{role}")) == 64, F.lit(False))
        rules.append(
            rule("hash_text", f"hashes.{role} must be a SHA-256 string", masks_ok & given & is_confined(path) & ~hash_ok)
        )
    return rules


def mask_keys_ok() -> Column:
    """The mask mapping has exactly the four classes."""
    wanted = F.array(*[F.lit(c) for c in sorted(CLASSES)])
    return is_object("mask_paths") & (F.array_sort(object_keys("mask_paths")) == wanted)


def artifact_field(role: str) -> str:
    named = {"input": "input_path", "clean": "clean_target_path", "recipe": "recipe_path"}
    return named.get(role) or f"mask_paths.{role.removeprefix('mask_')}"


def complete_records(lines: DataFrame) -> DataFrame:
    """Object lines with their missing fields; a line that lacks fields skips every other rule."""
    parsed = parse_lines(lines)
    objects = parsed.where(F.col(DOC).isNotNull() & F.schema_of_variant(DOC).startswith("OBJECT"))
    return objects.withColumns({"missing": missing_fields(REQUIRED_SAMPLE_FIELDS), "masks_ok": mask_keys_ok()})


def record_problems(lines: DataFrame) -> DataFrame:
    """Problems visible in one record."""
    records = complete_records(lines)
    absent = rule_rows(
        records.where(F.size("missing") > 0), LINE,
        [rule("missing_fields", F.concat(F.lit("missing fields: "), F.array_join("missing", ", ")), F.lit(True))],
    )
    return absent.unionByName(rule_rows(records.where(F.size("missing") == 0), LINE, sample_rules()))


def repeated_ids(rows: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """Rows that repeat an earlier row's key; the first occurrence is not reported."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return attach_page_values(rows, first, keys, deal=order).where(F.col(order) > F.col("_first")).drop("_first", "_n")


def cross_record_problems(lines: DataFrame) -> DataFrame:
    """Duplicate ids, changing dataset ids and sources that span splits, judged in line order."""
    # Five short columns are kept, so that six readers do not parse every line again.
    records = checkpointed(complete_records(lines).where(F.size("missing") == 0).select(
        *LINE, text("sample_id").alias("sample_id"), text("dataset_id").alias("dataset_id"),
        text("source_id").alias("source_id"), text("split").alias("split"),
    ))
    as_row = lambda df, name, message: df.select(*LINE, F.lit(name).alias("rule"), message.alias("message"))
    ids = records.where(F.length("sample_id") > 0)
    repeated = repeated_ids(ids, ("file", "sample_id"))
    dated = records.where(F.length("dataset_id") > 0)
    first_dataset = dated.groupBy("file").agg(F.min_by("dataset_id", "line_no").alias("_first"))
    changed = attach_page_values(dated, first_dataset, ("file",), deal="line_no").where(F.col("dataset_id") != F.col("_first"))
    placed = records.where(F.col("split").isin(*SPLITS) & F.col("source_id").isNotNull())
    first_split = placed.groupBy("file", "source_id").agg(
        F.min_by("split", "line_no").alias("_first"), F.min("split").alias("_lo"), F.max("split").alias("_hi")
    ).where("_lo <> _hi")
    spans = attach_page_values(placed, first_split, ("file", "source_id"), deal="line_no").where(F.col("split") != F.col("_first"))
    return (
        as_row(repeated, "duplicate_sample", F.concat(F.lit("duplicate sample_id "), "sample_id"))
        .unionByName(as_row(changed, "dataset_changed", F.lit("dataset_id differs from earlier records")))
        .unionByName(
            as_row(spans, "source_spans", F.concat(F.lit("source "), "source_id", F.lit(" spans splits "), "_first", F.lit(" and "), "split"))
        )
    )


def artifacts(lines: DataFrame) -> DataFrame:
    """Declared artifacts of complete records: ``file, line_no, role, path, sha256, width, height``."""
    records = complete_records(lines).where((F.size("missing") == 0) & F.col("masks_ok"))
    cells = F.array(
        *[
            F.struct(F.lit(r).alias("role"), text(artifact_field(r)).alias("path"), text(f"hashes.{r}").alias("sha256"))
            for r in ARTIFACT_ROLES
        ]
    )
    width, height = integer("dimensions.width").cast("int"), integer("dimensions.height").cast("int")
    sane = (width > 0) & (height > 0)
    size = (F.when(sane, width).alias("width"), F.when(sane, height).alias("height"))
    return records.select(*LINE, *size, F.inline(cells))


def artifact_problems(declared: DataFrame, stored: DataFrame, verify_hashes: bool = True) -> DataFrame:
    """Missing files, hash mismatches and size differences against a stored listing.

    With ``verify_hashes=False`` the stored hash is never referenced, so file contents are not read.
    """
    usable = declared.where((F.length("path") > 0) & is_confined(F.col("path")))
    columns = ["path", F.col("width").alias("stored_width"), F.col("height").alias("stored_height"), F.lit(True).alias("found")]
    if verify_hashes:
        columns.append(F.col("sha256").alias("stored_sha256"))
    joined = usable.join(stored.select(*columns), "path", "left")
    found = F.coalesce("found", F.lit(False))
    sized = (F.col("role") != "recipe") & F.col("width").isNotNull() & F.col("height").isNotNull()
    differs = ~(F.col("width").eqNullSafe(F.col("stored_width")) & F.col("height").eqNullSafe(F.col("stored_height")))
    rules = [
        rule("artifact_missing", F.concat("role", F.lit(" artifact does not exist: "), "path"), ~found),
        rule("artifact_size", F.concat("role", F.lit(" dimensions differ from manifest")), found & sized & differs),
    ]
    if verify_hashes:
        known = F.coalesce(F.length("sha256") == 64, F.lit(False))
        wrong = known & ~F.col("sha256").eqNullSafe(F.col("stored_sha256"))
        rules.append(rule("artifact_hash", F.concat(F.lit("hashes."), "role", F.lit(" mismatch for "), "path"), found & wrong))
    return rule_rows(joined, LINE, rules)


def reusable_records(declared: DataFrame, stored: DataFrame, expected: int = len(ARTIFACT_ROLES)) -> DataFrame:
    """Records whose every artifact is declared, present and hash-equal."""
    joined = declared.join(stored.select("path", F.col("sha256").alias("stored_sha256")), "path", "left")
    good = F.coalesce((F.length("sha256") == 64) & is_confined(F.col("path")) & (F.col("sha256") == F.col("stored_sha256")), F.lit(False))
    return joined.groupBy(*LINE).agg((F.bool_and(good) & (F.count(F.lit(1)) == expected)).alias("reusable"))


def metadata_problems(lines: DataFrame, metadata: DataFrame) -> DataFrame:
    """Dataset metadata against the records of its manifest: version, count, id and source splits.

    ``metadata`` has ``file`` and the metadata columns. A manifest without metadata is a problem too. The source map is compared entry by entry.
    """
    records = complete_records(lines)
    counted = records.groupBy("file").agg(F.count(F.lit(1)).alias("records"))
    full = records.where(F.size("missing") == 0).select(
        *LINE, text("dataset_id").alias("dataset_id"), text("source_id").alias("source_id"), text("split").alias("split")
    )
    named = full.where(F.length("dataset_id") > 0).groupBy("file").agg(F.min_by("dataset_id", "line_no").alias("first_id"))
    seen = full.where(F.col("split").isin(*SPLITS) & F.col("source_id").isNotNull()).groupBy("file", "source_id").agg(
        F.min_by("split", "line_no").alias("split")
    )
    told = metadata.select("file", F.explode("source_splits").alias("source_id", "told_split"))
    odd = (
        seen.join(told, ["file", "source_id"], "full")
        .where(~F.col("split").eqNullSafe(F.col("told_split")))
        .groupBy("file").agg(F.count(F.lit(1)).alias("odd"))
    )
    joined = metadata.withColumn("_told", F.lit(True)).join(counted, "file", "full").join(named, "file", "left").join(odd, "file", "left")
    told = F.col("_told").isNotNull()
    return rule_rows(
        joined, ("file",),
        [
            rule("metadata_missing", "dataset metadata is missing or is not an object", ~told),
            rule("metadata_version", f"dataset metadata schema_version must be {MANIFEST_SCHEMA_VERSION}", told & ~F.col("schema_version").eqNullSafe(F.lit(MANIFEST_SCHEMA_VERSION))),
            rule("metadata_count", "dataset metadata sample_count does not match the records", told & ~F.col("sample_count").eqNullSafe(F.coalesce("records", F.lit(0)))),
            rule("metadata_id", "dataset metadata dataset_id does not match the records", told & F.col("first_id").isNotNull() & ~F.col("dataset_id").eqNullSafe(F.col("first_id"))),
            rule("metadata_splits", "dataset metadata source_splits does not match the records", told & (F.coalesce("odd", F.lit(0)) > 0)),
        ],
    )


def manifest_problems(lines: DataFrame) -> DataFrame:
    """Structural problems, and the record problems of files that have none."""
    lines = shared(lines)
    structural = checkpointed(structural_problems(lines))
    broken = structural.select("file").distinct()
    sound = record_problems(lines).unionByName(cross_record_problems(lines)).join(broken, "file", "left_anti")
    return structural.unionByName(sound)


# --- assets -----------------------------------------------------------------------------------------


def _asset_rights_rules(name: str) -> list[Rule]:
    rights, part = F.col(name), lambda f: F.col(f"{name}.{f}")
    present = rights.isNotNull()
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    licensed = F.coalesce(part("status") == "compatible_license", F.lit(False))
    return [
        rule("rights_mapping", f"{name} must be a mapping with explicit status and basis", ~present),
        rule("rights_status_text", f"{name}.status must be a nonempty string", present & blank(part("status"))),
        rule("rights_basis_text", f"{name}.basis must be a nonempty string", present & blank(part("basis"))),
        rule("rights_status", f"{name}.status is not distributable", present & ~blank(part("status")) & ~part("status").isin(*DISTRIBUTABLE)),
        rule("license_text", f"{name}.license must be a nonempty string when present", part("license").isNotNull() & blank(part("license"))),
        rule("license_url", f"{name}.license_url must be an absolute HTTP(S) URL when present", part("license_url").isNotNull() & ~is_http_url(part("license_url"))),
        rule("license_needed", f"{name}.license is required for compatible_license", licensed & blank(part("license"))),
        rule("license_url_needed", f"{name}.license_url is required for compatible_license", licensed & ~is_http_url(part("license_url"))),
    ]


def strict_date_ok(value: Column) -> Column:
    """Exactly YYYY-MM-DD and a real day."""
    return F.coalesce(value.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))


def asset_rules(suffix: str = ".ly") -> list[Rule]:
    blank = lambda f: F.coalesce(F.trim(F.col(f)) == "", F.lit(True))
    given = lambda f: ~blank(f)
    inside = is_confined(F.col("source_file"))
    return [
        *[rule(f"{f}_text", f"{f} must be a nonempty string", blank(f)) for f in REQUIRED_ASSET_TEXT],
        *_asset_rights_rules("composition_rights"), *_asset_rights_rules("source_file_rights"),
        rule("verified_date", "verified_date must use a valid YYYY-MM-DD date", ~strict_date_ok(F.col("verified_date"))),
        rule("source_url", "source_url must be an absolute HTTP(S) URL", given("source_url") & ~is_http_url(F.col("source_url"))),
        rule("source_sha256", "source_sha256 must be 64 lowercase hexadecimal characters", given("source_sha256") & ~F.col("source_sha256").rlike("^[0-9a-f]{64}$")),
        rule("source_path", "source_file must stay within the manifest directory", given("source_file") & ~inside),
        rule("source_suffix", f"source_file must reference a {suffix} file", given("source_file") & inside & ~F.col("source_file").endswith(suffix)),
    ]


def asset_problems(assets: DataFrame, stored: DataFrame | None = None, suffix: str = ".ly") -> DataFrame:
    """Problems of asset rows ``(file, line_no, ...)``; with ``stored (path, sha256)`` files are checked too.

    As in a sequential read, duplicates are looked for among assets that are otherwise sound.
    """
    rows, rules = assets, asset_rules(suffix)
    if stored is not None:
        held = stored.select(F.col("path").alias("source_file"), F.col("sha256").alias("stored_sha256"))
        rows = assets.join(held, "source_file", "left")
        usable = is_confined(F.col("source_file")) & F.col("source_file").endswith(suffix)
        found = F.col("stored_sha256").isNotNull()
        rules = [
            *rules,
            rule("source_missing", F.concat(F.lit("source_file does not exist: "), "source_file"), usable & ~found),
            rule("source_hash", F.concat(F.lit("source_sha256 mismatch for "), "source_file"), usable & found & (F.col("source_sha256") != F.col("stored_sha256"))),
        ]
    own = rule_rows(rows, LINE, rules)
    sound = assets.join(own.select(*LINE).distinct(), list(LINE), "left_anti")
    twice = lambda key: repeated_ids(sound, ("file", key)).select(
        *LINE, F.lit(f"duplicate_{key}").alias("rule"), F.concat(F.lit(f"{key} duplicates "), key).alias("message")
    )
    return own.unionByName(twice("id")).unionByName(twice("source_file"))


def catalogue_problems(works: DataFrame, expected: int, required: Sequence[str]) -> DataFrame:
    """Catalogue rules: exact number of works, required values, unique ids."""
    counted = works.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select(
        F.lit("work_count").alias("rule"), F.concat(F.lit(f"expected {expected} works, found "), F.col("n").cast("string")).alias("message")
    )
    absent = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]))
    lacking = works.select(absent.alias("absent"), "id").where(F.size("absent") > 0).select(
        F.lit("required_fields").alias("rule"),
        F.concat(F.coalesce("id", F.lit("?")), F.lit(" lacks "), F.array_join("absent", ", ")).alias("message"),
    )
    twice = works.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_id").alias("rule"), F.concat("id", F.lit(" occurs more than once")).alias("message")
    )
    return counted.unionByName(lacking).unionByName(twice)


def lacks_markers(text_column: Column, markers: Sequence[str]) -> Column:
    """True when a source text misses one of the (case-insensitive) markers."""
    lowered, missing = F.lower(text_column), F.lit(False)
    for marker in markers:
        missing = missing | ~F.contains(lowered, F.lit(marker.lower()))
    return missing
