"""Manifest, asset and catalogue rules on records built from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog.planning import S, docs, key, vsql
from foliolake.catalog.rasters import SEED, WEIGHTS, split_sql
from foliolake.catalog.registry import query, spread, table
from foliolake.constants import ARTIFACT_ROLES, CATALOGUE_FIELDS, CLASSES
from foliolake.operators import validation
from foliolake.plans.splits import split_of



def role_path(role: str):
    return F.concat(F.lit(f"{role}/s"), key("doc_id"), F.lit(".json" if role == "recipe" else ".png"))


def manifest_lines(spark, sf):
    """One manifest per document source; every record but each 23rd carries one defect."""
    q = lambda text: F.lit(f'"{text}"')
    raw = lambda text: F.lit(text)
    bad = lambda m, wrong, right: F.when(F.col("doc_id") % 23 == m, wrong).otherwise(right)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    host = F.concat(F.lit("host-"), (F.col("doc_id") % 40).cast("string"))
    split = F.when(F.col("doc_id") % 31 == 0, F.lit("train")).otherwise(split_of(host, WEIGHTS, SEED))
    sha = F.sha2(F.concat(key("doc_id"), F.lit("src")), 256)
    rights = lambda status, basis: F.concat(F.lit('{"status":"'), status, F.lit('","basis":"'), basis, F.lit('"}'))
    ok_rights = rights(F.lit("public_domain"), F.lit("old"))
    provenance = F.concat(
        F.lit('{"source_url":"https://example.org/x","composition_rights":'),
        bad(7, rights(F.lit("unresolved"), F.lit("old")), ok_rights), F.lit(',"source_file_rights":'),
        bad(22, rights(F.lit("public_domain"), F.lit("  ")), ok_rights),
        bad(21, F.lit("}"), F.lit(',"verified_date":"2026-08-13"}')),
    )
    masks = F.concat(
        F.lit("{"), F.array_join(
            F.array_compact(F.array(*[
                (bad(10, F.lit(None).cast("string"), F.concat(F.lit(f'"{c}":"'), role_path("mask_" + c), F.lit('"'))) if c == "text"
                 else F.concat(F.lit(f'"{c}":"'), role_path("mask_" + c), F.lit('"'))) for c in CLASSES
            ])), ","), F.lit("}"),
    )
    digest = lambda r: F.sha2(F.concat(key("doc_id"), F.lit(r)), 256)
    hashes = F.concat(
        F.lit("{"), F.array_join(F.array(*[
            F.concat(F.lit(f'"{r}":"'), bad(11, F.lit("abc"), digest(r)) if r == "input" else digest(r), F.lit('"')) for r in ARTIFACT_ROLES
        ]), ","), F.lit("}"),
    )
    null = F.lit(None).cast("string")
    render = F.concat(
        F.lit('{"staff_size":16.0,"paper_format":"a4","orientation":"portrait","margins_mm":{"top":1.0},"dpi":300,"mask_threshold":0.5,"strict_unknown_grobs":true'),
        bad(13, F.lit("}"), F.lit(',"layout_seed":18446744073709551615}')),
    )
    fields = {
        "schema_version": bad(20, raw("2"), raw("1")),
        "sample_id": F.when(F.col("doc_id") % 23 == 14, q("")).when(F.col("doc_id") % 23 == 15, q("dup")).otherwise(quoted(F.concat(F.lit("s"), key("doc_id")))),
        "dataset_id": bad(16, q("other"), q("demo")),
        "source_id": quoted(host), "source_path": q("a.ly"),
        "source_sha256": quoted(bad(9, F.upper(F.concat(F.lit("a"), F.substring(sha, 2, 63))), sha)),
        "source_license_status": bad(19, q("none"), q("public_domain")),
        "source_provenance": provenance,
        "page": F.when(F.col("doc_id") % 23 == 1, raw("0")).when(F.col("doc_id") % 23 == 2, raw("true")).otherwise(raw("3")),
        "split": bad(4, q("dev"), quoted(split)),
        "generator_version": q("0.1"), "lilypond_version": q("2.26.0"),
        "seed": bad(8, null, raw("9223372036854775807")),
        "render_parameters": render, "degradation_preset": q("light"),
        "degradations": bad(17, raw("{}"), raw("[]")),
        "input_path": bad(12, q("../x.png"), quoted(role_path("input"))),
        "clean_target_path": quoted(role_path("clean")), "mask_paths": masks,
        "recipe_path": quoted(role_path("recipe")), "hashes": hashes,
        "dimensions": bad(5, raw('{"width":0,"height":50}'), raw('{"width":64,"height":50}')),
        "dpi": F.when(F.col("doc_id") % 23 == 8, null).when(F.col("doc_id") % 23 == 3, raw("1.0")).otherwise(raw("300")),
        "created_at": F.when(F.col("doc_id") % 23 == 6, q("2026-08-13T00:00:00")).when(F.col("doc_id") % 23 == 18, raw("5")).otherwise(q("2026-08-13T00:00:00Z")),
    }
    pieces = F.array_compact(F.array(*[F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]))
    text = F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))
    records = spread(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return records.select(F.col("source").alias("file"), F.col("doc_id").alias("line_no"), text.alias("value"))


EXPECTED = """(VALUES
  (1, 'page', 'page must be a positive integer'), (2, 'page', 'page must be a positive integer'),
  (3, 'dpi', 'dpi must be a positive integer'), (4, 'split', 'split must be one of train, validation, test, challenge'),
  (5, 'dimensions', 'dimensions must contain positive integer width and height'),
  (6, 'created_at_zone', 'created_at must be a timezone-aware ISO-8601 timestamp'),
  (7, 'rights_status', 'source_provenance.composition_rights.status is not distributable'),
  (8, 'missing_fields', 'missing fields: dpi, seed'), (9, 'source_sha256', 'source_sha256 must be lowercase SHA-256'),
  (10, 'mask_paths', 'mask_paths must contain exactly background, notation, staff, text'),
  (11, 'hash_text', 'hashes.input must be a SHA-256 string'), (12, 'path_confined', 'input path must stay inside the dataset'),
  (13, 'render_parameters', 'render_parameters is incomplete'), (14, 'sample_id_text', 'sample_id must be a nonempty string'),
  (17, 'degradations', 'degradations must be a list'), (18, 'created_at_text', 'created_at must be an ISO-8601 string'),
  (19, 'license_status', 'source_license_status is not distributable'), (20, 'schema_version', 'schema_version must be 1'),
  (21, 'provenance_fields', 'source_provenance requires verified_date'),
  (22, 'rights_basis', 'source_provenance.source_file_rights.basis is required')) e(m, rule, message)"""
RECORD_SQL = f"SELECT source AS file, doc_id AS line_no, rule, message FROM documents JOIN {EXPECTED} ON m = doc_id % 23"

CROSS = f"""
recs AS (
  SELECT source AS file, doc_id AS line_no, CASE doc_id % 23 WHEN 14 THEN '' WHEN 15 THEN 'dup' ELSE 's' || doc_id END AS sample_id,
         CASE WHEN doc_id % 23 = 16 THEN 'other' ELSE 'demo' END AS dataset_id, 'host-' || (doc_id % 40) AS source_id,
         CASE WHEN doc_id % 23 = 4 THEN NULL WHEN doc_id % 31 = 0 THEN 'train' ELSE {split_sql("'host-' || (doc_id % 40)")} END AS split
  FROM documents WHERE doc_id % 23 <> 8
),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY file, sample_id ORDER BY line_no) AS occurrence,
         first_value(dataset_id) OVER (PARTITION BY file ORDER BY line_no) AS first_dataset FROM recs
),
spans AS (SELECT *, first_value(split) OVER (PARTITION BY file, source_id ORDER BY line_no) AS first_split FROM recs WHERE split IS NOT NULL)"""
CROSS_SQL = """
SELECT file, line_no, 'duplicate_sample' AS rule, 'duplicate sample_id ' || sample_id AS message FROM firsts WHERE sample_id <> '' AND occurrence > 1
UNION ALL SELECT file, line_no, 'dataset_changed', 'dataset_id differs from earlier records' FROM firsts WHERE dataset_id <> first_dataset
UNION ALL SELECT file, line_no, 'source_spans', 'source ' || source_id || ' spans splits ' || first_split || ' and ' || split FROM spans WHERE split <> first_split"""


@query("record_rule_problems", sql=RECORD_SQL)
def record_rule_problems(spark, sf):
    return validation.record_problems(manifest_lines(spark, sf))


@query("cross_record_problems", sql=f"WITH {CROSS} {CROSS_SQL}")
def cross_record_problems(spark, sf):
    return validation.cross_record_problems(manifest_lines(spark, sf))


def event_lines(spark, sf):
    """Event properties as JSONL lines with some blank, broken and non-object ones."""
    e = F.col("event_id")
    value = (
        F.when(e % 17 == 0, F.lit("  ")).when(e % 19 == 0, F.concat(F.lit("{"), F.col("props")))
        .when(e % 13 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(e % 29 == 0, F.lit("null")).otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select(F.col("event_type").alias("file"), e.alias("line_no"), value.alias("value"))


STRUCTURAL_SQL = """
SELECT event_type AS file, event_id AS line_no,
  CASE WHEN event_id % 17 = 0 THEN 'blank_line' WHEN event_id % 19 = 0 THEN 'invalid_json' ELSE 'not_object' END AS rule,
  CASE WHEN event_id % 17 = 0 THEN 'blank JSONL lines are not allowed' WHEN event_id % 19 = 0 THEN 'invalid JSON' ELSE 'record must be an object' END AS message
FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 13 = 0 OR event_id % 29 = 0"""


@query("structural_problems", sql=STRUCTURAL_SQL)
def structural_problems(spark, sf):
    return validation.structural_problems(event_lines(spark, sf))


@query(
    "manifest_problems",
    sql=f"WITH {CROSS}, every AS ({RECORD_SQL} UNION ALL {CROSS_SQL}), broken AS (SELECT DISTINCT source FROM documents WHERE doc_id % 50 = 7) "
    "SELECT * FROM every WHERE file NOT IN (SELECT source FROM broken) "
    "UNION ALL SELECT source, 1000000000 + doc_id, 'invalid_json', 'invalid JSON' FROM documents WHERE doc_id % 50 = 7",
)
def manifest_problems(spark, sf):
    """Files with a broken line report only that; sound files report every rule."""
    broken = docs(spark, sf).where("doc_id % 50 = 7").select(
        F.col("source").alias("file"), (F.col("doc_id") + 1000000000).alias("line_no"), F.lit("{oops").alias("value")
    )
    return validation.manifest_problems(manifest_lines(spark, sf).unionByName(broken))


def stored_listing(spark, sf):
    """What storage holds: some files missing, some with other bytes, some with another size."""
    cells = F.array(*[
        F.struct(
            F.lit(r).alias("role"), role_path(r).alias("path"),
            F.sha2(F.concat(key("doc_id"), F.lit(r), F.when((F.col("doc_id") % 7 == 0) & (F.lit(r) == "clean"), F.lit("!")).otherwise(F.lit(""))), 256).alias("sha256"),
        ) for r in ARTIFACT_ROLES
    ])
    rows = docs(spark, sf).select("doc_id", F.inline(cells))
    return rows.where(~((F.col("doc_id") % 9 == 0) & (F.col("role") == "input"))).select(
        "path", "sha256", F.when((F.col("doc_id") % 5 == 0) & (F.col("role") == "mask_text"), F.lit(65)).otherwise(F.lit(64)).alias("width"), F.lit(50).alias("height")
    )


@query(
    "artifact_problems",
    sql="WITH d AS (SELECT *, doc_id % 23 AS m FROM documents WHERE doc_id % 23 NOT IN (8, 10)) "
    "SELECT source AS file, doc_id AS line_no, 'artifact_missing' AS rule, 'input artifact does not exist: input/s' || doc_id || '.png' AS message FROM d WHERE doc_id % 9 = 0 AND m <> 12 "
    "UNION ALL SELECT source, doc_id, 'artifact_hash', 'hashes.clean mismatch for clean/s' || doc_id || '.png' FROM d WHERE doc_id % 7 = 0 "
    "UNION ALL SELECT source, doc_id, 'artifact_size', 'mask_text dimensions differ from manifest' FROM d WHERE doc_id % 5 = 0 AND m <> 5",
)
def artifact_problems(spark, sf):
    return validation.artifact_problems(validation.artifacts(manifest_lines(spark, sf)), stored_listing(spark, sf))


@query(
    "artifact_problems_without_hashes",
    sql="WITH d AS (SELECT *, doc_id % 23 AS m FROM documents WHERE doc_id % 23 NOT IN (8, 10)) "
    "SELECT source AS file, doc_id AS line_no, 'artifact_missing' AS rule, 'input artifact does not exist: input/s' || doc_id || '.png' AS message FROM d WHERE doc_id % 9 = 0 AND m <> 12 "
    "UNION ALL SELECT source, doc_id, 'artifact_size', 'mask_text dimensions differ from manifest' FROM d WHERE doc_id % 5 = 0 AND m <> 5",
)
def artifact_problems_without_hashes(spark, sf):
    return validation.artifact_problems(validation.artifacts(manifest_lines(spark, sf)), stored_listing(spark, sf), verify_hashes=False)


@query(
    "reusable_records",
    sql="SELECT source AS file, doc_id AS line_no, NOT (doc_id % 9 = 0 OR doc_id % 7 = 0 OR doc_id % 23 IN (11, 12)) AS reusable FROM documents WHERE doc_id % 23 NOT IN (8, 10)",
)
def reusable_records(spark, sf):
    return validation.reusable_records(validation.artifacts(manifest_lines(spark, sf)), stored_listing(spark, sf))


@query(
    "metadata_problems",
    sql=f"WITH {CROSS}, n AS (SELECT source AS file, count(*) AS n, CAST(substr(source, 4) AS INT) AS k FROM documents GROUP BY source) "
    "SELECT file, 'metadata_version' AS rule, 'dataset metadata schema_version must be 1' AS message FROM n WHERE k % 4 = 0 AND k % 7 <> 6 "
    "UNION ALL SELECT file, 'metadata_count', 'dataset metadata sample_count does not match the records' FROM n WHERE k % 3 = 0 AND k % 7 <> 6 "
    "UNION ALL SELECT file, 'metadata_id', 'dataset metadata dataset_id does not match the records' FROM (SELECT DISTINCT file, first_dataset FROM firsts) WHERE first_dataset <> 'demo' AND CAST(substr(file, 4) AS INT) % 7 <> 6 "
    "UNION ALL SELECT file, 'metadata_splits', 'dataset metadata source_splits does not match the records' FROM n WHERE k % 5 = 0 AND k % 7 <> 6 "
    "UNION ALL SELECT file, 'metadata_missing', 'dataset metadata is missing or is not an object' FROM n WHERE k % 7 = 6",
)
def metadata_problems(spark, sf):
    lines = manifest_lines(spark, sf)
    k = F.substring("file", 4, 9).cast("int")
    told = validation.parse_lines(lines.where("line_no % 23 NOT IN (8, 4)")).select(
        "file", "line_no", validation.text("source_id").alias("s"), validation.text("split").alias("p")
    )
    splits = told.groupBy("file", "s").agg(F.min_by("p", "line_no").alias("p")).groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("s", "p"))).alias("true_splits")
    )
    counted = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")).join(splits, "file")
    metadata = counted.select(
        "file", F.when(k % 4 == 0, 2).otherwise(1).alias("schema_version"), F.lit("demo").alias("dataset_id"),
        # the line with missing fields is still a record of the file
        (F.col("n") + F.when(k % 3 == 0, 1).otherwise(0)).alias("sample_count"),
        F.when(k % 5 == 0, F.map_concat("true_splits", F.create_map(F.lit("ghost"), F.lit("test")))).otherwise(F.col("true_splits")).alias("source_splits"),
    )
    return validation.metadata_problems(lines, metadata.where(k % 7 != 6))


@query(
    "json_types",
    sql="SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE event_id END AS whole, "
    "CASE WHEN event_id % 4 = 3 THEN 'x' || event_id END AS word FROM events",
)
def json_types(spark, sf):
    """Booleans and 1.0 are not integers; numbers are not strings."""
    e, text = F.col("event_id"), key("event_id")
    number = F.when(e % 4 == 0, F.lit("true")).when(e % 4 == 1, F.concat(text, F.lit(".0"))).otherwise(text)
    word = F.when(e % 4 == 3, F.concat(F.lit('"x'), text, F.lit('"'))).otherwise(text)
    lines = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"n":'), number, F.lit(',"w":'), word, F.lit("}")).alias("value"))
    return validation.parse_lines(lines).select(
        "event_id", validation.integer("n").cast("bigint").alias("whole"), validation.text("w").alias("word")
    )


# --- assets ------------------------------------------------------------------------------------------



def asset_rows(spark, sf):
    k, name = F.col("p_partkey") % 17, F.concat(F.lit("work-"), key("p_partkey"))
    bad = lambda m, wrong, right: F.when(k == m, wrong).otherwise(right)
    lit, null = F.lit, F.lit(None).cast("string")
    rights = lambda status, basis, licence, url: F.struct(
        status.alias("status"), basis.alias("basis"), licence.alias("license"), url.alias("license_url")
    )
    composition = rights(bad(1, lit("unresolved"), bad(2, lit("compatible_license"), lit("public_domain"))), bad(3, lit(" "), lit("old")), null, null)
    file_rights = rights(bad(4, lit("compatible_license"), lit("public_domain")), lit("pinned"), bad(4, lit("CC"), null), bad(4, lit("ftp://x"), null))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("file"), F.col("p_partkey").alias("line_no"),
        F.when(F.col("p_partkey") % 50 == 20, lit("twin")).otherwise(name).alias("id"), bad(5, lit(""), F.col("p_name")).alias("title"), F.col("p_brand").alias("composer"),
        F.col("p_name").alias("work_identifier"), bad(6, lit("file:/x"), F.concat(lit("https://example.org/"), name)).alias("source_url"),
        bad(7, lit("../up.ly"), bad(8, F.concat(name, lit(".txt")), F.concat(name, lit(".ly")))).alias("source_file"),
        bad(9, lit("ABC"), F.sha2(name, 256)).alias("source_sha256"), bad(10, F.lit(None), composition).alias("composition_rights"),
        file_rights.alias("source_file_rights"), bad(11, lit("2026-02-30"), bad(12, lit("2026-08-13T00:00"), lit("2026-08-13"))).alias("verified_date"), lit("n").alias("notes"),
    )


ASSET_SQL = """
p AS (SELECT p_brand AS file, p_partkey AS line_no, p_partkey % 17 AS k, 'work-' || p_partkey AS name FROM part),
e(k, rule, message) AS (VALUES
  (1, 'rights_status', 'composition_rights.status is not distributable'),
  (2, 'license_needed', 'composition_rights.license is required for compatible_license'),
  (2, 'license_url_needed', 'composition_rights.license_url is required for compatible_license'),
  (3, 'rights_basis_text', 'composition_rights.basis must be a nonempty string'),
  (4, 'license_url', 'source_file_rights.license_url must be an absolute HTTP(S) URL when present'),
  (4, 'license_url_needed', 'source_file_rights.license_url is required for compatible_license'),
  (5, 'title_text', 'title must be a nonempty string'), (6, 'source_url', 'source_url must be an absolute HTTP(S) URL'),
  (7, 'source_path', 'source_file must stay within the manifest directory'), (8, 'source_suffix', 'source_file must reference a .ly file'),
  (9, 'source_sha256', 'source_sha256 must be 64 lowercase hexadecimal characters'),
  (10, 'rights_mapping', 'composition_rights must be a mapping with explicit status and basis'),
  (11, 'verified_date', 'verified_date must use a valid YYYY-MM-DD date'), (12, 'verified_date', 'verified_date must use a valid YYYY-MM-DD date')),
own AS (
  SELECT file, line_no, rule, message FROM p JOIN e USING (k)
  UNION ALL SELECT file, line_no, 'source_missing', 'source_file does not exist: ' || name || '.ly' FROM p WHERE k NOT IN (7, 8) AND line_no % 10 = 0
  UNION ALL SELECT file, line_no, 'source_hash', 'source_sha256 mismatch for ' || name || '.ly' FROM p WHERE k NOT IN (7, 8) AND line_no % 10 <> 0 AND (line_no % 11 = 0 OR k = 9)
),
sound AS (SELECT * FROM p WHERE line_no NOT IN (SELECT line_no FROM own) AND line_no % 50 = 20)"""


@query(
    "asset_problems",
    sql=f"WITH {ASSET_SQL} SELECT * FROM own UNION ALL SELECT file, line_no, 'duplicate_id', 'id duplicates twin' FROM "
    "(SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM sound) WHERE rn > 1",
)
def asset_problems(spark, sf):
    name = F.concat(F.lit("work-"), key("p_partkey"))
    stored = table(spark, sf, "part").where(F.col("p_partkey") % 10 != 0).select(
        F.concat(name, F.lit(".ly")).alias("path"), F.sha2(F.concat(name, F.when(F.col("p_partkey") % 11 == 0, F.lit("!")).otherwise(F.lit(""))), 256).alias("sha256")
    )
    return validation.asset_problems(asset_rows(spark, sf), stored)


@query(
    "asset_duplicates",
    sql="SELECT p_brand AS file, p_partkey AS line_no, p_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn > 1",
)
def asset_duplicates(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("name"))
    return validation.repeated_ids(rows, ("file", "name"))


@query(
    "catalogue_problems",
    sql="SELECT 'work_count' AS rule, 'expected 40 works, found ' || (SELECT count(*) FROM part) AS message WHERE (SELECT count(*) FROM part) <> 40 "
    "UNION ALL SELECT 'required_fields', p_name || ' lacks work, coverage' FROM part WHERE p_partkey % 97 = 5 "
    "UNION ALL SELECT 'duplicate_id', p_name || ' occurs more than once' FROM part GROUP BY p_name HAVING count(*) > 1",
)
def catalogue_problems(spark, sf):
    gone = F.col("p_partkey") % 97 == 5
    works = table(spark, sf, "part").select(
        F.col("p_name").alias("id"), F.col("p_brand").alias("composer"), (F.col("p_size") + 1750).alias("death_year"),
        F.when(~gone, F.col("p_type")).alias("work"), F.col("p_name").alias("path"), F.when(~gone, F.col("p_type")).alias("coverage"),
    )
    return validation.catalogue_problems(works, 40, CATALOGUE_FIELDS)


@query(
    "date_rule",
    sql="SELECT o_orderkey, o_orderkey % 4 = 0 AS ok FROM orders",
)
def date_rule(spark, sf):
    day, o = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    value = F.when(o % 4 == 0, day).when(o % 4 == 1, F.concat(day, F.lit("T00:00"))).when(o % 4 == 2, F.regexp_replace(day, "-..-..$", "-02-30")).otherwise(F.regexp_replace(day, "-", ""))
    return table(spark, sf, "orders").select("o_orderkey", validation.strict_date_ok(value).alias("ok"))


@query(
    "timestamp_rule",
    sql="SELECT event_id, event_id % 4 < 2 AS ok FROM events",
)
def timestamp_rule(spark, sf):
    at, e = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id")
    value = (
        F.when(e % 4 == 0, F.concat(at, F.lit("Z"))).when(e % 4 == 1, F.concat(at, F.lit("+02:00")))
        .when(e % 4 == 2, at).otherwise(F.concat(F.lit("yesterday "), at, F.lit("Z")))
    )
    return table(spark, sf, "events").select("event_id", validation.timestamp_ok(value).alias("ok"))


@query(
    "url_rule",
    sql="SELECT page_id, page_id % 5 NOT IN (1, 2, 3) AS ok FROM pages",
)
def url_rule(spark, sf):
    from foliolake.functions.paths import is_http_url

    p, url = F.col("page_id"), F.col("url")
    value = (
        F.when(p % 5 == 1, F.regexp_replace(url, "^https?", "ftp")).when(p % 5 == 2, F.regexp_replace(url, "^https?://", ""))
        .when(p % 5 == 3, F.lit("https:///no-host")).otherwise(url)
    )
    return table(spark, sf, "pages").select("page_id", is_http_url(value).alias("ok"))


@query(
    "confined_paths",
    sql="SELECT page_id, page_id % 5 NOT IN (1, 2) AS ok FROM pages",
)
def confined_paths(spark, sf):
    from foliolake.functions.paths import is_confined

    p, tail = F.col("page_id"), F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    value = F.when(p % 5 == 1, F.concat(F.lit("/"), tail)).when(p % 5 == 2, F.concat(F.lit("a/../"), tail)).when(p % 5 == 3, F.concat(F.lit("..a/"), tail)).otherwise(tail)
    return table(spark, sf, "pages").select("page_id", is_confined(value).alias("ok"))


@query(
    "texts_without_markers",
    sql="SELECT doc_id, NOT (contains(lower(text), 'the') AND contains(lower(text), 'er')) AS rejected FROM documents",
)
def texts_without_markers(spark, sf):
    return docs(spark, sf).select("doc_id", validation.lacks_markers(F.col("text"), ("THE", "er")).alias("rejected"))
