"""Resume, completion and reproduction checks over stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.constants import MANIFEST_SCHEMA_VERSION, SPLITS


def fingerprint(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``row_count, digest`` of a table, per ``by`` if given, whatever the order and partitioning of its rows.

    The digest sums 52 bits of each row's SHA-256, so it is mergeable, repeated rows count, and two tables agree only
    when their rows do (but for one chance in some 10**15). Nulls differ from empty text.
    """
    cell = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[cell(c) for c in columns]), 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("digest"))


def completed_evaluations(rows: DataFrame, summaries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether the stored metric rows of each run are those its summary tells of: ``run, status``.

    ``summaries`` has ``run, sample_count, digest``, written when the run ended. ``complete`` runs need no work;
    ``unfinished`` ones lack the summary's count or have another number of rows; ``altered`` ones have the right number
    of other rows.
    """
    found = fingerprint(rows, columns, ("run",)).withColumnRenamed("digest", "_found")
    joined = summaries.join(found, "run", "left")
    counted = F.coalesce(F.col("sample_count") == F.coalesce("row_count", F.lit(0)), F.lit(False))
    same = F.coalesce(F.col("digest") == F.coalesce("_found", F.lit("0")), F.lit(False))
    status = F.when(~counted, F.lit("unfinished")).when(same, F.lit("complete")).otherwise(F.lit("altered"))
    return joined.select("run", status.alias("status"))


def config_signature(config_json: Column, ignored: Sequence[str] = ("workers",)) -> Column:
    """Hash of a flat JSON config without the keys that do not shape the result."""
    parsed = F.from_json(config_json, "map<string,string>")
    kept = F.map_filter(parsed, lambda k, _: ~k.isin(*ignored))
    pairs = F.array_sort(F.map_entries(kept))
    return F.sha2(F.to_json(pairs), 256)


def remaining_tasks(tasks: DataFrame, valid: DataFrame, key: str = "sample_id") -> DataFrame:
    """Planned tasks without a valid stored record."""
    return tasks.join(valid.select(key), key, "left_anti")


def merged_records(tasks: DataFrame, stored: DataFrame, made: DataFrame, key: str = "sample_id") -> DataFrame:
    """Kept and new records together, each with its ``task_index`` so that task order can be restored."""
    order = tasks.select(key, "task_index")
    kept = stored.withColumn("reused", F.lit(True))
    new = made.withColumn("reused", F.lit(False))
    return kept.unionByName(new, allowMissingColumns=True).join(order, key)


def completed_datasets(records: DataFrame, problems: DataFrame, metadata: DataFrame) -> DataFrame:
    """Datasets that need no work: no problem, enough records, and sane counts in the metadata.

    ``metadata`` has ``dataset_id, target_samples, split_counts map<string,bigint>, skipped_page_count``.
    """
    found = records.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("sample_count"))
    broken = problems.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("problem_count"))
    joined = metadata.join(found, "dataset_id", "left").join(broken, "dataset_id", "left")
    sane = F.col("split_counts").isNotNull() & F.col("skipped_page_count").isNotNull()
    done = (
        (F.coalesce("sample_count", F.lit(0)) == F.col("target_samples"))
        & (F.coalesce("problem_count", F.lit(0)) == 0) & sane
    )
    counts = [F.coalesce(F.col("split_counts")[s], F.lit(0)).alias(f"{s}_count") for s in SPLITS]
    return joined.select(
        "dataset_id", F.coalesce("sample_count", F.lit(0).cast("bigint")).alias("sample_count"), *counts,
        F.coalesce(done, F.lit(False)).alias("complete"),
    )


def reproduction_audit(stored: DataFrame, recomputed: DataFrame, roles: Sequence[str], environment: Sequence[str]) -> DataFrame:
    """Stored against recomputed hashes per sample.

    ``exact``: all equal. ``best-effort``: the environment differs, which is listed as a difference.
    ``failed``: the environment is equal and a hash differs, or the sample was not recomputed.
    """
    joined = stored.alias("s").join(recomputed.withColumn("_made", F.lit(True)).alias("r"), "sample_id", "left")
    made = F.coalesce("_made", F.lit(False))
    differs = lambda c: ~F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
    same_environment = F.lit(True)
    for column in environment:
        same_environment = same_environment & ~differs(column)
    found = [F.when(~same_environment, F.lit("environment")), *[F.when(differs(c), F.lit(c)) for c in roles]]
    differences = F.when(made, F.array_compact(F.array(*found))).otherwise(F.array(F.lit("not recomputed")))
    status = F.when(made & (F.size(differences) == 0), F.lit("exact")).when(made & ~same_environment, F.lit("best-effort"))
    return joined.select(
        "sample_id", differences.alias("differences"), status.otherwise(F.lit("failed")).alias("status")
    )


def dataset_summary(records: DataFrame, config_json: str, dataset_id: str) -> DataFrame:
    """The one-row dataset description: counts per split, source assignments, config hash.

    The assignment map has one entry per source; at corpus scale read ``source_assignments`` instead.
    """
    counts = [F.count_if(F.col("split") == s).alias(f"{s}_count") for s in SPLITS]
    return records.agg(
        F.lit(dataset_id).alias("dataset_id"), F.count(F.lit(1)).alias("sample_count"), *counts,
        F.count_distinct("source_id").alias("source_count"),
        F.sha2(F.lit(config_json), 256).alias("config_sha256"),
    )


def source_assignments(records: DataFrame) -> DataFrame:
    """Source to split, one row per source; the split of the first line wins."""
    return records.groupBy("source_id").agg(F.min_by("split", "line_no").alias("split"))


def dataset_metadata(
    records: DataFrame, manifest: DataFrame, config_json: str, dataset_id: str, skipped_page_count: int, versions: dict[str, str]
) -> DataFrame:
    """The whole dataset description: ``dataset_summary`` with skipped pages, versions and the source manifest.

    ``manifest`` has the lines (``line_no, value``) that the sources came from; their fingerprint stands for the file,
    since lines may come from many files in any order.
    """
    source = fingerprint(manifest, ("line_no", "value")).select(
        F.col("row_count").alias("source_manifest_lines"), F.col("digest").alias("source_manifest_digest")
    )
    literal = F.create_map(*[F.lit(x) for item in sorted(versions.items()) for x in item])
    summary = dataset_summary(records, config_json, dataset_id).withColumns(
        {
            "schema_version": F.lit(MANIFEST_SCHEMA_VERSION), "skipped_page_count": F.lit(skipped_page_count).cast("bigint"),
            "software_versions": literal, "_one": F.lit(1),
        }
    )
    return summary.join(source.withColumn("_one", F.lit(1)), "_one").drop("_one")


def reproduction_from_plan(stored: DataFrame, scan: DataFrame, recipes: DataFrame) -> DataFrame:
    """Recompute pages from their plan and compare pixel hashes: ``page_id, status``.

    ``stored`` has ``page_id, pixel_sha256``, ``scan`` the clean pages and ``recipes`` their planned degradations. The
    pixels are made again by the kernels; a page that cannot be made has ``failed``.
    """
    from foliolake.operators import augment

    made = augment.pixel_hash(augment.apply_recipes(scan, recipes))
    again = made.select(F.col("page_id").alias("sample_id"), F.col("pixel_sha256").alias("input"))
    known = stored.select(F.col("page_id").alias("sample_id"), F.col("pixel_sha256").alias("input"))
    return reproduction_audit(known, again, ("input",), ()).select(F.col("sample_id").alias("page_id"), "status")
