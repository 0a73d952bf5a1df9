"""From a catalogue of works to asset records and a curation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_url(template: str, commit: Column, path: Column) -> Column:
    """``template`` holds ``{commit}`` and ``{path}`` once each."""
    head, rest = template.split("{commit}")
    middle, tail = rest.split("{path}")
    return F.concat(F.lit(head), commit, F.lit(middle), path, F.lit(tail))


def catalogue_assets(catalogue: DataFrame, contents: DataFrame, template: str, commit: str, basis: str, verified: str) -> DataFrame:
    """Asset records with composed URLs, rights texts and content hashes."""
    joined = catalogue.join(contents.select("path", F.sha2("content", 256).alias("source_sha256")), "path")
    right = lambda text: F.struct(F.lit("public_domain").alias("status"), text.alias("basis"))
    died = F.concat(
        F.col("composer"), F.lit(" died in "), F.col("death_year").cast("string"), F.lit("; the composition is public domain.")
    )
    file_name = F.regexp_extract("path", r"([^/]*)$", 1)
    return joined.select(
        "id", F.col("work").alias("title"), "composer", F.col("work").alias("work_identifier"),
        source_url(template, F.lit(commit), F.col("path")).alias("source_url"),
        F.concat(F.lit("sources/"), "id", F.lit("/"), file_name).alias("source_file"), "source_sha256",
        right(died).alias("composition_rights"), right(F.lit(basis)).alias("source_file_rights"),
        F.lit(verified).cast("date").alias("verified_date"),
        F.concat(F.lit("Curated V1 coverage: "), "coverage", F.lit(".")).alias("notes"),
    )


def curation_report(files: DataFrame, template: str, commit: str) -> DataFrame:
    """Files of each work with URL and hash, in (work, path) order.

    One row per file rather than one list per work: a work's include tree has no size limit.
    """
    return files.select(
        "id", F.col("path").alias("repository_path"), source_url(template, F.lit(commit), F.col("path")).alias("source_url"),
        F.sha2("content", 256).alias("sha256"),
    ).orderBy("id", "repository_path")


def curation_totals(files: DataFrame) -> DataFrame:
    """Number of works and of files."""
    return files.agg(F.count_distinct("id").alias("work_count"), F.count(F.lit(1)).alias("file_count"))
