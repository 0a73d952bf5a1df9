"""A page or id with a third of all rows must not end up in one task."""

import pytest
from pyspark.sql import functions as F

from foliolake.operators import kernels, lookups, raster, skew, stencil
from foliolake.sources import rasters


@pytest.fixture
def shuffled(spark):
    """No broadcast, no coalescing, 32 partitions: what a join on large sides does."""
    keys = (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions",
    )
    old = {k: spark.conf.get(k, None) for k in keys}
    for key, value in zip(keys, ("-1", "-1", "false", "32")):
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_page_spreads_over_tasks(spark, shuffled):
    hot = F.col("id") % 3 == 0
    scan = spark.range(0, 30000, 1, 8).select(
        F.when(hot, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("page_id"),
        F.when(hot, F.col("id") / 3).otherwise(F.floor(F.col("id") / 97)).cast("int").alias("y"),
        F.array(*[(F.col("id") * k % 251).cast("int") for k in (3, 5, 7, 11)]).alias("values"),
    )

    def largest_share(rows):
        per_task = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("page_id") == 0).alias("n")).collect()
        return max(r.n for r in per_task) / sum(r.n for r in per_task)

    assert largest_share(raster.attach_page_values(scan, kernels.otsu_pages(scan))) < 0.35
    assert largest_share(stencil.band_rows(scan, 5).repartition("page_id", "band")) < 0.2


def hot_ids(spark, n=24000):
    """A third of the rows has one id, a ninth another, the rest a few rows each."""
    k = F.col("id")
    hot = F.when(k % 3 == 0, F.lit("hot")).when(k % 9 == 1, F.lit("warm")).otherwise(F.concat(F.lit("s"), (k % 5003).cast("string")))
    return spark.range(0, n, 1, 8).select(k.alias("n"), hot.alias("id"))


def largest_task(rows):
    """The share of the rows that the fullest task of the join holds."""
    per_task = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return max(r["count"] for r in per_task) / sum(r["count"] for r in per_task)


def test_heavy_keys_are_those_above_the_share(spark):
    rows = hot_ids(spark)
    found = {r.key_hash for r in skew.heavy_keys(rows, ["id"]).collect()}
    named = {r.id for r in rows.distinct().select("id", F.xxhash64("id").alias("h")).distinct().collect() if r.h in found}
    assert named == {"hot", "warm"}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_join_equals_the_plain_join(spark, shuffled, how):
    rows = hot_ids(spark, 3000).withColumn("id", F.when(F.col("n") % 7 != 0, F.col("id")))
    partners = rows.where("n % 2 = 0").groupBy("id").agg(F.max("n").alias("m")).unionByName(
        spark.createDataFrame([("hot", -1), (None, -2), ("absent", -3)], "id string, m bigint")
    )
    got = skew.dealt_join(rows, partners, ["id"], how)
    want = rows.join(partners, ["id"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hot_source_id_spreads(spark, shuffled):
    samples = hot_ids(spark).select(F.col("n").alias("sample_id"), F.col("id").alias("source_id"), F.lit("x").alias("source_sha256"))
    assets = samples.select("source_id", F.lit("y").alias("source_sha256")).distinct()
    found = lookups.source_hash_problems(samples, assets)
    assert found.count() == samples.count() and largest_task(found) < 1 / 6


def test_hot_name_spreads(spark, shuffled):
    names = hot_ids(spark).select("n", F.col("id").alias("name"))
    registry = names.select("name", F.lit("text").alias("class")).distinct()
    found = lookups.classify_names(names, registry)
    assert found.where("known").count() == names.count() and largest_task(found) < 1 / 6


def test_hot_include_spreads(spark, shuffled):
    """Every root includes one file, which includes three."""
    from foliolake.operators.skew import dealt_join

    newest = spark.range(0, 20000, 1, 8).select(F.col("id").cast("string").alias("root"), F.lit("common").alias("path"))
    links = spark.createDataFrame([("common", f"part{k}") for k in range(3)] + [("part0", "leaf")], "path string, target string")
    assert largest_task(dealt_join(newest, links, ["path"])) < 1 / 6
    edges = links.withColumn("unsafe", F.lit(False)).unionByName(
        newest.select(F.col("root").alias("path"), F.lit("common").alias("target"), F.lit(False).alias("unsafe"))
    )
    closure = lookups.include_closure(newest.select(F.col("root").alias("path")), edges)
    assert closure.count() == 20000 * 6


def test_hot_path_spreads(spark, shuffled):
    k = F.col("id")
    page = F.when(k % 3 == 0, F.lit("a.png")).otherwise(F.concat(F.lit("p"), (k % 211).cast("string")))
    lines = spark.range(0, 21000, 1, 8).select(page.alias("page_id"), k.cast("int").alias("y"), F.array(k.cast("int")).alias("values"))
    samples = lines.select(F.col("page_id").alias("input_path"), F.lit("none").alias("clean_target_path")).distinct().withColumn("sample_id", F.col("input_path"))
    wanted = samples.select("sample_id", F.col("input_path").alias("path"))
    joined = skew.dealt_join(lines.withColumnRenamed("page_id", "path"), wanted, ["path"], deal=F.col("y"))
    assert largest_task(joined) < 1 / 6
    assert rasters.load_samples(samples, lines, masks=False).count() == 21000


def test_hot_stem_spreads(spark, shuffled):
    paths = hot_ids(spark).select(F.concat(F.lit("d"), F.col("n").cast("string"), F.lit("/"), F.col("id"), F.lit(".pdf")).alias("path"))
    keys = lookups.source_keys(paths)
    assert keys.select("key").distinct().count() == 24000 and largest_task(keys) < 1 / 6
