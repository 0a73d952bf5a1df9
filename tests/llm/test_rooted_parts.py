"""Rounds of the component search are written in as many parts as their rows need."""

from foliolake.llm import simhash_dedup


def test_few_links_are_written_in_few_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.createDataFrame([(k + 1, k) for k in range(30)], "fp bigint, root bigint")
        roots = simhash_dedup.rooted(chain)
        assert sorted(map(tuple, roots.collect())) == [(k + 1, 0) for k in range(30)]
        assert len(roots.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
