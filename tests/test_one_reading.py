"""Lines that several branches need are read or parsed once, and lines of a page are summed without pixels."""

from pyspark.sql import functions as F

from foliolake.operators import crops, raster, validation


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def manifest(spark):
    value = F.concat(F.lit('{"sample_id":"s'), (F.col("id") % 3).cast("string"), F.lit('"}'))
    return spark.range(9).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), value.alias("value"))


def test_cross_record_rules_parse_lines_once(spark):
    assert "Range (" not in plan_of(validation.cross_record_problems(manifest(spark)))


def test_manifest_rules_parse_lines_for_structure_and_records_alone(spark):
    problems = validation.manifest_problems(manifest(spark))
    assert plan_of(problems).count("InMemoryRelation") <= 2
    assert {r["rule"] for r in problems.collect()} == {"missing_fields"}
    spark.catalog.clearCache()


def test_crop_plan_reads_lines_for_the_count_alone(spark):
    members = spark.range(40).select((F.col("id") % 4).alias("page_id"), F.floor(F.col("id") / 4).cast("int").alias("y"), F.array_repeat((F.col("id") % 2).cast("int"), 16).alias("member"))
    draws = spark.createDataFrame([(1, k, k, 10, 16) for k in range(4)], "epoch int, index bigint, page_id bigint, height int, width int")
    plan = crops.crop_plan(draws, members, 8, 0.8, 0.16, 5)
    assert plan_of(plan).count("Range (") == 1
    assert plan.count() == 4


def test_line_moments_are_those_of_pixels(spark):
    rows = [(1, 0, [5, 0, 7]), (1, 1, []), (2, 0, None), (2, 1, [-3])]
    lines = spark.createDataFrame(rows, "page_id bigint, y int, values array<int>").coalesce(1)
    got = raster.line_moments(lines, "values", ("page_id", "y"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 12, 14, 7), (2, 1, 1, -3, 0, -3)]
