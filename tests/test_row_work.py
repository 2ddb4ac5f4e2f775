"""Row work that is heavy: expressions that do not multiply, and rows dealt over tasks."""
from pyspark.sql import functions as F

from regionflow.functions import geometry as geo
from regionflow.functions.projection import transform_parts
from regionflow.queries import QUERIES
from regionflow.scale import spread

FOLDER = "/root/testdata/sf0.001"


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_chain_of_projections_does_not_multiply(spark):
    rows = spark.createDataFrame([(8.5, 50.1)], "x double, y double").select(geo.line((F.col("x"), F.col("y"))).alias("g"))
    chained = rows.withColumn("g", transform_parts(F.col("g"), 4326, 25832)).withColumn(
        "g", transform_parts(F.col("g"), 25832, 3035)).withColumn("g", transform_parts(F.col("g"), 3035, 4326))
    assert plan_of(chained).count("SIN(") < 60
    x, y = chained.first()["g"][0][0]
    assert abs(x - 8.5) < 1e-7 and abs(y - 50.1) < 1e-7


def test_a_covered_segment_reads_the_polygon_once(spark):
    rows = spark.range(1).select(geo.box(0, 0, 4, 4).alias("r"))
    covered = rows.select(geo.covers_segment(F.col("r"), F.lit(1.0), F.col("r")[0][0]["y"], F.lit(4.0), F.lit(2.0)).alias("c"))
    assert covered.first()["c"] is True
    box = geo.box(0, 0, 4, 4)
    some = [geo.covers_segment(box, *map(F.lit, p)) for p in ((1.0, 1.0, 5.0, 1.0), (0.0, 0.0, 4.0, 0.0), (5.0, 5.0, 6.0, 6.0))]
    assert list(spark.range(1).select(*some).first()) == [False, True, False]
    flat = spark.read.parquet(f"{FOLDER}/customer.parquet").select(geo.box(F.col("c_custkey"), 0, 9, 9).alias("r"))
    assert plan_of(flat.select(geo.covers_segment(F.col("r"), *map(F.lit, (1.0, 1.0, 2.0, 2.0))))).count("flatten(") <= 6


def test_rows_of_one_file_are_dealt_over_tasks(spark):
    rows = spread(spark.range(0, 1000, 1, 1), "id")
    assert rows.rdd.getNumPartitions() >= 8 and rows.count() == 1000
    for name in ("covering_area", "route_streets", "reproject"):
        assert QUERIES[name](spark, FOLDER).count() > 0
    assert "RepartitionByExpression" in plan_of(QUERIES["covering_area"](spark, FOLDER))
    assert "RepartitionByExpression" in plan_of(QUERIES["reproject"](spark, FOLDER))
