"""Joins and series whose cost grows with their results, by their plans and candidates."""

from pyspark.sql import functions as F

from terraloom.operators import cache, rainfall, tide
from terraloom.operators import spatial_join as sj

BOX = ("xmin", "ymin", "xmax", "ymax")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_boxes_have_few_candidates(spark):
    """Points meet areas a little wider than a cell: few candidates beyond the pairs, and no side is broadcast."""
    points = spark.range(10_000).select(F.col("id").alias("p"), (F.col("id") % 100 * 1000.0).alias("x"), (F.floor(F.col("id") / 100) * 1000.0).alias("y"))
    areas = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 10 * 8000.0 + 5).alias("xmin"), (F.floor(F.col("id") / 10) * 8000.0 + 5).alias("ymin"))
    areas = areas.select("*", (F.col("xmin") + 12_000).alias("xmax"), (F.col("ymin") + 12_000).alias("ymax"))
    lhs, rhs, on = sj._gridded(points, areas, 10_000.0, ("x", "y", "x", "y"), BOX, [])
    pairs = sj.intersecting_pairs(points, areas, 10_000.0, left_box=("x", "y", "x", "y"))
    assert pairs.count() == 100 * 144
    assert lhs.join(rhs, on).count() < 4.5 * 100 * 144
    assert "Broadcast" not in plan(pairs)
    assert "Broadcast" not in plan(sj.matching_ids(points, areas, ["p"], 10_000.0, left_box=("x", "y", "x", "y")))


def test_sea_level_rows_are_not_broadcast(spark):
    """A short list of points with very many rows each."""
    rows = spark.range(20).select(F.col("id").alias("point_id"), (F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("year"))
    places = spark.range(5).select(F.col("id").alias("location_id"), (F.col("id") * 20.0 + 1).alias("x"), F.lit(1.0).alias("y"))
    found = tide.closest_sea_level(places, rows)
    assert "SortMergeJoin [point_id" in plan(found) and "SortMergeJoin [_k" in plan(found)
    assert sorted({(r.location_id, r.point_id) for r in found.collect()}) == [(k, 2 * k) for k in range(5)] and found.count() == 250


def test_old_cache_entries_leave_early(spark):
    """Many entries over one place: only those newer than one that holds all requests of the cell meet the requests."""
    entries = spark.range(2000).select(
        F.lit("k").alias("options_key"), F.col("id").alias("unique_id"), (F.col("id") * 10).alias("flood_model_id"), F.floor(F.col("id") / 100).alias("created_at"),
        (F.col("id") % 7 * -1.0).alias("xmin"), F.lit(-5.0).alias("ymin"), F.when(F.col("id") > 1990, 3.0).otherwise(9000.0).alias("xmax"), F.lit(9000.0).alias("ymax"),
    )
    requests = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 5.0, 5.0, 6.0, 6.0), (3, 1.0, 1.0, 9999.0, 2.0)], "request_id long, xmin double, ymin double, xmax double, ymax double")
    asked = requests.select("request_id", F.lit('{"a":1}').alias("scenario_options"), *BOX)
    key = cache.with_options_key(asked).first()["options_key"]
    held = entries.withColumn("options_key", F.lit(key))
    found = {r.request_id: r.flood_model_id for r in cache.lookup(asked, held, 20_000.0).collect()}
    assert found == {1: 19990, 2: 19900, 3: None}
    wanted = cache.with_options_key(asked.filter("request_id < 3")).select("request_id", "options_key", *(F.col(s).alias(f"want_{s}") for s in BOX))
    corner = ("want_xmin", "want_ymin", "want_xmin", "want_ymin")
    lhs, rhs, on = sj._gridded(wanted, held, 20_000.0, corner, BOX, ["options_key"])
    assert cache._may_win(lhs, rhs, on).count() <= 20


def test_storm_steps_are_dealt_by_their_number(spark):
    depths = spark.range(3).select(F.col("id").alias("site_id"), F.explode(F.array(*(F.lit(m).cast("long") for m in (10, 60, 1440, 7200)))).alias("mins")).withColumn("depth", F.col("mins") * 0.5)
    storms = rainfall.hyetograph(depths, 1440, 1000, 10)
    assert "REPARTITION_BY_COL" in plan(storms)
    assert storms.count() == 3 * 144
