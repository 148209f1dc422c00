"""Work that must not grow with what rows share: cell series, covered ground, stored networks, tasks of grid joins."""

import os

from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.operators import network, overlay, rainfall, raster
from terraloom.operators import spatial_join as sj

BOXES = "xmin double, ymin double, xmax double, ymax double"


def test_series_of_a_cell_is_made_once(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, 0.0, 0.0, t, h) for t, h in ((1, 3), (0, 2), (1, 5), (2, None))] + [(1, 1, 0, 10.0, 0.0, t, h) for t, h in ((1, 9), (0, 1))],
        "raster_id int, cx int, cy int, x double, y double, t int, h int",
    )
    points = spark.createDataFrame([(1, 7, 1.0, 0.0), (1, 7, 1.0, 0.0), (1, 8, 9.0, 0.0), (1, 9, 1.0, 0.0), (1, 9, 9.0, 0.0)], "raster_id int, point_id int, x double, y double")
    series = raster.depth_series(points, cells)
    got = {r["point_id"]: (r["times"], r["depths"]) for r in series.collect()}
    assert got == {7: ([0, 1, 2], [2, 5, None]), 8: ([0, 1], [1, 9]), 9: ([0, 1, 2], [2, 9, None])} and series.count() == 3
    # The join with the points comes after the cells' lists, not before them.
    plan = series._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") >= 2


def test_free_ground_does_not_grow_with_covered_ground(spark):
    log = spark.range(3000).select(
        F.col("id").alias("unique_id"), F.array(F.lit("roads")).alias("source_table_list"),
        (F.col("id") % 50 / 50.0).alias("xmin"), F.lit(0.0).alias("ymin"), (F.lit(15.0) + F.col("id") % 50 / 50.0).alias("xmax"), F.lit(16.0).alias("ymax"),
    )
    cells, free = overlay.free_ground(log, 16.0)
    assert cells.count() == 1 and free.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).first()[0] < 1.0
    areas = spark.createDataFrame([(1, "roads", 0.0, 0.0, 32.0, 16.0), (1, "roads", 0.0, 0.0, 32.0, 16.0)], f"aoi_id int, table_name string, {BOXES}")
    pieces = overlay.uncovered_area(areas, log, 16.0)
    left = {r["aoi_id"]: r["a"] for r in pieces.groupBy("aoi_id").agg(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("a")).collect()}
    assert abs(left[1] - (32.0 - 15.98) * 16.0) < 1e-6


def test_a_box_meets_what_has_a_vertex_in_it(spark):
    box = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    cases = {
        "POLYGON ((1 1, 2 1, 2 2, 1 1))": True, "POLYGON ((4 4, 6 4, 6 6, 4 4))": True, "POLYGON ((-9 -9, 20 -9, 20 20, -9 20, -9 -9))": True,
        "POLYGON ((-1 2, 2 -1, -3 -3, -1 2))": True, "POLYGON ((3 5.5, 5.5 3, 6 6, 3 5.5))": False, "LINESTRING (-1 2, 5 2)": True, "POINT (4 0)": True,
        "LINESTRING (3 -2, 6 1)": False,
    }
    rows = spark.createDataFrame([(w, box) for w in cases], "w string, b string").select("w", g.from_wkt("w").alias("g"), g.from_wkt("b").alias("b"))
    got = rows.select("w", g.intersects("g", "b").alias("ab"), g.intersects("b", "g").alias("ba")).collect()
    assert {r["w"]: (r["ab"], r["ba"]) for r in got} == {w: (v, v) for w, v in cases.items()}


def test_grid_joins_keep_their_tasks(spark):
    boxes = spark.range(300).select("id", *((F.col("id") * k % 100).cast("double").alias(c) for k, c in zip((7, 13, 7, 13), g.BOX, strict=True)))
    pairs = sj.intersecting_pairs(boxes, boxes.withColumnsRenamed({"id": "other", **{c: f"o_{c}" for c in g.BOX}}), 10.0, right_box=[f"o_{c}" for c in g.BOX])
    # Few bytes, of which AQE would make one task.
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_networks_of_a_run_share_a_folder(spark, tmp_path):
    spark.sql(f"CREATE DATABASE many_nets LOCATION '{tmp_path}/many_nets'")
    reaches = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0)], "objectid bigint, ax double, ay double, bx double, by double")
    lines = reaches.select("objectid", g.line_geometry(F.array(g.point("ax", "ay"), g.point("bx", "by"))).alias("geometry"))
    catchments = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], f"c bigint, {BOXES}").select("c", g.box_geometry(*g.BOX).alias("geometry"))
    mouths = spark.createDataFrame([(1, 1.0, 1.0)], "c bigint, x double, y double")
    areas = spark.range(40).select(F.col("id").alias("aoi_id"), *(F.lit(float(v)).alias(s) for v, s in zip((0, 0, 9, 9), g.BOX, strict=True)))
    root = str(tmp_path / "root")
    network.networks_of_areas(spark, areas, lines, catchments, mouths, "c", 8.0, root, "many_nets.networks", "many_nets.exclusions")
    assert len([d for d in os.listdir(f"{root}/edges") if not d.startswith((".", "_"))]) == 1
    assert spark.read.parquet(f"{root}/edges").select("rec_network_id").distinct().count() == 40
    paths = spark.table("many_nets.networks").select("network_data_path").distinct().collect()
    assert [p[0] for p in paths] == [f"{root}/edges/first_network=1"]


def test_wide_form_has_a_bounded_width(spark, monkeypatch):
    monkeypatch.setattr(rainfall, "SITES_PER_BLOCK", 4)
    series = spark.range(10).select((F.col("id") * 3).alias("site_id"), F.explode(F.array(F.lit(0.0), F.lit(60.0))).alias("seconds"), F.col("id").cast("double").alias("v"))
    places = rainfall.wide_columns(series.select("site_id"))
    wide = rainfall.wide_from_long(series, places, "v")
    assert len(wide.columns) == 2 + 4 and wide.count() == 2 * 3
    got = sorted(tuple(r) for r in rainfall.long_from_wide(wide, places, "v").collect())
    assert got == sorted((r["site_id"], r["seconds"], r["v"]) for r in series.collect())
