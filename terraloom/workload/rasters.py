"""Cell-table rasters: depth, flooded regions and buildings, point queries, terrain."""

from pyspark.sql import functions as F

from ..operators import raster
from ..sources import tables
from . import fixtures  # noqa: F401
from .registry import query, scratch, scratch_database


@query("a4_max_depth", "SELECT raster_id, cx, cy, max(h) AS h FROM fx_cell GROUP BY raster_id, cx, cy")
def a4(fx):
    return raster.max_depth(fx("fx_cell"))


@query(
    "src17_raster_cells",
    """SELECT false AS only_one, raster_id, cx, cy, x, y, t, h FROM fx_cell UNION ALL SELECT true, raster_id, cx, cy, x, y, t, h FROM fx_cell WHERE raster_id = 3""",
)
def src17(fx):
    """Cells written as one folder per raster and read back, all of them and one raster alone."""
    path = scratch(fx, "cells")
    fx("fx_cell").repartition("raster_id", "cx").write.partitionBy("raster_id").parquet(path)
    columns = ("only_one", "raster_id", "cx", "cy", "x", "y", "t", "h")
    every = raster.read_cells(fx.spark, path).withColumn("only_one", F.lit(False)).select(*columns)
    return every.unionByName(raster.read_cells(fx.spark, path, 3).withColumn("only_one", F.lit(True)).select(*columns))


@query(
    "sp14_raster_extent",
    """WITH gx AS (SELECT raster_id, x, x - lag(x) OVER (PARTITION BY raster_id ORDER BY x) AS g FROM (SELECT DISTINCT raster_id, x FROM fx_cell)),
            gy AS (SELECT raster_id, y, y - lag(y) OVER (PARTITION BY raster_id ORDER BY y) AS g FROM (SELECT DISTINCT raster_id, y FROM fx_cell))
       SELECT a.raster_id, xmin, xmax, resolution_x, ymin, ymax, resolution_y
       FROM (SELECT raster_id, min(x) AS xmin, max(x) AS xmax, min(g) AS resolution_x FROM gx GROUP BY raster_id) a
       JOIN (SELECT raster_id, min(y) AS ymin, max(y) AS ymax, min(g) AS resolution_y FROM gy GROUP BY raster_id) b ON a.raster_id = b.raster_id""",
)
def sp14(fx):
    return raster.raster_info(fx("fx_cell"))


@query(
    "sp14_raster_boundary",
    """WITH b AS (SELECT raster_id, (min(x) - 50)::DOUBLE AS xmin, (min(y) - 50)::DOUBLE AS ymin, (max(x) + 50)::DOUBLE AS xmax, (max(y) + 50)::DOUBLE AS ymax FROM fx_cell GROUP BY raster_id)
       SELECT raster_id, 'bottom' AS position, xmin AS x0, ymin AS y0, xmax AS x1, ymin AS y1 FROM b UNION ALL SELECT raster_id, 'right', xmax, ymin, xmax, ymax FROM b
       UNION ALL SELECT raster_id, 'top', xmin, ymax, xmax, ymax FROM b UNION ALL SELECT raster_id, 'left', xmin, ymin, xmin, ymax FROM b""",
)
def sp14_boundary(fx):
    return raster.raster_boundary(raster.raster_info(fx("fx_cell")))


@query(
    "ov6_flooded_regions",
    """WITH RECURSIVE wet AS (SELECT raster_id, cx, cy FROM fx_cell GROUP BY raster_id, cx, cy HAVING max(h) >= 10),
       reach(raster_id, cx, cy, ry, rx) AS (SELECT raster_id, cx, cy, cy, cx FROM wet
         UNION SELECT b.raster_id, b.cx, b.cy, r.ry, r.rx FROM reach r JOIN wet b ON b.raster_id = r.raster_id AND abs(b.cx - r.cx) + abs(b.cy - r.cy) = 1),
       parts AS (SELECT raster_id, cx, cy, min((ry, rx)) AS key FROM reach GROUP BY raster_id, cx, cy)
       SELECT raster_id, key[1] AS region_cy, key[2] AS region_cx, count(*) AS cells, min(cx) AS cx_min, min(cy) AS cy_min, max(cx) AS cx_max, max(cy) AS cy_max
       FROM parts GROUP BY raster_id, key""",
)
def ov6(fx):
    return raster.flooded_regions(fx("fx_cell"), 10)


FLOODED = """SELECT b.building_outline_id, {model} EXISTS (SELECT 1 FROM (SELECT raster_id, cx, cy FROM fx_cell GROUP BY raster_id, cx, cy HAVING max(h) >= 8) w
  WHERE w.raster_id = b.raster_id AND b.xmin <= 1500000 + (w.cx + 1) * 100 AND b.xmax >= 1500000 + w.cx * 100
    AND b.ymin <= 5100000 + (w.cy + 1) * 100 AND b.ymax >= 5100000 + w.cy * 100) AS is_flooded FROM fx_building b"""


def flagged(fx):
    return raster.flag_flooded(fx("fx_building"), fx("fx_cell"), 8, 100.0, (1500000.0, 5100000.0))


@query("j10_flooded_buildings", FLOODED.format(model=""))
def j10(fx):
    return flagged(fx).select("building_outline_id", "is_flooded")


@query("snk10_building_status", FLOODED.format(model="b.raster_id AS flood_model_id,"))
def snk10(fx):
    """Status rows appended to the stored table and read back."""
    table = f"{scratch_database(fx)}.building_flood_status"
    tables.create_if_absent(fx.spark, table, tables.BUILDING_STATUS_SCHEMA, ["flood_model_id"])
    tables.append(raster.building_status(flagged(fx)), table)
    return fx.spark.table(table).select("flood_model_id", "building_outline_id", "is_flooded")


@query(
    "c5_building_status_view",
    f"""WITH status AS ({FLOODED.format(model='b.raster_id AS flood_model_id,')})
        SELECT b.building_outline_id, b.xmin, b.ymin, s.is_flooded, s.flood_model_id FROM fx_building b
        JOIN status s ON s.building_outline_id = b.building_outline_id WHERE s.flood_model_id = 3""",
)
def c5(fx):
    from ..plans.views import building_status_for

    return building_status_for(fx("fx_building").drop("raster_id"), raster.building_status(flagged(fx)), 3).select(
        "building_outline_id", "xmin", "ymin", "is_flooded", "flood_model_id"
    )


@query(
    "j14_depth_at_points",
    """WITH centres AS (SELECT DISTINCT raster_id, cx, cy, x, y FROM fx_cell),
       near AS (SELECT p.raster_id, p.point_id, arg_min((c.cx, c.cy), ((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.cx, c.cy)) AS cell
                FROM fx_probe p JOIN centres c ON c.raster_id = p.raster_id GROUP BY p.raster_id, p.point_id),
       series AS (SELECT n.raster_id, n.point_id, f.t, max(f.h) AS h FROM near n JOIN fx_cell f ON f.raster_id = n.raster_id AND f.cx = n.cell[1] AND f.cy = n.cell[2]
                  GROUP BY n.raster_id, n.point_id, f.t)
       SELECT raster_id, point_id, string_agg(t, ',' ORDER BY t) AS times, string_agg(h, ',' ORDER BY t) AS depths FROM series GROUP BY raster_id, point_id""",
)
def j14(fx):
    series = raster.depth_series(fx("fx_probe"), fx("fx_cell"))
    return series.select(
        "raster_id",
        "point_id",
        F.array_join(F.col("times").cast("array<string>"), ",").alias("times"),
        F.array_join(F.col("depths").cast("array<string>"), ",").alias("depths"),
    )


def entries(fx):
    return fx("fx_probe").select(F.col("point_id").alias("objectid"), F.col("x").alias("ex"), F.col("y").alias("ey"))


DISTANCE = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)"


@query(
    "j15_lowest_cell_near",
    f"""WITH b AS (SELECT p.point_id AS objectid, arg_min((c.x, c.y, c.z), (c.z, {DISTANCE}, c.x, c.y)) AS v
                   FROM fx_probe p JOIN fx_terrain c ON {DISTANCE} <= 300 * 300 GROUP BY p.point_id)
        SELECT objectid, v[1] AS x, v[2] AS y, v[3] AS z FROM b""",
)
def j15(fx):
    return raster.lowest_near(entries(fx), fx("fx_terrain"), 300.0)


@query(
    "j15_nearest_entry_cell",
    f"""WITH b AS (SELECT p.point_id AS objectid, arg_min((c.x, c.y, c.z), ({DISTANCE}, c.x, c.y)) AS v
                   FROM fx_probe p JOIN fx_terrain c ON {DISTANCE} <= 300 * 300 GROUP BY p.point_id)
        SELECT objectid, v[1] AS x, v[2] AS y, v[3] AS z FROM b""",
)
def j15_nearest(fx):
    return raster.nearest_entry_cell(entries(fx), fx("fx_terrain"), 300.0).select("objectid", "x", "y", "z")
