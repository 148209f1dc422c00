"""Networks of many areas over small hand-made catchments."""

import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.operators import network

CATCHMENTS = {1: (0, 0, 10, 10), 2: (10, 0, 20, 10)}
MOUTHS = {1: (10, 5), 2: (20, 5)}
# Reach 3 ends on the border, where reach 4 of the other catchment begins; 5 crosses it; 6 closes a cycle; 7 stands alone.
REACHES = {1: (5, 5, 10, 5), 2: (2, 8, 5, 5), 3: (2, 2, 10, 2), 4: (10, 2, 15, 5), 5: (8, 8, 12, 8), 6: (15, 5, 20, 5), 7: (3, 9, 4, 9), 8: (15, 5, 15, 5)}


@pytest.fixture(scope="module")
def inputs(spark):
    catchments = spark.createDataFrame([(k, *map(float, v)) for k, v in CATCHMENTS.items()], "c bigint, xmin double, ymin double, xmax double, ymax double")
    mouths = spark.createDataFrame([(k, *map(float, v)) for k, v in MOUTHS.items()], "c bigint, x double, y double")
    reaches = spark.createDataFrame([(k, *map(float, v)) for k, v in REACHES.items()], "objectid bigint, ax double, ay double, bx double, by double")
    lines = reaches.select("objectid", g.line_geometry(F.array(g.point("ax", "ay"), g.point("bx", "by"))).alias("geometry"), F.lit("note").alias("edge_direction"))
    nothing = spark.createDataFrame([(9,)], "objectid bigint").select("objectid", F.lit(None).cast(g.GEOMETRY_TYPE).alias("geometry"), F.lit(None).cast("string").alias("edge_direction"))
    return lines.unionByName(nothing), catchments.select("c", g.box_geometry(*g.BOX).alias("geometry")), mouths


def areas(spark, *rows):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in rows], "aoi_id bigint, xmin double, ymin double, xmax double, ymax double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_areas_share_catchments(spark, inputs):
    asked = areas(spark, (1, (1, 1, 6, 6)), (2, (12, 1, 21, 6)), (3, (9, 1, 11, 9)), (4, (50, 50, 60, 60)))
    nodes, kept, excluded = network.build_networks(asked, *inputs, "c", 8.0)
    first = [(1, "to", "crossing"), (2, "to", "crossing")]
    assert rows(kept.filter("aoi_id = 1"), "objectid", "edge_direction", "intersection_type") == first
    assert rows(kept.filter("aoi_id = 2"), "objectid", "edge_direction", "intersection_type") == [(4, "to", "crossing"), (6, "to", "inside")]
    assert rows(kept.filter("aoi_id = 3"), "objectid", "edge_direction") == [(1, "to"), (2, "to"), (4, "to"), (6, "to")]
    alone, level, stray = network.CAUSE_UNCONNECTED, network.CAUSE_DIRECTION, network.CAUSE_CATCHMENT
    assert rows(excluded.filter("aoi_id = 1"), "objectid", "exclusion_cause") == [(3, alone), (5, stray), (7, alone)]
    assert rows(excluded.filter("aoi_id = 2"), "objectid", "exclusion_cause") == [(5, stray), (8, level)]
    assert rows(excluded.filter("aoi_id = 3"), "objectid", "exclusion_cause") == [(3, alone), (5, stray), (7, alone), (8, level)]
    assert not rows(nodes.filter("aoi_id = 4"), "node_id")
    # The point (10, 2) is a node of either catchment.
    border = nodes.filter("aoi_id = 3 AND x = 10 AND y = 2").agg(F.count("*"), F.countDistinct("node_id")).first()
    assert tuple(border) == (2, 2)


def test_no_rows(spark, inputs):
    reaches, catchments, mouths = inputs
    asked = areas(spark, (1, (0, 0, 30, 30)))
    for part in network.build_networks(asked, reaches.limit(0), catchments, mouths, "c", 8.0):
        assert part.isEmpty()


def test_stored_networks(spark, inputs, tmp_path):
    spark.sql(f"CREATE DATABASE nets LOCATION '{tmp_path}/nets'")
    where = (str(tmp_path / "root"), "nets.networks", "nets.exclusions")
    one, both = areas(spark, (1, (1, 1, 6, 6))), areas(spark, (1, (1, 1, 6, 6)), (2, (12, 1, 21, 6)), (3, (2, 2, 3, 3)))
    assert rows(network.networks_of_areas(spark, one, *inputs, "c", 8.0, *where), "aoi_id", "rec_network_id") == [(1, 1)]
    excluded = rows(spark.table("nets.exclusions"), "rec_network_id", "objectid")
    # Area 3 lies in the stored network of area 1.
    found = network.networks_of_areas(spark, both, *inputs, "c", 8.0, *where)
    assert rows(found, "aoi_id", "rec_network_id") == [(1, 1), (2, 2), (3, 1)]
    edges = rows(spark.read.parquet(f"{where[0]}/edges"), "rec_network_id", "objectid")
    assert edges == [(1, 1), (1, 2), (2, 4), (2, 6)]
    # A run that died before its metadata row: the next one takes the same id and leaves nothing twice.
    spark.table("nets.networks").filter("rec_network_id = 1").write.saveAsTable("nets.before_death")
    network.networks_of_areas(spark, both, *inputs, "c", 8.0, where[0], "nets.before_death", where[2])
    assert rows(spark.read.parquet(f"{where[0]}/edges"), "rec_network_id", "objectid") == edges
    assert rows(spark.table("nets.exclusions"), "rec_network_id", "objectid") == excluded + [(2, 5), (2, 8)]
