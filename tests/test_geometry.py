import math
import random

import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import projection as p
from terraloom.functions import text


def shapes(spark, *wkts):
    return spark.createDataFrame([(i, w) for i, w in enumerate(wkts)], "id int, wkt string").withColumn("geometry", g.from_wkt("wkt"))


@pytest.mark.parametrize(
    "wkt",
    [
        "POINT (1.5 -2)",
        "LINESTRING (0 0, 1 1, 2 0.25)",
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
        "MULTIPOINT ((0 0), (1 2))",
        "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
    ],
)
def test_wkt_round_trip(spark, wkt):
    assert shapes(spark, wkt).select(g.to_wkt("geometry")).first()[0] == wkt


def test_wkt_spelling_and_unknown_kinds(spark):
    df = shapes(spark, " polygon((0 0,1e1 0 , 10 10,0 0)) ", "GEOMETRYCOLLECTION (POINT (0 0))", None)
    rows = [r[0] for r in df.orderBy("id").select(g.to_wkt("geometry")).collect()]
    assert rows == ["POLYGON ((0 0, 10 0, 10 10, 0 0))", None, None]


def test_area_subtracts_holes(spark):
    df = shapes(spark, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "LINESTRING (0 0, 3 4)")
    rows = df.orderBy("id").select(g.area("geometry"), g.length("geometry")).collect()
    assert [tuple(r) for r in rows] == [(15.0, 20.0), (0.0, 5.0)]


SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"


@pytest.mark.parametrize(
    "other, meets, inside",
    [
        ("POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))", True, False),  # shares an edge
        ("POLYGON ((10 10, 12 10, 12 12, 10 10))", True, False),  # shares a corner
        ("POLYGON ((11 11, 12 11, 12 12, 11 11))", False, False),
        ("POLYGON ((2 2, 3 2, 3 3, 2 2))", True, True),
        ("POLYGON ((-5 -5, 15 -5, 15 15, -5 15, -5 -5))", True, False),  # surrounds the square
        ("LINESTRING (-1 5, 11 5)", True, False),  # passes through
        ("LINESTRING (1 1, 9 9)", True, True),
        ("LINESTRING (-3 8, 3 13)", False, False),  # boxes meet, shapes do not
        ("POINT (10 5)", True, True),
        ("POINT (5 5)", True, True),
        ("POINT (11 5)", False, False),
    ],
)
def test_predicates(spark, other, meets, inside):
    df = spark.createDataFrame([(SQUARE, other)], "a string, b string").select(g.from_wkt("a").alias("a"), g.from_wkt("b").alias("b"))
    row = df.select(g.intersects("a", "b"), g.intersects("b", "a"), g.contains("a", "b")).first()
    assert tuple(row) == (meets, meets, inside)


def test_hole_is_outside(spark):
    ring = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))"
    df = spark.createDataFrame([(ring, "POLYGON ((4 4, 5 4, 5 5, 4 4))")], "a string, b string").select(g.from_wkt("a").alias("a"), g.from_wkt("b").alias("b"))
    assert tuple(df.select(g.intersects("a", "b"), g.contains("a", "b")).first()) == (False, False)


def test_clip_to_box_matches_sampling(spark):
    rng = random.Random(3)
    rows = []
    for i in range(20):
        cx, cy = rng.uniform(-2, 12), rng.uniform(-2, 12)
        ring = [(cx + rng.uniform(2, 5) * math.cos(a), cy + rng.uniform(2, 5) * math.sin(a)) for a in [k * math.pi / 4 for k in range(8)]]
        rows.append((i, "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))", ring))
    df = spark.createDataFrame([(i, w) for i, w, _ in rows], "id int, wkt string").withColumn("geometry", g.from_wkt("wkt"))
    cut = g.clip_to_box("geometry", F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    got = {r[0]: r[1] for r in df.select("id", F.coalesce(g.area(cut), F.lit(0.0))).collect()}

    def inside(ring, x, y):
        hit = False
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                hit = not hit
        return hit

    step = 0.1
    for i, _, ring in rows:
        sampled = sum(inside(ring, (a + 0.5) * step, (b + 0.5) * step) for a in range(100) for b in range(100)) * step * step
        assert got[i] == pytest.approx(sampled, abs=0.6)


def test_segment_box_distance(spark):
    rows = [((-5, 5, 15, 5), 0), ((12, -5, 12, 15), 4), ((13, 14, 20, 30), 25), ((-4, 0, 0, -4), 8), ((3, 3, 4, 4), 0), ((5, 12, 5, 12), 4)]
    df = spark.createDataFrame([(*map(float, s), float(d)) for s, d in rows], "ax double, ay double, bx double, b_y double, want double")
    got = g.segment_box_distance_sq(g.point("ax", "ay"), g.point("bx", "b_y"), *(F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)))
    for row in df.select("want", got.alias("got")).collect():
        assert row["got"] == pytest.approx(row["want"])


def test_projection_round_trip_and_known_point(spark):
    grid = spark.range(60).select((F.lit(166.5) + F.col("id") % 10 * 1.2).alias("lon"), (F.lit(-47.5) + F.floor(F.col("id") / 10) * 2.5).alias("lat"))
    x, y = p.to_projected(F.col("lon"), F.col("lat"))
    back_lon, back_lat = p.to_geographic(F.col("x"), F.col("y"))
    moved = grid.withColumn("x", x).withColumn("y", y).select("*", back_lon.alias("lon2"), back_lat.alias("lat2"))
    for row in moved.collect():
        assert row["lon2"] == pytest.approx(row["lon"], abs=1e-9)
        assert row["lat2"] == pytest.approx(row["lat"], abs=1e-9)
    x0, y0 = p.to_projected(F.lit(173.0), F.lit(0.0))
    assert tuple(spark.range(1).select(x0, y0).first()) == pytest.approx((1600000.0, 10000000.0))


def test_unknown_projection_is_an_error():
    with pytest.raises(ValueError):
        p.transform_geometry("geometry", 3857, 2193)


def test_text_helpers(spark):
    df = spark.createDataFrame([("10m",), ("24h",), ("abc",)], "d string")
    assert [r[0] for r in df.select(text.duration_minutes(F.col("d"))).collect()] == [10, 1440, None]
    names = spark.createDataFrame([("/a/b/roads.v2.geojson",), ("plain",), ("/x/.hidden",)], "f string")
    got = [tuple(r) for r in names.select(text.file_stem(F.col("f")), text.file_suffix(F.col("f"))).collect()]
    assert got == [("roads.v2", ".geojson"), ("plain", ""), (".hidden", "")]
    json_rows = spark.createDataFrame([('{"b": 1, "a": {"y": 2.0, "x": "2"}}',), ('{"a":{"x":"2","y":2},"b":1}',)], "j string")
    assert len({r[0] for r in json_rows.select(text.canonical_json(F.col("j"))).collect()}) == 1
    crs = spark.createDataFrame([("urn:ogc:def:crs:EPSG::2193",), ("EPSG:4326",), ("urn:ogc:def:crs:EPSG:9.8:27200",), ("WGS84",)], "c string")
    assert [r[0] for r in crs.select(text.parse_epsg(F.col("c"))).collect()] == [2193, 4326, 27200, None]


def test_contains_with_notches(spark):
    """A line across a comb's notches leaves it; one below them, or along a tooth, does not."""
    comb = "POLYGON ((0 0, 12 0, 12 10, 9 10, 8 5, 7 10, 6 10, 3 10, 2 5, 1 10, 0 10, 0 0))"
    lines = {"LINESTRING (0.5 10, 11 10)": False, "LINESTRING (0.5 4, 11 4)": True, "LINESTRING (3 10, 6 10)": True, "LINESTRING (1 5, 11 5)": True, "LINESTRING (1 6, 11 6)": False}
    frame = spark.createDataFrame([(comb, wkt) for wkt in lines], "a string, b string")
    got = {r["b"]: r["c"] for r in frame.select("b", g.contains(g.from_wkt("a"), g.from_wkt("b")).alias("c")).collect()}
    assert got == lines
