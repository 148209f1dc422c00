"""Tests of pairs in batches, against the column expressions of the geometry functions."""

import random

from pyspark.sql import functions as F

from terraloom.functions import crossing
from terraloom.functions import geometry as g
from terraloom.functions import pairs
from terraloom.operators import boundary, network


def test_segments_near_boxes(spark):
    rng = random.Random(4)
    ends = []
    for k in range(150):
        values = [float(rng.randint(-6, 16)) if k % 2 else rng.uniform(-6, 16) for _ in range(4)]
        if k % 7 == 0:
            values[2:] = values[:2]
        if k % 5 == 0:
            values[k % 4] = None
        ends.append(tuple(values))
    boxes = [(k if k else None, x, y, x + rng.randint(0, 5), y + rng.randint(0, 5)) for k in range(12) for x, y in [(rng.randint(0, 6), rng.randint(0, 6))]]
    areas = spark.createDataFrame(boxes, "aoi_id long, xmin long, ymin long, xmax long, ymax long")
    coast = spark.createDataFrame(ends, "a double, b double, c double, d double")
    near = boundary.coastline_near(areas, coast.select(g.line_geometry(F.array(g.point("a", "b"), g.point("c", "d"))).alias("geometry")), 3.0, 5.0)
    sa, sb, box = g.point("a", "b"), g.point("c", "d"), [F.col(s).cast("double") for s in g.BOX]
    met = g.boxes_intersect([F.least("a", "c"), F.least("b", "d"), F.greatest("a", "c"), F.greatest("b", "d")], g.grow(box, 3.0))
    want = coast.crossJoin(areas).filter(met).select("aoi_id", sa.alias("sa"), sb.alias("sb"), g.segment_box_distance_sq(sa, sb, *box).alias("dist_sq"), *g.BOX).filter("dist_sq <= 9")
    assert sorted(map(str, near.collect())) == sorted(map(str, want.collect()))
    assert 100 < want.count() < 1500


def test_coast_is_measured_in_batches(spark):
    areas = spark.createDataFrame([(1, 0, 0, 10, 10), (None, 0, 0, 5, 5)], "aoi_id long, xmin long, ymin long, xmax long, ymax long")
    coast = spark.createDataFrame([(12.0, 0.0, 12.0, 9.0), (30.0, 30.0, 40.0, 40.0)], "x0 double, y0 double, x1 double, y1 double")
    near = boundary.coastline_near(areas, coast.select(g.line_geometry(F.array(g.point("x0", "y0"), g.point("x1", "y1"))).alias("geometry")), 3.0, 20.0)
    assert "MapInArrow" in near._jdf.queryExecution().executedPlan().toString()
    assert [(r.aoi_id, tuple(r.sa), tuple(r.sb), r.dist_sq, r.xmax) for r in near.collect()] == [(1, (12.0, 0.0), (12.0, 9.0), 4.0, 10)]


def shapes(spark):
    """Squares, notched and holed polygons, and lines on a small grid, so that vertices and edges often touch."""
    rng = random.Random(9)
    rings = [
        [(0, 0), (8, 0), (8, 8), (0, 8)], [(0, 0), (8, 0), (8, 8), (4, 4), (0, 8)], [(0, 4), (4, 0), (8, 4), (4, 8)],
        [(0, 0), (8, 0), (8, 8), (6, 8), (6, 2), (2, 2), (2, 8), (0, 8)],
    ]
    polygons = [(k, [[list(map(float, p)) for p in [*ring, ring[0]]]]) for k, ring in enumerate(rings)]
    polygons.append((9, [polygons[0][1][0], [[3.0, 3.0], [5.0, 3.0], [5.0, 5.0], [3.0, 5.0], [3.0, 3.0]]]))
    lines = [(k, [[float(rng.randint(0, 8)), float(rng.randint(0, 8))] for _ in range(rng.choice([1, 2, 2, 3, 5]))]) for k in range(400)]
    lines = [(k, [p for i, p in enumerate(line) if not i or p != line[i - 1]]) for k, line in lines]

    def points(ring):
        return F.transform(ring, lambda p: g.point(p[0], p[1]))

    areas = spark.createDataFrame(polygons, "zone_id long, r array<array<array<double>>>").select("zone_id", g.geometry("POLYGON", F.array(F.transform("r", points))).alias("geometry"))
    return areas, spark.createDataFrame(lines, "objectid long, r array<array<double>>").select("objectid", g.line_geometry(points(F.col("r"))).alias("geometry"))


def test_contained_lines(spark, monkeypatch):
    areas, lines = shapes(spark)
    both = areas.select("zone_id", F.col("geometry").alias("a")).crossJoin(lines.select("objectid", F.col("geometry").alias("b")))
    want = {tuple(r) for r in both.filter(g.contains("a", "b")).select("objectid", "zone_id").collect()}
    assert 50 < len(want) < 1500
    best = {}
    for line, zone in sorted(want, reverse=True):
        best[line] = zone
    for compared in (pairs.COMPARED, 30):
        monkeypatch.setattr(pairs, "COMPARED", compared)
        monkeypatch.setattr(crossing, "PAIRS", compared)
        tagged = network.tag_catchments(lines, areas, "zone_id", 3.0)
        assert "MapInArrow" in tagged._jdf.queryExecution().executedPlan().toString()
        assert {r.objectid: r.zone_id for r in tagged.collect()} == {k: best.get(k) for k in range(400)}


def test_line_that_stays_at_a_vertex(spark):
    areas, lines = shapes(spark)
    still = lines.limit(1).select("objectid", g.line_geometry(F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in ((8.0, 8.0), (8.0, 8.0), (7.0, 7.5))))).alias("geometry"))
    assert network.tag_catchments(still, areas.filter("zone_id = 0"), "zone_id", 3.0).first().zone_id == 0


def test_boxes_settle_pairs(spark):
    """A box and its neighbours' boxes settle most pairs; the outcome is that of the segments."""
    areas, lines = shapes(spark)
    box = g.box_geometry(F.lit(2.0), F.lit(1.0), F.lit(6.0), F.lit(5.0))
    # The same rectangle with a fifth corner on a side, which is looked at by its segments.
    ring = F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in ((2.0, 1.0), (4.0, 1.0), (6.0, 1.0), (6.0, 5.0), (2.0, 5.0), (2.0, 1.0))))
    by_ring = g.geometry("POLYGON", F.array(F.array(ring)))
    every = areas.select("geometry").unionByName(lines.select("geometry"))
    tests = [f(*pair) for f, pairs_ in ((g.intersects, ((box, "geometry"), (by_ring, "geometry"), ("geometry", box))), (g.contains, ((box, "geometry"), (by_ring, "geometry")))) for pair in pairs_]
    for i, i_ring, i_turned, c, c_ring in every.select(*(t.alias(f"t{k}") for k, t in enumerate(tests))).collect():
        assert i == i_ring == i_turned and c == c_ring


def test_facing_sides_of_crowded_areas(spark, monkeypatch):
    """One segment near a side tells; however batches and blocks are cut, the sides are those of all pairs."""
    rng = random.Random(8)
    boxes = [(k if k else None, x, y, x + rng.randint(1, 30), y + rng.randint(1, 30)) for k in range(40) for x, y in [(rng.randint(0, 90), rng.randint(0, 90))]]
    areas = spark.createDataFrame([*boxes, (5, 70, 70, 75, 71)], "aoi_id long, xmin long, ymin long, xmax long, ymax long")
    ends = [(x, y, x + rng.uniform(-9, 9), None if k % 9 == 0 else y + rng.uniform(-9, 9)) for k in range(150) for x, y in [(rng.uniform(0, 60), rng.uniform(0, 120))]]
    coast = spark.createDataFrame(ends, "a double, b double, c double, d double").select(g.line_geometry(F.array(g.point("a", "b"), g.point("c", "d"))).alias("geometry"))
    middle = [(F.col(f"sa.{c}") + F.col(f"sb.{c}")) / 2.0 for c in "xy"]
    near = boundary.coastline_near(areas, coast, 2.5, 10.0).select("aoi_id", boundary.nearest_side(*middle).alias("position")).distinct()
    want = boundary.side_centroids(boundary.sides(areas)).join(near, ["aoi_id", "position"], "left_semi")
    want = sorted(map(str, want.collect()))
    assert 20 < len(want) < 120
    found = boundary.tide_query_locations(areas, coast, 2.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_part" in plan
    assert sorted(map(str, found.collect())) == want
    monkeypatch.setattr(crossing, "PAIRS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(str, boundary.tide_query_locations(areas, coast, 2.5).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
