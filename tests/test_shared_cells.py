"""Thiessen cells whose neighbours are looked up once per site, tide locations and pages that stay small."""

import random

from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.operators import boundary, overlay, raster
from terraloom.operators import spatial_join as sj
from terraloom.sources import features

BOXES = "xmin double, ymin double, xmax double, ymax double"


def test_neighbours_are_looked_up_once_per_site(spark, monkeypatch):
    """Areas that overlap share the neighbours of their sites; a dense cluster takes the way of crowded blocks."""
    made = []

    class Watched(overlay.Pyramid):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(overlay, "Pyramid", Watched)
    monkeypatch.setattr(overlay, "BISECTORS_PER_CHUNK", 12)
    rng = random.Random(4)
    places = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) if i % 2 else (i, rng.uniform(40, 41), rng.uniform(40, 41)) for i in range(60)]
    # One place twice under two ids, one row twice, one without an id.
    rows = [*places, (99, *places[0][1:]), places[7], (None, 12.0, 12.0)]
    boxes = [(k, float(k), 0.0, 70.0 + k, 100.0 - k) for k in range(12)]
    areas = spark.createDataFrame([*boxes, boxes[3]], f"aoi_id int, {BOXES}")
    got = overlay.thiessen_cells(areas, spark.createDataFrame(rows, "site_id int, x double, y double"), 25.0).collect()
    assert [p.points.count() for p in made] == [61]
    for k, x0, y0, x1, y1 in boxes:
        inside = [(s, x, y) for s, x, y in [*places, (None, 12.0, 12.0)] if x0 <= x <= x1 and y0 <= y <= y1]
        cells = [r for r in got if r["aoi_id"] == k]
        named = sorted(r["site_id"] for r in cells)
        once = sorted([s for s, *_ in inside if s is not None] + [s for s, *_ in inside if s == 7])
        assert named == (sorted(once * 2) if k == 3 else once)
        for r in cells:
            own = next(p for p in inside if p[0] == r["site_id"])
            ring = [(p["x"], p["y"]) for p in r["geometry"]["parts"][0][0]]
            # No corner is nearer to another site of the area, and the area of the ring is the cell's.
            for px, py in ring:
                assert (own[1] - px) ** 2 + (own[2] - py) ** 2 <= min((x - px) ** 2 + (y - py) ** 2 for _, x, y in inside) + 1e-6
            assert abs(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2 - r["cell_area"]) < 1e-6
        missing = 0.0 if not any(s is None for s, *_ in inside) else None
        if missing == 0.0:
            each = {r["site_id"]: r["cell_area"] for r in cells}
            assert abs(sum(each.values()) - (x1 - x0) * (y1 - y0)) < 1e-6


def test_an_area_of_several_boxes_has_the_sites_of_all(spark):
    areas = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (1, 4.0, 0.0, 8.0, 4.0), (2, 0.0, 0.0, 4.0, 4.0)], f"aoi_id int, {BOXES}")
    sites = spark.createDataFrame([(1, 1.0, 2.0), (2, 5.0, 2.0)], "site_id int, x double, y double")
    got = {(r["aoi_id"], r["site_id"]): r["cell_area"] for r in overlay.thiessen_cells(areas, sites, 5.0).collect()}
    assert got == {(1, 1): 12.0, (1, 2): 16.0, (2, 1): 16.0}


def test_sides_by_a_near_end_take_no_segment_distance(spark, monkeypatch):
    areas = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 300.0, 0.0, 400.0, 100.0)], f"aoi_id int, {BOXES}")
    ends = [(50.0, -3.0, 50.0, -60.0), (104.0, 50.0, 180.0, 50.0), (-1.0, 60.0, 1.0, 60.0)]
    line = g.line_geometry(F.array(g.point("a", "b"), g.point("c", "d"))).alias("geometry")
    # Passes the second area's top, with both ends far from it.
    far = [(200.0, 104.0, 500.0, 104.0)]
    coast = spark.createDataFrame([*ends, *far], "a double, b double, c double, d double").select(line)
    found = {(r["aoi_id"], r["position"]) for r in boundary.tide_query_locations(areas, coast, 5.0).collect()}
    assert found == {(1, "bottom"), (1, "right"), (1, "left"), (2, "top")}
    monkeypatch.setattr(g, "segment_box_distance_sq", lambda *_: F.raise_error(F.lit("not to be measured")).cast("double"))
    near = spark.createDataFrame(ends, "a double, b double, c double, d double").select(line)
    assert boundary.tide_query_locations(areas.filter("aoi_id = 1"), near, 5.0).count() == 3


def test_crowded_pages_become_several(spark, tmp_path):
    """Pages keep their numbers and none holds more features than a reader may take; equal features count each."""
    rows = spark.range(200).select(F.when(F.col("id") < 90, 3).when(F.col("id") < 180, 4).otherwise(5).alias("page"), F.when(F.col("id") < 90, F.col("id")).otherwise(F.floor(F.col("id") / 90) * 1000).alias("id"))
    shape = F.format_string('{"type":"Feature","properties":{"ID":%d},"geometry":{"type":"Point","coordinates":[%d,1]}}', "id", "id")
    boxed = rows.select("page", shape.alias("feature"), *(F.col("id").cast("double").alias(s) for s in g.BOX))
    folder = str(tmp_path / "layer")
    features.store_pages(boxed, folder, [{"name": "ID", "type": "esriFieldTypeOID"}], page_size=20)
    index = spark.read.parquet(f"{folder}/{features.INDEX}").collect()
    assert sum(r["n"] for r in index) == 200 and max(r["n"] for r in index) <= 20
    assert len({r["offset"] for r in index}) == len(index) and {r["offset"] for r in index if r["n"] == 20 and r["xmin"] == 2000.0} >= {5}
    found = features.fetch_features(spark, path=folder, transport="files")
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.collect())


def test_terrain_is_not_listed_in_many_cells(spark, monkeypatch):
    entries = spark.createDataFrame([(1, 5.0, 5.0), (2, 900.0, 0.0)], "objectid int, ex double, ey double")
    terrain = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), (F.col("id") % 7).alias("z"))
    listed, inner = [], sj._gridded

    def watched(*args):
        sides = inner(*args)
        listed.extend(side for side in sides[:2] if "z" in side.columns)
        return sides

    monkeypatch.setattr(sj, "_gridded", watched)
    got = [tuple(r) for r in raster.lowest_near(entries, terrain, 2.0).collect()]
    best = min((z, (x - 5) ** 2 + (y - 5) ** 2, x, y) for i in range(100) for x, y, z in [(i % 10, i // 10, i % 7)] if (x - 5) ** 2 + (y - 5) ** 2 <= 4)
    assert got == [(1, float(best[2]), float(best[3]), best[0])]
    assert [side.count() for side in listed] == [100]
