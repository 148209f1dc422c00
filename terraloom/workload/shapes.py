"""Geometry functions, projection, boundaries, spatial joins and overlays on shapes."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection as p
from ..operators import boundary, overlay
from ..operators import catalog
from ..operators import spatial_join as sj
from . import fixtures  # noqa: F401
from .areas import CELL
from .registry import query


def zones(fx):
    return fx("fx_zone").withColumn("geometry", g.from_wkt("wkt"))


def reaches(fx):
    return fx("fx_reach").select("objectid", g.from_wkt("wkt").alias("geometry"))


def areas(fx):
    return fx("fx_aoi")


def rounded(value, digits):
    """``F.round``, which goes by the decimal text of every number; this does so only where it is close to a half."""
    value, scale = F.col(value) if isinstance(value, str) else value, 10.0**digits
    nearest = F.rint(value * scale)
    told = (F.abs(value * scale - nearest) < 0.499) & (F.abs(value * scale) < 1e12)
    return F.when(told, nearest / scale + 0.0).otherwise(F.round(value, digits))


ZONE_TEXT = (
    "'POLYGON ((' || (cx - a) || ' ' || cy || ', ' || cx || ' ' || (cy - b) || ', ' || (cx + c) || ' ' || cy || ', ' || cx || ' '"
    " || (cy + d) || ', ' || (cx - a) || ' ' || cy || '))'"
)


@query("sp1_wkt_round_trip", f"SELECT zone_id, {ZONE_TEXT} AS wkt, 'POLYGON' AS kind FROM fx_zone")
def sp1(fx):
    return zones(fx).select("zone_id", g.to_wkt("geometry").alias("wkt"), "geometry.kind")


@query("sp1_geojson_parts", "SELECT objectid, x0, y0, x2, y2, 3 AS points FROM fx_reach")
def sp1_geojson(fx):
    xy = [F.concat(F.lit("["), f"x{i}", F.lit(", "), f"y{i}", F.lit("]")) for i in range(3)]
    text = F.concat(F.lit('{"type": "LineString", "coordinates": ['), F.concat_ws(", ", *xy), F.lit("]}"))
    parsed = fx("fx_reach").select("objectid", g.from_geojson(text).alias("geometry"))
    ends = {"0": g.first_point("geometry"), "2": g.last_point("geometry")}
    return parsed.select(
        "objectid",
        *(point[axis].cast("long").alias(f"{axis}{i}") for i, point in ends.items() for axis in ("x", "y")),
        F.size(F.flatten(F.flatten("geometry.parts"))).alias("points"),
    )


@query("sp2_bounds", "SELECT zone_id, cx - a AS xmin, cy - b AS ymin, cx + c AS xmax, cy + d AS ymax FROM fx_zone")
def sp2(fx):
    return zones(fx).select("zone_id", *(F.col(f"geometry.{s}").cast("long").alias(s) for s in g.BOX))


@query("a3_total_bounds", "SELECT min(cx - a) AS xmin, min(cy - b) AS ymin, max(cx + c) AS xmax, max(cy + d) AS ymax FROM fx_zone")
def a3(fx):
    total = g.bounds(zones(fx))
    return total.select(*(F.col(s).cast("long").alias(s) for s in g.BOX))


@query(
    "sp3_boxes",
    """SELECT aoi_id, 'POLYGON ((' || xmin || ' ' || ymin || ', ' || xmax || ' ' || ymin || ', ' || xmax || ' ' || ymax || ', ' || xmin || ' '
       || ymax || ', ' || xmin || ' ' || ymin || '))' AS wkt FROM fx_aoi""",
)
def sp3(fx):
    return areas(fx).select("aoi_id", g.to_wkt(g.box_geometry(*g.BOX)).alias("wkt"))


@query(
    "sp4_area_length",
    """SELECT zone_id, CAST((a + c) * (b + d) / 2 AS BIGINT) AS area, round(sqrt(a * a + b * b) + sqrt(b * b + c * c) + sqrt(c * c + d * d) + sqrt(d * d + a * a), 4) AS perimeter
       FROM fx_zone""",
)
def sp4(fx):
    return zones(fx).select("zone_id", g.area("geometry").cast("long").alias("area"), F.round(g.length("geometry"), 4).alias("perimeter"))


# A rectangle misses a convex diamond when the boxes miss or all its corners lie beyond one edge.
CORNERS = [("{r}.xmin", "{r}.ymin"), ("{r}.xmax", "{r}.ymin"), ("{r}.xmax", "{r}.ymax"), ("{r}.xmin", "{r}.ymax")]
EDGES = [("z.cx - z.a", "z.cy", "z.cx", "z.cy - z.b"), ("z.cx", "z.cy - z.b", "z.cx + z.c", "z.cy"), ("z.cx + z.c", "z.cy", "z.cx", "z.cy + z.d"), ("z.cx", "z.cy + z.d", "z.cx - z.a", "z.cy")]


def beyond(edge, x, y, strict=True):
    x0, y0, x1, y1 = edge
    return f"(({x1}) - ({x0})) * (({y}) - ({y0})) - (({y1}) - ({y0})) * (({x}) - ({x0})) {'<' if strict else '<='} 0"


def diamond_meets(r):
    apart = " OR ".join("(" + " AND ".join(beyond(e, x.format(r=r), y.format(r=r)) for x, y in CORNERS) + ")" for e in EDGES)
    return (
        f"z.cx - z.a <= {r}.xmax AND {r}.xmin <= z.cx + z.c AND z.cy - z.b <= {r}.ymax AND {r}.ymin <= z.cy + z.d AND NOT ({apart})"
    )


def inside_diamond(x, y):
    return "NOT (" + " OR ".join(beyond(e, x, y) for e in EDGES) + ")"


def zone_area_pairs(fx, refine):
    boxed = zones(fx).select("zone_id", "geometry", *(F.col(f"geometry.{s}").alias(f"z_{s}") for s in g.BOX))
    shaped = areas(fx).select("aoi_id", *g.BOX, g.box_geometry(*g.BOX).alias("area"))
    return sj.intersecting_pairs(boxed, shaped, CELL, left_box=[f"z_{s}" for s in g.BOX], refine=refine).select("zone_id", "aoi_id")


@query("sp5_intersects", f"SELECT zone_id, aoi_id FROM fx_zone z JOIN fx_aoi r ON {diamond_meets('r')}")
def sp5(fx):
    return zone_area_pairs(fx, g.intersects("geometry", "area", b_is_box=True))


@query(
    "sp5_contains",
    "SELECT zone_id, aoi_id FROM fx_zone z JOIN fx_aoi r ON r.xmin <= cx - a AND cx + c <= r.xmax AND r.ymin <= cy - b AND cy + d <= r.ymax",
)
def sp5_contains(fx):
    return zone_area_pairs(fx, g.contains("area", "geometry"))


@query(
    "sp6_exploded_parts",
    """SELECT zone_id, part_no, 'POLYGON' AS kind, CAST((a + c) * (b + d) / 2 AS BIGINT) AS area, cx - a + part_no * 100000 AS xmin
       FROM fx_zone CROSS JOIN (SELECT unnest([0, 1]) AS part_no) p""",
)
def sp6(fx):
    def ring(shift):
        pts = [("cx - a", "cy"), ("cx", "cy - b"), ("cx + c", "cy"), ("cx", "cy + d"), ("cx - a", "cy")]
        texts = [F.concat(F.expr(f"{x} + {shift}").cast("string"), F.lit(" "), F.expr(y).cast("string")) for x, y in pts]
        return F.concat(F.lit("(("), F.concat_ws(", ", *texts), F.lit("))"))

    text = F.concat(F.lit("MULTIPOLYGON("), ring(0), F.lit(","), ring(100000), F.lit(")"))
    multi = fx("fx_zone").select("zone_id", g.from_wkt(text).alias("geometry"))
    return g.explode_parts(multi).select(
        "zone_id", "part_no", "geometry.kind", g.area("geometry").cast("long").alias("area"), F.col("geometry.xmin").cast("long").alias("xmin")
    )


# ---------------------------------------------------------------- projection


def forward_sql(lon, lat):
    """Select-list CTE text of the forward projection, for the checking engine."""
    sums = {
        "e": " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(p.FORWARD, 1)),
        "n": " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(p.FORWARD, 1)),
    }
    return f"""s1 AS (SELECT *, radians({lat}) AS phi, radians({lon} - {p.CENTRAL_MERIDIAN}) AS lam FROM src),
    s2 AS (SELECT *, sinh(atanh(sin(phi)) - {p._ECC!r} * atanh({p._ECC!r} * sin(phi))) AS tt FROM s1),
    s3 AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM s2),
    moved AS (SELECT *, {p.FALSE_EASTING} + {p._RADIUS!r} * (eta + {sums['e']}) AS east, {p.FALSE_NORTHING} + {p._RADIUS!r} * (xi + {sums['n']}) AS north FROM s3)"""


def inverse_sql(x, y):
    minus = {
        "xi": "".join(f" - {c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(p.INVERSE, 1)),
        "eta": "".join(f" - {c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(p.INVERSE, 1)),
    }
    plus = "".join(f" + {c!r} * sin({2 * j} * chi)" for j, c in enumerate(p.LATITUDE, 1))
    return f"""s1 AS (SELECT *, ({y} - {p.FALSE_NORTHING}) / {p._RADIUS!r} AS xi, ({x} - {p.FALSE_EASTING}) / {p._RADIUS!r} AS eta FROM src),
    s2 AS (SELECT *, xi{minus['xi']} AS xi0, eta{minus['eta']} AS eta0 FROM s1),
    s3 AS (SELECT *, asin(sin(xi0) / cosh(eta0)) AS chi FROM s2),
    moved AS (SELECT *, {p.CENTRAL_MERIDIAN} + degrees(atan2(sinh(eta0), cos(xi0))) AS lon, degrees(chi{plus}) AS lat FROM s3)"""


@query(
    "crs1_to_projected",
    f"WITH src AS (SELECT * FROM fx_degree), {forward_sql('lon', 'lat')} SELECT id, round(east, 2) AS x, round(north, 2) AS y FROM moved",
)
def crs1(fx):
    x, y = p.to_projected(F.col("lon"), F.col("lat"))
    return fx("fx_degree").select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query(
    "crs1_to_geographic",
    f"WITH src AS (SELECT asset_id, xmin AS x, ymin AS y FROM fx_asset), {inverse_sql('x', 'y')} SELECT asset_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM moved",
)
def crs1_inverse(fx):
    lon, lat = p.to_geographic(F.col("xmin"), F.col("ymin"))
    return fx("fx_asset").select("asset_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(
    "crs2_wkt_to_box",
    f"""WITH src AS (SELECT id, lon + dx AS lon, lat + dy AS lat FROM fx_degree CROSS JOIN (SELECT unnest([0, 0.05]) AS dx) u
                     CROSS JOIN (SELECT unnest([0, 0.03]) AS dy) v), {forward_sql('lon', 'lat')}
        SELECT id, round(min(east), 2) AS xmin, round(min(north), 2) AS ymin, round(max(east), 2) AS xmax, round(max(north), 2) AS ymax
        FROM moved GROUP BY id""",
)
def crs2(fx):
    lon, lat = F.col("lon"), F.col("lat")
    corner = [(0.0, 0.0), (0.05, 0.0), (0.05, 0.03), (0.0, 0.03), (0.0, 0.0)]
    texts = [F.concat((lon + dx).cast("string"), F.lit(" "), (lat + dy).cast("string")) for dx, dy in corner]
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *texts), F.lit("))"))
    moved = fx("fx_degree").select("id", p.wkt_to_working_box(wkt).alias("b"))
    return moved.select("id", *(F.round(f"b.{s}", 2).alias(s) for s in g.BOX))


@query(
    "sp7_layer_extents",
    f"""WITH src AS (SELECT zone_id % 10 AS layer, v.x, v.y FROM fx_zone z, LATERAL (SELECT z.cx - z.a AS x, z.cy AS y UNION ALL SELECT z.cx, z.cy - z.b
                     UNION ALL SELECT z.cx + z.c, z.cy UNION ALL SELECT z.cx, z.cy + z.d) v), {inverse_sql('x', 'y')}
        SELECT 'layer_' || layer AS layer_name, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, round(min(lon), 7) AS geo_xmin,
               round(min(lat), 7) AS geo_ymin, round(max(lon), 7) AS geo_xmax, round(max(lat), 7) AS geo_ymax FROM moved GROUP BY layer""",
)
def sp7(fx):
    layers = zones(fx).select(F.concat(F.lit("layer_"), (F.col("zone_id") % 10).cast("string")).alias("layer_name"), "geometry")
    found = catalog.layer_extents(layers)
    return found.select(
        "layer_name", *(F.col(s).cast("long").alias(s) for s in g.BOX), *(F.round(f"geo_{s}", 7).alias(f"geo_{s}") for s in g.BOX)
    )


# ---------------------------------------------------------------- boundary

SIDE_ROWS = """sides AS (SELECT aoi_id, 'bottom' AS position, xmin AS x0, ymin AS y0, xmax AS x1, ymin AS y1 FROM fx_aoi
  UNION ALL SELECT aoi_id, 'right', xmax, ymin, xmax, ymax FROM fx_aoi UNION ALL SELECT aoi_id, 'top', xmin, ymax, xmax, ymax FROM fx_aoi
  UNION ALL SELECT aoi_id, 'left', xmin, ymin, xmin, ymax FROM fx_aoi)"""


@query("sp8_boundary_sides", f"WITH {SIDE_ROWS} SELECT * FROM sides")
def sp8(fx):
    return boundary.sides(areas(fx)).select("aoi_id", "position", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("sp9_side_centroids", f"WITH {SIDE_ROWS} SELECT aoi_id, position, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM sides")
def sp9(fx):
    return boundary.side_centroids(boundary.sides(areas(fx)))


@query("sp11_line_ends", "SELECT objectid, x0 AS first_x, y0 AS first_y, x2 AS last_x, y2 AS last_y FROM fx_reach")
def sp11(fx):
    first, last = g.first_point("geometry"), g.last_point("geometry")
    return reaches(fx).select(
        "objectid",
        first["x"].cast("long").alias("first_x"),
        first["y"].cast("long").alias("first_y"),
        last["x"].cast("long").alias("last_x"),
        last["y"].cast("long").alias("last_y"),
    )


CROSSED = f"""WITH {SIDE_ROWS},
segs AS (SELECT objectid, x0 AS ax, y0 AS ay, x1 AS qx, y1 AS qy, 0.0::DOUBLE AS ahead, x0 AS fx, y0 AS fy FROM fx_reach
  UNION ALL SELECT objectid, x1, y1, x2, y2, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))::DOUBLE, x0, y0 FROM fx_reach),
solved AS (SELECT aoi_id, objectid, ax, ay, qx, qy, ahead, fx, fy, x0, y0, x1, y1, position,
  CASE WHEN position IN ('bottom', 'top') THEN (y0 - ay)::DOUBLE / nullif(qy - ay, 0) ELSE (x0 - ax)::DOUBLE / nullif(qx - ax, 0) END AS t
  FROM segs JOIN sides ON least(ax, qx) <= x1 AND greatest(ax, qx) >= x0 AND least(ay, qy) <= y1 AND greatest(ay, qy) >= y0),
points AS (SELECT aoi_id, objectid, fx, fy, CASE WHEN position IN ('bottom', 'top') THEN ax + t * (qx - ax) ELSE x0 END AS x,
  CASE WHEN position IN ('bottom', 'top') THEN y0 ELSE ay + t * (qy - ay) END AS y,
  ahead + t * sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) AS distance, x0, y0, x1, y1 FROM solved WHERE t >= 0 AND t <= 1),
crossed AS (SELECT aoi_id, objectid, fx, fy, x, y, min(distance) AS distance FROM points
  WHERE x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY ALL),
ranked AS (SELECT c.*, row_number() OVER w AS crossing_no, count(*) OVER (PARTITION BY c.aoi_id, objectid) AS crossing_count,
  fx > xmin AND fx < xmax AND fy > ymin AND fy < ymax AS starts_inside FROM crossed c JOIN fx_aoi a ON a.aoi_id = c.aoi_id
  WINDOW w AS (PARTITION BY c.aoi_id, objectid ORDER BY distance, x, y)),
labelled AS (SELECT *, CASE WHEN (crossing_no % 2 = 1) <> starts_inside THEN 'inflow' ELSE 'outflow' END AS flow FROM ranked)"""


def classified(fx):
    points = boundary.crossings(reaches(fx), areas(fx), CELL, numbered=True)
    return boundary.classify_crossings(points)


@query("sp12_boundary_crossings", f"{CROSSED} SELECT aoi_id, objectid, round(x, 4) AS x, round(y, 4) AS y, round(distance, 4) AS distance FROM crossed")
def sp12(fx):
    points = boundary.crossings(reaches(fx), areas(fx), CELL)
    return points.select("aoi_id", "objectid", *(rounded(c, 4).alias(c) for c in ("x", "y", "distance")))


@query(
    "sp13_crossing_distance",
    f"{CROSSED} SELECT aoi_id, objectid, round(min(distance), 4) AS first_distance, round(max(distance), 4) AS last_distance FROM crossed GROUP BY aoi_id, objectid",
)
def sp13(fx):
    points = boundary.crossings(reaches(fx), areas(fx), CELL, numbered=True)
    ends = boundary.crossing_distances(points)
    return ends.select("aoi_id", "objectid", *(rounded(c, 4).alias(c) for c in ("first_distance", "last_distance")))


@query(
    "w13_crossing_flow",
    f"{CROSSED} SELECT aoi_id, objectid, crossing_no, crossing_count, flow, round(distance, 4) AS distance FROM labelled",
)
def w13(fx):
    return classified(fx).select("aoi_id", "objectid", "crossing_no", "crossing_count", "flow", rounded("distance", 4).alias("distance"))


@query(
    "w13_first_inflow_index",
    f"{CROSSED} SELECT aoi_id, objectid, min(crossing_no) - 1 AS first_inflow_index FROM labelled WHERE flow = 'inflow' GROUP BY aoi_id, objectid",
)
def w13_index(fx):
    return boundary.first_inflow_index(classified(fx))


@query(
    "w13_inflows",
    f"""{CROSSED} SELECT aoi_id, objectid, crossing_no, CASE WHEN crossing_count = 1 THEN 'single' ELSE 'multi' END AS kind
        FROM labelled WHERE flow = 'inflow'""",
)
def w13_inflows(fx):
    labelled = classified(fx)
    single = boundary.single_inflows(labelled).withColumn("kind", F.lit("single"))
    multi = boundary.multi_inflows(labelled).withColumn("kind", F.lit("multi"))
    return single.unionByName(multi).select("aoi_id", "objectid", "crossing_no", "kind")


# ---------------------------------------------------------------- joins

NEAR = "greatest(least(c.x0, c.x1) - r.xmax, r.xmin - greatest(c.x0, c.x1), 0)"
NEAR_Y = "greatest(least(c.y0, c.y1) - r.ymax, r.ymin - greatest(c.y0, c.y1), 0)"
COAST = f"""near AS (SELECT r.*, c.coast_id, (c.x0 + c.x1) / 2.0 AS mx, (c.y0 + c.y1) / 2.0 AS my, {NEAR} * {NEAR} + {NEAR_Y} * {NEAR_Y} AS dist_sq
  FROM fx_aoi r JOIN fx_coast c ON {NEAR} * {NEAR} + {NEAR_Y} * {NEAR_Y} <= 1000 * 1000)"""
FACING = """CASE least(abs(my - ymin), abs(xmax - mx), abs(ymax - my), abs(mx - xmin)) WHEN abs(my - ymin) THEN 'bottom'
  WHEN abs(xmax - mx) THEN 'right' WHEN abs(ymax - my) THEN 'top' ELSE 'left' END"""


def coast(fx):
    return fx("fx_coast").select(g.line_geometry(F.array(g.point("x0", "y0"), g.point("x1", "y1"))).alias("geometry"))


@query(
    "j4_sites_in_area",
    "SELECT s.site_id, a.aoi_id FROM fx_site s JOIN fx_aoi a ON s.x BETWEEN a.xmin AND a.xmax AND s.y BETWEEN a.ymin AND a.ymax",
)
def j4(fx):
    return sj.intersecting_pairs(fx("fx_site"), areas(fx), CELL, left_box=("x", "y", "x", "y")).select("site_id", "aoi_id")


@query(
    "j4_features_in_any_area",
    """SELECT asset_id, xmin, ymin FROM fx_asset s WHERE EXISTS (SELECT 1 FROM fx_aoi a WHERE s.xmin <= a.xmax AND s.xmax >= a.xmin
       AND s.ymin <= a.ymax AND s.ymax >= a.ymin)""",
)
def j4_semi(fx):
    right = areas(fx).select(*(F.col(s).alias(f"a_{s}") for s in g.BOX))
    kept = sj.semi_join(fx("fx_asset"), right, ["asset_id"], CELL, right_box=[f"a_{s}" for s in g.BOX])
    return kept.select("asset_id", "xmin", "ymin")


@query("j5_coast_within_distance", f"WITH {COAST} SELECT aoi_id, round(mx, 1) AS mx, round(my, 1) AS my, round(dist_sq, 4) AS dist_sq FROM near")
def j5(fx):
    near = boundary.coastline_near(areas(fx), coast(fx), 1000.0, 4000.0)
    return near.select(
        "aoi_id",
        rounded((F.col("sa.x") + F.col("sb.x")) / 2, 1).alias("mx"),
        rounded((F.col("sa.y") + F.col("sb.y")) / 2, 1).alias("my"),
        rounded("dist_sq", 4).alias("dist_sq"),
    )


@query("sp10_buffered_features", f"WITH {COAST} SELECT aoi_id, count(*) AS n FROM near GROUP BY aoi_id")
def sp10(fx):
    """Rectangles buffered by a distance: features meeting the round buffer of each area."""
    lines = fx("fx_coast").withColumnsRenamed({"x0": "c0", "y0": "c1", "x1": "c2", "y1": "c3"})
    near = sj.within_distance(lines, areas(fx), 1000.0, left_box=("c0", "c1", "c2", "c3"), cell_size=4000.0)
    return near.groupBy("aoi_id").agg(F.count("*").alias("n"))


@query(
    "j8_nearest_site",
    """SELECT a.asset_id, arg_min(s.site_id, ((a.xmin - s.x) * (a.xmin - s.x) + (a.ymin - s.y) * (a.ymin - s.y), s.site_id)) AS site_id,
              min((a.xmin - s.x) * (a.xmin - s.x) + (a.ymin - s.y) * (a.ymin - s.y)) AS dist_sq
       FROM fx_asset a CROSS JOIN fx_site s GROUP BY a.asset_id""",
)
def j8(fx):
    found = sj.nearest(fx("fx_asset"), fx("fx_site"), "asset_id", "site_id", left_xy=("xmin", "ymin"))
    return found.withColumn("dist_sq", F.col("dist_sq").cast("long"))


@query(
    "j9_aligned_within_distance",
    """SELECT a.asset_id, arg_min(r.objectid, ((a.xmin - r.x0) * (a.xmin - r.x0) + (a.ymin - r.y0) * (a.ymin - r.y0), r.objectid)) AS objectid,
              min((a.xmin - r.x0) * (a.xmin - r.x0) + (a.ymin - r.y0) * (a.ymin - r.y0)) AS dist_sq
       FROM fx_asset a JOIN fx_reach r ON (a.xmin - r.x0) * (a.xmin - r.x0) + (a.ymin - r.y0) * (a.ymin - r.y0) <= 300 * 300 GROUP BY a.asset_id""",
)
def j9(fx):
    found = sj.closest_within(
        fx("fx_asset").select("asset_id", F.col("xmin").alias("px"), F.col("ymin").alias("py")),
        fx("fx_reach").select("objectid", "x0", "y0"),
        300.0,
        ["asset_id"],
        "objectid",
        left_box=("px", "py", "px", "py"),
        right_box=("x0", "y0", "x0", "y0"),
    )
    return found.select("asset_id", "objectid", F.col("dist_sq").cast("long").alias("dist_sq"))


WITHIN = " AND ".join(inside_diamond(f"r.x{i}", f"r.y{i}") for i in range(3))


@query(
    "j11_reach_catchments",
    f"""SELECT r.objectid, min(z.zone_id) AS zone_id, CASE WHEN min(z.zone_id) IS NULL THEN 'not inside one sea-draining catchment' END AS exclusion_cause
        FROM fx_reach r LEFT JOIN fx_zone z ON {WITHIN} GROUP BY r.objectid""",
)
def j11(fx):
    from ..operators import network

    return network.tag_catchments(reaches(fx), zones(fx).select("zone_id", "geometry"), "zone_id", CELL)


@query("p12_regions_of_areas", f"SELECT DISTINCT zone_id FROM fx_zone z JOIN fx_aoi r ON {diamond_meets('r')}")
def p12(fx):
    return boundary.regions_of(areas(fx), zones(fx), "zone_id", CELL).select("zone_id")


# ---------------------------------------------------------------- overlays


def squares(fx):
    return fx("fx_square").select("site_id", g.box_geometry("sx0", "sy0", "sx1", "sy1").alias("geometry"))


CLIPPED = """WITH c AS (SELECT aoi_id, site_id, greatest(xmin, sx0) AS x0, greatest(ymin, sy0) AS y0, least(xmax, sx1) AS x1, least(ymax, sy1) AS y1,
  (xmax - xmin) * (ymax - ymin) AS whole FROM fx_aoi JOIN fx_square ON sx0 < xmax AND sx1 > xmin AND sy0 < ymax AND sy1 > ymin)"""


@query("ov2_clipped_sites", f"{CLIPPED} SELECT aoi_id, site_id, x0, y0, x1, y1 FROM c")
def ov2(fx):
    cut = overlay.clipped_sites(areas(fx), squares(fx), CELL)
    names = zip(g.BOX, ("x0", "y0", "x1", "y1"), strict=True)
    return cut.select("aoi_id", "site_id", *(F.col(f"geometry.{s}").cast("long").alias(n) for s, n in names))


@query(
    "ov3_site_coverage",
    f"{CLIPPED} SELECT aoi_id, site_id, (x1 - x0) * (y1 - y0) AS site_area, (x1 - x0) * (y1 - y0) / whole AS site_share FROM c",
)
def ov3(fx):
    cover = overlay.site_coverage(overlay.clipped_sites(areas(fx), squares(fx), CELL))
    return cover.select("aoi_id", "site_id", F.col("site_area").cast("long").alias("site_area"), "site_share")


@query(
    "ov4_thiessen_cells",
    """SELECT a.aoi_id, count(*) AS cells, (max(a.xmax) - max(a.xmin)) * (max(a.ymax) - max(a.ymin)) AS total_area FROM fx_aoi a
       JOIN fx_site s ON s.x BETWEEN a.xmin AND a.xmax AND s.y BETWEEN a.ymin AND a.ymax GROUP BY a.aoi_id""",
)
def ov4(fx):
    """The cells of an area tile it, so their count and total area are known."""
    cells = overlay.thiessen_cells(areas(fx), fx("fx_site"), CELL)
    return cells.groupBy("aoi_id").agg(F.count("*").alias("cells"), F.round(F.sum("cell_area")).cast("long").alias("total_area"))


PARCEL_PARTS = """WITH RECURSIVE reach(id, part) AS (SELECT parcel_id, parcel_id FROM fx_parcel
  UNION SELECT b.parcel_id, r.part FROM reach r JOIN fx_parcel a ON a.parcel_id = r.id JOIN fx_parcel b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1),
parts AS (SELECT id, min(part) AS part FROM reach GROUP BY id)"""


def parcels(fx):
    x, y = F.col("gx") * 100, F.col("gy") * 100
    return fx("fx_parcel").select("parcel_id", g.geometry("POLYGON", F.array(F.array(g.box_ring(x, y, x + 100, y + 100)))).alias("geometry"))


@query("ov5_dissolved_parts", f"{PARCEL_PARTS} SELECT part, count(*) AS polygons, count(*) * 10000 AS part_area FROM parts GROUP BY part")
def ov5(fx):
    return overlay.dissolved_areas(parcels(fx), "parcel_id").withColumn("part_area", F.col("part_area").cast("long"))


@query(
    "t1_largest_part",
    f"{PARCEL_PARTS} SELECT part, count(*) * 10000 AS part_area FROM parts GROUP BY part ORDER BY 2 DESC, 1 LIMIT 1",
)
def t1(fx):
    sizes = overlay.dissolved_areas(parcels(fx), "parcel_id")
    return sizes.orderBy(F.desc("part_area"), "part").limit(1).select("part", F.col("part_area").cast("long").alias("part_area"))


LOG_CLIPS = """flat AS (SELECT unique_id, table_a AS table_name, xmin, ymin, xmax, ymax FROM fx_log
  UNION SELECT unique_id, table_b, xmin, ymin, xmax, ymax FROM fx_log WHERE table_b IS NOT NULL),
clips AS (SELECT r.aoi_id, r.xmin, r.ymin, r.xmax, r.ymax, (greatest(r.xmin, f.xmin) + least(r.xmax, f.xmax)) / 2.0 AS mx,
  (greatest(r.ymin, f.ymin) + least(r.ymax, f.ymax)) / 2.0 AS my FROM fx_request r JOIN flat f ON r.table_name = f.table_name
  AND f.xmin <= r.xmax AND f.xmax >= r.xmin AND f.ymin <= r.ymax AND f.ymax >= r.ymin)"""


@query("ov7_piece_positions", f"WITH {LOG_CLIPS} SELECT aoi_id, mx AS x, my AS y, {FACING} AS position FROM clips")
def ov7(fx):
    from .areas import coverage_log

    requests = boundary.with_own_boxes(fx("fx_request"))
    pairs = overlay.coverage_lookup(requests, coverage_log(fx), CELL, ("aoi_id", "table_name", "own_boxes"))
    pieces = pairs.select(
        "aoi_id",
        "own_boxes",
        F.greatest("xmin", "log_xmin").alias("x0"),
        F.greatest("ymin", "log_ymin").alias("y0"),
        F.least("xmax", "log_xmax").alias("x1"),
        F.least("ymax", "log_ymax").alias("y1"),
    )
    return boundary.uncovered_positions(fx("fx_request"), pieces)


@query(
    "ov8_tide_query_locations",
    f"""WITH {COAST}, {SIDE_ROWS}, facing AS (SELECT DISTINCT aoi_id, {FACING} AS position FROM near)
        SELECT s.aoi_id, s.position, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM sides s JOIN facing f ON f.aoi_id = s.aoi_id AND f.position = s.position""",
)
def ov8(fx):
    return boundary.tide_query_locations(areas(fx), coast(fx))
