"""River network construction."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import components, network
from ..plans import scenario
from . import fixtures  # noqa: F401
from .registry import query, scratch, scratch_database
from .series_queries import inflows
from .shapes import SIDE_ROWS

AREA = (1500000.0, 5100000.0, 1504000.0, 5100010.0)


def lines(fx):
    ends = F.array(g.point("ax", "ay"), g.point("bx", "b_y"))
    return fx("fx_line").select("objectid", g.line_geometry(ends).alias("geometry"))


NODES = "nodes AS (SELECT ax AS x, ay AS y FROM fx_line UNION SELECT bx, b_y FROM fx_line)"


@query("g1_unique_nodes", f"WITH {NODES} SELECT x, y, (SELECT count(*) FROM nodes) AS highest_id FROM nodes")
def g1(fx):
    """Node ids are consecutive from 1, so the highest id is the number of nodes."""
    nodes = network.unique_nodes(network.reach_ends(lines(fx)))
    distinct, highest = nodes.agg(F.countDistinct("node_id"), F.max("node_id")).first()
    assert distinct == highest, "node ids have gaps"
    return nodes.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(highest).alias("highest_id"))


@query(
    "g2_prepared_edges",
    """WITH t AS (SELECT objectid, ax, ay, bx, b_y, ax BETWEEN 1500000 AND 1504000 AND ay BETWEEN 5100000 AND 5100010 AS f,
                         bx BETWEEN 1500000 AND 1504000 AND b_y BETWEEN 5100000 AND 5100010 AS l FROM fx_line)
       SELECT objectid, ax, ay, bx, b_y, CASE WHEN f AND l THEN 'inside' WHEN f OR l THEN 'crossing' ELSE 'outside' END AS intersection_type FROM t""",
)
def g2(fx):
    ends = network.reach_ends(lines(fx)).drop("geometry")
    nodes = network.unique_nodes(ends)
    edges = network.prepared_edges(ends, nodes, AREA)
    at_src = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    at_dst = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("b_y"))
    back = edges.join(at_src, "src").join(at_dst, "dst")
    return back.select("objectid", *(F.col(c).cast("long").alias(c) for c in ("ax", "ay", "bx", "b_y")), "intersection_type")


def links(fx):
    return fx("fx_link").select("objectid", F.col("upper_node").alias("src"), F.col("lower_node").alias("dst"))


@query(
    "g3_absent_edges",
    """SELECT objectid, upper_node AS src, lower_node AS dst FROM fx_link l
       WHERE NOT EXISTS (SELECT 1 FROM fx_present p WHERE p.upper_node = l.upper_node AND p.lower_node = l.lower_node)""",
)
def g3(fx):
    present = fx("fx_present").select(F.col("upper_node").alias("src"), F.col("lower_node").alias("dst"))
    return network.absent_edges(links(fx), present).select("objectid", "src", "dst")


@query(
    "g3_completed_edges",
    "SELECT upper_node AS src, lower_node AS dst FROM fx_link UNION SELECT upper_node, lower_node FROM fx_present",
)
def g3_completed(fx):
    present = fx("fx_present").select(F.col("upper_node").alias("src"), F.col("lower_node").alias("dst")).distinct()
    return network.with_absent_edges(links(fx), present)


REACH = """WITH RECURSIVE two_way AS (SELECT upper_node AS s, lower_node AS d FROM fx_link UNION SELECT lower_node, upper_node FROM fx_link),
walk(id, depth) AS (SELECT id, 0 FROM fx_outlet UNION SELECT b.d, w.depth + 1 FROM walk w JOIN two_way b ON b.s = w.id WHERE w.depth < 30),
reach AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


def flipped(fx):
    return fx("fx_line").select("objectid", F.col("a").alias("src"), F.col("b").alias("dst"))


DIRECTED = f"""{REACH}, directed AS (SELECT objectid, CASE WHEN s.depth > d.depth THEN 'to' WHEN s.depth < d.depth THEN 'from' END AS edge_direction
  FROM fx_line l LEFT JOIN reach s ON s.id = l.a LEFT JOIN reach d ON d.id = l.b)"""


@query("g4_edge_directions", f"{DIRECTED} SELECT objectid, edge_direction FROM directed")
def g4(fx):
    return network.edge_directions(flipped(fx), fx("fx_outlet")).select("objectid", "edge_direction")


@query("g5_connected_edges", f"{REACH} SELECT objectid, r.id IS NOT NULL AS connected FROM fx_line l LEFT JOIN reach r ON r.id = l.a")
def g5(fx):
    return network.connected_to_outlets(flipped(fx), fx("fx_outlet")).select("objectid", "connected")


@query(
    "g5_components",
    """WITH RECURSIVE up(id, top) AS (SELECT upper_node, lower_node FROM fx_link UNION ALL SELECT u.id, l.lower_node FROM up u JOIN fx_link l ON l.upper_node = u.top),
       ends AS (SELECT id, max(top) AS far, min(top) AS near FROM up GROUP BY id),
       root AS (SELECT id, CASE WHEN far >= 1000000 THEN far ELSE near END AS root FROM ends
                UNION SELECT DISTINCT lower_node, lower_node FROM fx_link WHERE lower_node NOT IN (SELECT upper_node FROM fx_link))
       SELECT id, min(id) OVER (PARTITION BY root) AS component FROM root""",
)
def g5_components(fx):
    return components.connected_components(links(fx))


@query("g5_reachable", f"{REACH} SELECT id, depth FROM reach")
def g5_reachable(fx):
    both = links(fx).select("src", "dst").union(links(fx).select("dst", "src"))
    return components.reachable(both, fx("fx_outlet"))


def built(fx):
    outlets = fx("fx_outlet").select((1500000 + F.col("id") % 1000 * 10).cast("double").alias("x"), (5100000 + F.floor(F.col("id") / 1000) * 10).cast("double").alias("y"))
    return network.build_network(lines(fx), outlets, AREA)


BUILT = f"""{DIRECTED}, judged AS (SELECT l.objectid, edge_direction, CASE WHEN r.id IS NULL THEN '{network.CAUSE_UNCONNECTED}'
  WHEN edge_direction IS NULL THEN '{network.CAUSE_DIRECTION}' END AS exclusion_cause
  FROM fx_line l JOIN directed d ON d.objectid = l.objectid LEFT JOIN reach r ON r.id = l.a)"""


@query("g6_river_network", f"{BUILT} SELECT objectid, edge_direction FROM judged WHERE exclusion_cause IS NULL")
def g6(fx):
    _, kept, _ = built(fx)
    return kept.select("objectid", "edge_direction")


@query(
    "snk11_network_exclusions",
    f"""{BUILT} SELECT 7 AS rec_network_id, j.objectid, exclusion_cause, 'LINESTRING (' || ax || ' ' || ay || ', ' || bx || ' ' || b_y || ')' AS wkt
        FROM judged j JOIN fx_line l ON l.objectid = j.objectid WHERE exclusion_cause IS NOT NULL""",
)
def snk11(fx):
    _, _, excluded = built(fx)
    return network.exclusion_rows(excluded, lines(fx), 7)


@query(
    "snk11_network_metadata",
    """SELECT max(rec_network_id) + 1 AS rec_network_id, '/networks/network_' || (max(rec_network_id) + 1) || '/nodes' AS network_path,
              '/networks/network_' || (max(rec_network_id) + 1) || '/edges' AS network_data_path FROM fx_network""",
)
def snk11_metadata(fx):
    return network.output_metadata(fx("fx_network"), "/networks", AREA).select("rec_network_id", "network_path", "network_data_path")


@query(
    "j16_existing_network",
    """SELECT a.aoi_id, max(n.rec_network_id) AS rec_network_id FROM fx_aoi a LEFT JOIN fx_network n ON n.xmin <= a.xmin AND n.ymin <= a.ymin
       AND a.xmax <= n.xmax AND a.ymax <= n.ymax GROUP BY a.aoi_id""",
)
def j16(fx):
    return network.existing_network(fx("fx_aoi"), fx("fx_network"), 10_000.0)


# ---------------------------------------------------------------- many areas and their catchments


def basins(fx):
    """Concave catchments: squares with a notch from the upper side to their middle."""
    corners = ((100, 100), (1900, 100), (1900, 1900), (1000, 1000), (100, 1900), (100, 100))
    ring = F.array(*(g.point(F.col("ox") + x, F.col("oy") + y) for x, y in corners))
    return fx("fx_basin").select("basin_id", g.geometry(F.lit("POLYGON"), F.array(F.array(ring))).alias("geometry"))


def branches(fx):
    return fx("fx_branch").select("objectid", g.line_geometry(F.array(g.point("ax", "ay"), g.point("bx", "b_y"))).alias("geometry"))


def mouths(fx):
    return fx("fx_basin").select("basin_id", (F.col("ox") + 200).cast("double").alias("x"), (F.col("oy") + 200).cast("double").alias("y"))


def in_basin(x, y):
    return f"({x} BETWEEN ox + 100 AND ox + 1900 AND {y} >= oy + 100 AND {y} <= oy + 1000 + abs({x} - ox - 1000))"


AREA_NETWORKS = f"""WITH RECURSIVE met AS (SELECT r.*, basin_id, {in_basin('ax', 'ay')} AND {in_basin('bx', 'b_y')}
         AND (greatest(ax, bx) <= ox + 1000 OR least(ax, bx) >= ox + 1000 OR ay + (b_y - ay) * (ox + 1000 - ax)::DOUBLE / (bx - ax) <= oy + 1000) AS held
       FROM fx_branch r JOIN fx_basin ON {in_basin('ax', 'ay')} OR {in_basin('bx', 'b_y')}),
  held AS (SELECT objectid, min(basin_id) AS basin_id FROM met WHERE held GROUP BY objectid),
  links AS (SELECT h.*, ax, ay, bx, b_y FROM held h JOIN fx_branch r ON r.objectid = h.objectid),
  ways AS (SELECT basin_id, ax, ay, bx, b_y FROM links UNION SELECT basin_id, bx, b_y, ax, ay FROM links),
  walk(basin_id, x, y, depth) AS (SELECT basin_id, ox + 200, oy + 200, 0 FROM fx_basin
    UNION SELECT w.basin_id, s.bx, s.b_y, depth + 1 FROM walk w JOIN ways s ON s.basin_id = w.basin_id AND s.ax = x AND s.ay = y WHERE depth < 20),
  deep AS (SELECT basin_id, x, y, min(depth) AS depth FROM walk GROUP BY ALL),
  judged AS (SELECT l.*, a.depth AS up, b.depth AS down FROM links l LEFT JOIN deep a ON a.basin_id = l.basin_id AND a.x = ax AND a.y = ay
    LEFT JOIN deep b ON b.basin_id = l.basin_id AND b.x = bx AND b.y = b_y),
  scope AS (SELECT aoi_id, xmin, ymin, xmax, ymax, basin_id FROM fx_aoi JOIN fx_basin ON xmin <= ox + 1900 AND xmax >= ox + 100 AND ymax >= oy + 100
    AND ymin <= oy + 1000 + greatest(abs(greatest(xmin, ox + 100) - ox - 1000), abs(least(xmax, ox + 1900) - ox - 1000))),
  of_areas AS (SELECT aoi_id, objectid, CASE WHEN up > down THEN 'to' WHEN up < down THEN 'from' END AS edge_direction,
      CASE (ax BETWEEN xmin AND xmax AND ay BETWEEN ymin AND ymax)::INT + (bx BETWEEN xmin AND xmax AND b_y BETWEEN ymin AND ymax)::INT
        WHEN 2 THEN 'inside' WHEN 1 THEN 'crossing' ELSE 'outside' END AS intersection_type,
      CASE WHEN up IS NULL THEN '{network.CAUSE_UNCONNECTED}' WHEN up = down THEN '{network.CAUSE_DIRECTION}' END AS exclusion_cause
    FROM judged j JOIN scope s ON s.basin_id = j.basin_id),
  networks AS (SELECT aoi_id, objectid, edge_direction, intersection_type, exclusion_cause FROM of_areas WHERE exclusion_cause IS NULL
    UNION ALL SELECT aoi_id, objectid, NULL, NULL, exclusion_cause FROM of_areas WHERE exclusion_cause IS NOT NULL
    UNION ALL SELECT DISTINCT aoi_id, objectid, NULL, NULL, '{network.CAUSE_CATCHMENT}' FROM met JOIN scope s ON s.basin_id = met.basin_id
      WHERE objectid NOT IN (SELECT objectid FROM held))"""


@query("g6_area_networks", f"{AREA_NETWORKS} SELECT * FROM networks")
def g6_areas(fx):
    """Networks of all areas by catchments: kept edges and all three causes of exclusion."""
    _, kept, excluded = network.build_networks(fx("fx_aoi"), branches(fx), basins(fx), mouths(fx), "basin_id", 10_000.0)
    return kept.select("aoi_id", "objectid", "edge_direction", "intersection_type").unionByName(excluded, allowMissingColumns=True)


@query("g1_catchment_nodes", f"{AREA_NETWORKS} SELECT aoi_id, n.basin_id, x, y FROM (SELECT basin_id, ax AS x, ay AS y FROM ways) n JOIN scope s ON s.basin_id = n.basin_id GROUP BY ALL")
def g1_catchments(fx):
    nodes, _, _ = network.build_networks(fx("fx_aoi"), branches(fx), basins(fx), mouths(fx), "basin_id", 10_000.0)
    return nodes.select("aoi_id", "basin_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(
    "snk11_stored_networks",
    f"""{AREA_NETWORKS} SELECT a.xmin, a.ymin, a.xmax, a.ymax, n.objectid, edge_direction, intersection_type, exclusion_cause,
          CASE WHEN exclusion_cause IS NOT NULL THEN 'LINESTRING (' || ax || ' ' || ay || ', ' || bx || ' ' || b_y || ')' END AS wkt
        FROM networks n JOIN fx_aoi a ON a.aoi_id = n.aoi_id JOIN fx_branch r ON r.objectid = n.objectid""",
)
def snk11_stored(fx):
    """Networks of all areas, stored and read back by their metadata; a second request for the areas builds none."""
    database, root = scratch_database(fx), scratch(fx, "networks")
    table, exclusions = f"{database}.networks", f"{database}.exclusions"
    for _ in range(2):
        network.networks_of_areas(fx.spark, fx("fx_aoi"), branches(fx), basins(fx), mouths(fx), "basin_id", 10_000.0, root, table, exclusions)
    boxes = fx.spark.table(table).select("rec_network_id", *(F.col(s).cast("long").alias(s) for s in g.BOX))
    edges = fx.spark.read.parquet(f"{root}/edges").select("rec_network_id", "objectid", "edge_direction", "intersection_type")
    return boxes.join(edges.unionByName(fx.spark.table(exclusions), allowMissingColumns=True), "rec_network_id").drop("rec_network_id")


# ---------------------------------------------------------------- river leg of the scenario chain


def crossed(name, lines, line_id):
    """Where straight lines ``(aoi_id, line_id, ax, ay, bx, b_y)`` cross the sides of their area."""
    return f"""{name}_solved AS (SELECT l.*, x0, y0, x1, y1, position,
    CASE WHEN position IN ('bottom', 'top') THEN (y0 - ay)::DOUBLE / nullif(b_y - ay, 0) ELSE (x0 - ax)::DOUBLE / nullif(bx - ax, 0) END AS t
    FROM {lines} l JOIN sides s ON s.aoi_id = l.aoi_id),
  {name}_points AS (SELECT *, CASE WHEN position IN ('bottom', 'top') THEN ax + t * (bx - ax) ELSE x0 END AS x,
    CASE WHEN position IN ('bottom', 'top') THEN y0 ELSE ay + t * (b_y - ay) END AS y FROM {name}_solved WHERE t BETWEEN 0 AND 1),
  {name} AS (SELECT aoi_id, {line_id}, ax, ay, x, y, min(t) AS t FROM {name}_points WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL)"""


RIVER_INPUTS = f"""{AREA_NETWORKS}, {SIDE_ROWS},
  down AS (SELECT n.aoi_id, n.objectid, CASE edge_direction WHEN 'to' THEN ax ELSE bx END AS ax, CASE edge_direction WHEN 'to' THEN ay ELSE b_y END AS ay,
    CASE edge_direction WHEN 'to' THEN bx ELSE ax END AS bx, CASE edge_direction WHEN 'to' THEN b_y ELSE ay END AS b_y
    FROM networks n JOIN fx_branch r ON r.objectid = n.objectid WHERE exclusion_cause IS NULL),
  flowing AS (SELECT aoi_id, osm_id, ax, ay, bx, b_y FROM fx_channel JOIN fx_aoi ON least(ax, bx) <= xmax AND greatest(ax, bx) >= xmin
    AND least(ay, b_y) <= ymax AND greatest(ay, b_y) >= ymin WHERE waterway IN ('river', 'stream')),
  {crossed('cut', 'down', 'objectid')}, {crossed('mapped', 'flowing', 'osm_id')},
  passed AS (SELECT c.*, row_number() OVER (PARTITION BY c.aoi_id, objectid ORDER BY t, x, y) AS no, ax > xmin AND ax < xmax AND ay > ymin AND ay < ymax AS starts_inside
    FROM cut c JOIN fx_aoi a ON a.aoi_id = c.aoi_id),
  entry AS (SELECT aoi_id, objectid, arg_min(x, no) AS ex, arg_min(y, no) AS ey FROM passed WHERE (no % 2 = 1) <> starts_inside GROUP BY ALL),
  aligned AS (SELECT e.*, arg_min(osm_id, ((x - ex) * (x - ex) + (y - ey) * (y - ey), osm_id)) AS osm_id FROM entry e JOIN mapped m ON m.aoi_id = e.aoi_id
    AND (x - ex) * (x - ex) + (y - ey) * (y - ey) <= 300 * 300 GROUP BY ALL),
  lowest AS (SELECT a.aoi_id, objectid, osm_id, arg_min((g.x, g.y), (z, (g.x - ex) * (g.x - ex) + (g.y - ey) * (g.y - ey), g.x, g.y)) AS v
    FROM aligned a JOIN fx_aoi o ON o.aoi_id = a.aoi_id JOIN fx_ground g ON g.x BETWEEN xmin AND xmax AND g.y BETWEEN ymin AND ymax
    AND (g.x - ex) * (g.x - ex) + (g.y - ey) * (g.y - ey) <= 300 * 300 GROUP BY ALL),
  inputs AS (SELECT aoi_id, objectid, osm_id, v[1] AS x, v[2] AS y FROM lowest)"""


def river_inputs(fx):
    _, kept, _ = network.build_networks(fx("fx_aoi"), branches(fx), basins(fx), mouths(fx), "basin_id", 10_000.0)
    mapped = fx("fx_channel").select("osm_id", "waterway", g.line_geometry(F.array(g.point("ax", "ay"), g.point("bx", "b_y"))).alias("geometry"))
    return scenario.river_inputs(fx("fx_aoi"), branches(fx), kept, mapped, fx("fx_ground"), 10_000.0)


@query("c4_river_inputs", f"{RIVER_INPUTS} SELECT * FROM inputs")
def c4_river_inputs(fx):
    """Input points of all areas: network, entries, mapped waterways and the lowest ground near them."""
    return river_inputs(fx)


@query(
    "c4_river_forcing",
    f"""{RIVER_INPUTS} SELECT aoi_id, i.objectid, i.x, i.y, m * 60.0::DOUBLE AS seconds, CASE WHEN m = 1440 THEN (f * 100)::DOUBLE ELSE 0 END AS flow
        FROM inputs i JOIN fx_inflow q ON q.objectid = i.objectid CROSS JOIN (SELECT unnest([0, 1440, 2880]) AS m) t""",
)
def c4_river_forcing(fx):
    """Hydrographs at the input points of all areas."""
    return scenario.area_river_forcing(river_inputs(fx), inflows(fx), scenario.Options(maf=False, ari=100))
