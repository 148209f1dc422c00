"""Spatial inputs derived from the driver tables; the same text runs in Spark and in the checking engine."""

from .registry import fixture

fixture(
    "fx_site",
    """SELECT s_suppkey AS site_id, 1500000 + (s_suppkey * 7919) % 100000 AS x,
              5100000 + (s_suppkey * 104729) % 100000 AS y FROM {supplier}""",
)
fixture(
    "fx_asset",
    """SELECT p_partkey AS asset_id, 1500000 + (p_partkey * 31337) % 100000 AS xmin,
              5100000 + (p_partkey * 15485863) % 100000 AS ymin,
              1500000 + (p_partkey * 31337) % 100000 + p_size AS xmax,
              5100000 + (p_partkey * 15485863) % 100000 + p_size AS ymax FROM {part}""",
)
fixture(
    "fx_aoi",
    """SELECT s_suppkey AS aoi_id, 1500000 + (s_suppkey * 48611) % 80000 AS xmin,
              5100000 + (s_suppkey * 15485863) % 80000 AS ymin,
              1500000 + (s_suppkey * 48611) % 80000 + 4000 + (s_suppkey % 7) * 2000 AS xmax,
              5100000 + (s_suppkey * 15485863) % 80000 + 4000 + (s_suppkey % 5) * 2500 AS ymax FROM {supplier}""",
)
fixture(
    "fx_request",
    """SELECT c_custkey AS aoi_id,
              CASE c_custkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'automobile' WHEN 2 THEN 'machinery'
                   WHEN 3 THEN 'household' ELSE 'furniture' END AS table_name,
              1500000 + (c_custkey * 48611) % 80000 AS xmin, 5100000 + (c_custkey * 15485863) % 80000 AS ymin,
              1500000 + (c_custkey * 48611) % 80000 + 5000 + (c_custkey % 7) * 2000 AS xmax,
              5100000 + (c_custkey * 15485863) % 80000 + 5000 + (c_custkey % 3) * 5000 AS ymax FROM {customer}""",
)
fixture(
    "fx_log",
    """SELECT c_custkey AS unique_id, lower(c_mktsegment) AS table_a,
              CASE WHEN c_nationkey % 4 = 0 THEN 'building' ELSE NULL END AS table_b,
              1500000 + (c_custkey * 7919) % 100000 AS xmin, 5100000 + (c_custkey * 104729) % 100000 AS ymin,
              1500000 + (c_custkey * 7919) % 100000 + 1000 + (c_custkey % 9) * 500 AS xmax,
              5100000 + (c_custkey * 104729) % 100000 + 1000 + (c_custkey % 4) * 1000 AS ymax FROM {customer}""",
)

fixture(
    "fx_instruction",
    """SELECT c_custkey * 2 + part AS pos, c_custkey AS doc, part,
              CASE (c_custkey + part) % 4 WHEN 0 THEN 'LINZ' WHEN 1 THEN 'StatsNZ' WHEN 2 THEN 'MFE' ELSE NULL END
                  AS data_provider,
              100 + (c_nationkey + part) % 25 AS layer_id,
              'layer_' || CAST(c_nationkey % 10 AS STRING) AS table_name,
              CASE WHEN c_acctbal > 5000 THEN 'id' WHEN c_acctbal > 2000 THEN ' ' ELSE NULL END AS unique_column_name,
              CASE WHEN c_acctbal > 5000 AND part = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'New Zealand'
                   WHEN c_nationkey % 3 = 1 THEN 'Regional' ELSE '' END AS coverage_area,
              'https://example.org/' || CAST(c_nationkey AS STRING) AS url
       FROM {customer} {each:part:0,1}""",
)
fixture(
    "fx_registry",
    """SELECT s_suppkey + 1 AS unique_id,
              CASE s_suppkey % 4 WHEN 0 THEN 'LINZ' WHEN 1 THEN 'StatsNZ' WHEN 2 THEN 'MFE' ELSE NULL END AS data_provider,
              100 + s_nationkey AS layer_id, 'layer_' || CAST(s_nationkey AS STRING) AS table_name,
              CASE WHEN s_acctbal > 4000 THEN 'id' ELSE NULL END AS unique_column_name,
              CASE WHEN s_acctbal > 8000 THEN 'Regional' WHEN s_acctbal > 4000 THEN NULL
                   WHEN s_acctbal > 2000 THEN 'New Zealand' ELSE 'Regional' END AS coverage_area,
              'https://example.org/' || CAST(s_suppkey AS STRING) AS url FROM {supplier}""",
)
fixture(
    "fx_cache",
    """SELECT c_custkey AS unique_id, c_custkey % 97 AS flood_model_id, c_custkey % 6 AS created_rank,
              2030 + 10 * (c_custkey % 4) AS year, CASE WHEN c_custkey % 3 = 0 THEN 'low' ELSE 'medium' END AS confidence,
              1500000 + (c_custkey * 7919) % 60000 AS xmin, 5100000 + (c_custkey * 104729) % 60000 AS ymin,
              1500000 + (c_custkey * 7919) % 60000 + 10000 + (c_custkey % 9) * 3000 AS xmax,
              5100000 + (c_custkey * 104729) % 60000 + 10000 + (c_custkey % 4) * 5000 AS ymax FROM {customer}""",
)
fixture(
    "fx_cache_request",
    """SELECT p_partkey AS request_id, 2030 + 10 * (p_partkey % 4) AS year,
              CASE WHEN p_size % 2 = 0 THEN 'low' ELSE 'medium' END AS confidence,
              1500000 + (p_partkey * 31337) % 90000 AS xmin, 5100000 + (p_partkey * 15485863) % 90000 AS ymin,
              1500000 + (p_partkey * 31337) % 90000 + p_size * 50 AS xmax,
              5100000 + (p_partkey * 15485863) % 90000 + p_size * 50 AS ymax FROM {part}""",
)
fixture(
    "fx_layer",
    """SELECT CASE c_nationkey % 3 WHEN 0 THEN 'static_files' WHEN 1 THEN 'input_layers' ELSE 'extruded_layers' END
                  AS workspace,
              CASE WHEN c_custkey % 2 = 0 THEN 'vector' ELSE 'raster' END AS kind,
              lower(replace(c_name, '#', '_')) AS layer_name FROM {customer}""",
)
fixture("fx_workspace", "SELECT lower(n_name) AS workspace, n_nationkey AS nation FROM {nation}")
fixture(
    "fx_nation_layer",
    """SELECT lower(n_name) AS workspace, CASE WHEN c_custkey % 3 = 0 THEN 'vector' ELSE 'raster' END AS kind,
              lower(c_name) AS layer_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
)

# ---------------------------------------------------------------- shapes

fixture(
    "fx_zone",
    """SELECT zone_id, cx, cy, a, b, c, d,
              'POLYGON((' || CAST(cx - a AS STRING) || ' ' || CAST(cy AS STRING) || ',' || CAST(cx AS STRING) || ' ' || CAST(cy - b AS STRING)
              || ', ' || CAST(cx + c AS STRING) || ' ' || CAST(cy AS STRING) || ', ' || CAST(cx AS STRING) || ' ' || CAST(cy + d AS STRING)
              || ', ' || CAST(cx - a AS STRING) || ' ' || CAST(cy AS STRING) || '))' AS wkt
       FROM (SELECT s_suppkey AS zone_id, 1505000 + (s_suppkey * 7919) % 90000 AS cx, 5105000 + (s_suppkey * 104729) % 90000 AS cy,
                    1000 + (s_suppkey % 7) * 300 AS a, 800 + (s_suppkey % 5) * 450 AS b, 1200 + (s_suppkey % 3) * 700 AS c,
                    900 + (s_suppkey % 11) * 200 AS d FROM {supplier}) z""",
)
fixture(
    "fx_square",
    """SELECT s_suppkey AS site_id, 1500000 + (s_suppkey * 7919) % 90000 AS sx0, 5100000 + (s_suppkey * 104729) % 90000 AS sy0,
              1500000 + (s_suppkey * 7919) % 90000 + 6000 + (s_suppkey % 5) * 1000 AS sx1,
              5100000 + (s_suppkey * 104729) % 90000 + 5000 + (s_suppkey % 3) * 2000 AS sy1 FROM {supplier}""",
)
fixture(
    "fx_reach",
    """SELECT o_orderkey AS objectid, x0, y0, x0 + dx1 AS x1, y0 + dy1 AS y1, x0 + dx1 + dx2 AS x2, y0 + dy1 + dy2 AS y2,
              'LINESTRING (' || CAST(x0 AS STRING) || ' ' || CAST(y0 AS STRING) || ', ' || CAST(x0 + dx1 AS STRING) || ' '
              || CAST(y0 + dy1 AS STRING) || ', ' || CAST(x0 + dx1 + dx2 AS STRING) || ' ' || CAST(y0 + dy1 + dy2 AS STRING) || ')' AS wkt
       FROM (SELECT o_orderkey, 1500000 + (o_orderkey * 7919) % 100003 AS x0, 5100000 + (o_orderkey * 104729) % 100019 AS y0,
                    (o_orderkey * 31) % 2999 - 1499 AS dx1, (o_orderkey * 37) % 2997 - 1498 AS dy1,
                    (o_orderkey * 41) % 3001 - 1500 AS dx2, (o_orderkey * 43) % 2993 - 1496 AS dy2 FROM {orders}) r""",
)
fixture(
    "fx_coast",
    """SELECT p_partkey AS coast_id, 1500000 + (p_partkey * 31337) % 100000 AS x0, 5100000 + (p_partkey * 15485863) % 100000 AS y0,
              1500000 + (p_partkey * 31337) % 100000 + CASE WHEN p_size % 2 = 0 THEN p_size * 40 ELSE 0 END AS x1,
              5100000 + (p_partkey * 15485863) % 100000 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size * 40 END AS y1 FROM {part}""",
)
fixture(
    "fx_parcel",
    """SELECT parcel_id, col + CAST(floor(col / 3) AS BIGINT) AS gx,
              row_no + CAST(floor(row_no / (3 + CAST(floor(col / 3) AS BIGINT) % 4)) AS BIGINT) AS gy
       FROM (SELECT c_custkey AS parcel_id, c_custkey % 42 AS col, CAST(floor(c_custkey / 42) AS BIGINT) AS row_no FROM {customer}) p""",
)
fixture(
    "fx_degree",
    """SELECT c_custkey AS id, 166.5 + (c_custkey * 7919) % 11900 / 1000.0 AS lon, -47.5 + (c_custkey * 104729) % 13900 / 1000.0 AS lat
       FROM {customer}""",
)
fixture(
    "fx_cell",
    """SELECT l_linenumber AS raster_id, l_partkey % 50 AS cx, l_suppkey % 40 AS cy, 1500050 + (l_partkey % 50) * 100 AS x,
              5100050 + (l_suppkey % 40) * 100 AS y, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS t,
              CAST(round(l_discount * 100) AS BIGINT) AS h FROM {lineitem}""",
)
fixture(
    "fx_building",
    """SELECT p_partkey AS building_outline_id, 1 + p_partkey % 7 AS raster_id, 1500000 + (p_partkey * 31337) % 4950 AS xmin,
              5100000 + (p_partkey * 15485863) % 3950 AS ymin, 1500000 + (p_partkey * 31337) % 4950 + p_size AS xmax,
              5100000 + (p_partkey * 15485863) % 3950 + p_size AS ymax FROM {part}""",
)
fixture(
    "fx_probe",
    """SELECT c_custkey AS point_id, 1 + c_custkey % 7 AS raster_id, 1499000 + (c_custkey * 7919) % 7001 AS x,
              5099000 + (c_custkey * 104729) % 6007 AS y FROM {customer}""",
)
fixture(
    "fx_terrain",
    """SELECT DISTINCT 1500050 + (l_partkey % 50) * 100 AS x, 5100050 + (l_suppkey % 40) * 100 AS y,
              ((l_partkey % 50) * 7 + (l_suppkey % 40) * 13) % 101 AS z FROM {lineitem}""",
)

# ---------------------------------------------------------------- series

MINS = (
    "CASE k WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 4 THEN 60 WHEN 5 THEN 120 WHEN 6 THEN 360 WHEN 7 THEN 720"
    " WHEN 8 THEN 1440 WHEN 9 THEN 2880 WHEN 10 THEN 4320 WHEN 11 THEN 5760 ELSE 7200 END"
)
fixture(
    "fx_rain",
    f"""SELECT s_suppkey AS site_id, CAST({MINS} AS BIGINT) AS mins, CAST((10 + s_suppkey % 17) * k AS DOUBLE) AS depth
        FROM {{supplier}} {{each:k:1,2,3,4,5,6,7,8,9,10,11,12}}""",
)
fixture(
    "fx_rain_scenario",
    f"""SELECT s_suppkey AS site_id, CAST({MINS} AS BIGINT) AS duration_mins, CAST(ari AS DOUBLE) AS ari,
               CASE variant WHEN 0 THEN NULL WHEN 1 THEN 2.5 ELSE 8.5 END AS rcp,
               CASE variant WHEN 0 THEN NULL WHEN 1 THEN '2031-2050' ELSE '2081-2100' END AS time_period,
               (10 + s_suppkey % 17) * k + ari + variant AS depth
        FROM {{supplier}} {{each:k:1,2,3,4,5,6,7,8,9,10,11,12}} {{each:ari:2,50,100}} {{each:variant:0,1,2}}""",
)
fixture(
    "fx_slr",
    """SELECT s_suppkey AS point_id, 1500000 + (s_suppkey * 7919) % 100000 AS x, 5100000 + (s_suppkey * 104729) % 100000 AS y,
              CASE WHEN conf = 0 THEN 'low' ELSE 'medium' END AS confidence_level,
              CASE WHEN ssp = 0 THEN 'SSP1-2.6' WHEN conf = 0 THEN 'SSP5-8.5' ELSE 'SSP2-4.5' END AS ssp_scenario,
              vlm = 1 AS add_vlm, percentile, 2020 + 10 * step + CASE WHEN conf = 0 THEN 100 ELSE 0 END AS year,
              (step * step * 3 + step * (s_suppkey % 7) + percentile + vlm * 5 + ssp * 2) AS rise
       FROM {supplier} {each:conf:0,1} {each:ssp:0,1} {each:vlm:0,1} {each:percentile:17,50,83} {each:step:1,2,3,4,5,6,7,8}""",
)
fixture(
    "fx_slr_request",
    """SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence_level,
              CASE c_nationkey % 4 WHEN 0 THEN 'SSP1-2.6' WHEN 1 THEN 'SSP2-4.5' WHEN 2 THEN 'SSP5-8.5' ELSE 'SSP3-7.0' END AS ssp_scenario,
              CASE c_custkey % 4 WHEN 0 THEN 17 WHEN 1 THEN 50 WHEN 2 THEN 83 ELSE 95 END AS percentile,
              2000 + c_custkey % 300 AS year FROM {customer}""",
)
fixture(
    "fx_tide",
    """SELECT CASE user_id % 4 WHEN 0 THEN 'bottom' WHEN 1 THEN 'right' WHEN 2 THEN 'top' ELSE 'left' END AS position,
              {epoch:ts} AS epoch, CAST(round(value * 100) AS BIGINT) AS level FROM {events}""",
)
fixture(
    "fx_rise",
    """SELECT CASE c_custkey % 4 WHEN 0 THEN 'bottom' WHEN 1 THEN 'right' WHEN 2 THEN 'top' ELSE 'left' END AS position,
              2030 + c_nationkey AS year, max(CAST(round(c_acctbal) AS BIGINT)) AS rise FROM {customer} GROUP BY 1, 2""",
)
fixture(
    "fx_inflow",
    """SELECT c_custkey AS objectid, 1500000 + (c_custkey * 7919) % 100000 AS x, 5100000 + (c_custkey * 104729) % 100000 AS y,
              c_custkey % 50 + 10 AS f, c_name AS note FROM {customer}""",
)
fixture(
    "fx_waterway",
    """SELECT p_partkey AS osm_id, CASE p_size % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'stream' WHEN 2 THEN 'drain' ELSE 'canal' END AS waterway,
              1500000 + (p_partkey * 31337) % 100000 AS x0, 5100000 + (p_partkey * 15485863) % 100000 AS y0,
              1500000 + (p_partkey * 31337) % 100000 + CASE WHEN p_partkey % 2 = 0 THEN p_size * 40 ELSE 0 END AS x1,
              5100000 + (p_partkey * 15485863) % 100000 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size * 40 END AS y1 FROM {part}""",
)

# ---------------------------------------------------------------- network

fixture(
    "fx_link",
    """SELECT c_custkey AS objectid, c_custkey AS upper_node,
              CASE WHEN c_custkey % 10 = 9 THEN c_custkey + 1000000 ELSE CAST(floor(c_custkey / 2) AS BIGINT) END AS lower_node,
              c_custkey % 4 = 1 AS flipped FROM {customer} WHERE c_custkey > 0""",
)
fixture(
    "fx_line",
    """SELECT objectid, 1500000 + (a % 1000) * 10 AS ax, 5100000 + CAST(floor(a / 1000) AS BIGINT) * 10 AS ay,
              1500000 + (b % 1000) * 10 AS bx, 5100000 + CAST(floor(b / 1000) AS BIGINT) * 10 AS b_y, a, b
       FROM (SELECT objectid, CASE WHEN flipped THEN lower_node ELSE upper_node END AS a,
                    CASE WHEN flipped THEN upper_node ELSE lower_node END AS b FROM fx_link) l""",
)
fixture("fx_outlet", "SELECT min(c_custkey) AS id FROM {customer}")
fixture("fx_present", "SELECT o_custkey AS upper_node, CAST(floor(o_custkey / 2) AS BIGINT) AS lower_node FROM {orders}")
fixture(
    "fx_network",
    """SELECT s_suppkey + 1 AS rec_network_id, 1500000 + (s_suppkey * 7919) % 70000 AS xmin, 5100000 + (s_suppkey * 104729) % 70000 AS ymin,
              1500000 + (s_suppkey * 7919) % 70000 + 20000 + (s_suppkey % 5) * 3000 AS xmax,
              5100000 + (s_suppkey * 104729) % 70000 + 20000 + (s_suppkey % 7) * 2000 AS ymax FROM {supplier}""",
)
fixture(
    "fx_basin",
    """SELECT basin_id, 1500000 + slot % 45 * 2000 AS ox,
              5100000 + (CAST(floor(slot / 45) AS BIGINT) + 45 * CAST(floor(basin_id / 2025) AS BIGINT)) * 2000 AS oy
       FROM (SELECT basin_id, basin_id * 733 % 2025 AS slot
             FROM (SELECT DISTINCT CAST(floor(c_custkey / 16) AS BIGINT) AS basin_id FROM {customer}) n) s""",
)
fixture(
    "fx_branch",
    """SELECT objectid, ox + CASE WHEN turned THEN qx ELSE px END AS ax, oy + CASE WHEN turned THEN qy ELSE py END AS ay,
              ox + CASE WHEN turned THEN px ELSE qx END AS bx, oy + CASE WHEN turned THEN py ELSE qy END AS b_y
       FROM (SELECT objectid, basin_id, n % 4 = 1 AS turned,
                    CASE n WHEN 0 THEN 20 WHEN 14 THEN 500 ELSE 200 + a * 7 % 16 * 100 END AS px,
                    CASE n WHEN 0 THEN 20 WHEN 14 THEN 1350 ELSE 200 + a * 5 % 8 * 100 END AS py,
                    CASE n WHEN 0 THEN 60 WHEN 12 THEN 2600 WHEN 13 THEN 1800 WHEN 14 THEN 1500 ELSE 200 + b * 7 % 16 * 100 END AS qx,
                    CASE n WHEN 0 THEN 60 WHEN 12 THEN 600 WHEN 13 THEN 350 WHEN 14 THEN 1350 ELSE 200 + b * 5 % 8 * 100 END AS qy
             FROM (SELECT objectid, basin_id, n, CASE n WHEN 11 THEN 4 WHEN 15 THEN 7 ELSE n END AS a,
                          CASE n WHEN 11 THEN 3 WHEN 15 THEN 6 ELSE CAST(floor(n / 2) AS BIGINT) END AS b
                   FROM (SELECT c_custkey AS objectid, CAST(floor(c_custkey / 16) AS BIGINT) AS basin_id, c_custkey % 16 AS n FROM {customer}) c) e) l
       JOIN fx_basin USING (basin_id)""",
)
fixture(
    "fx_channel",
    """SELECT objectid AS osm_id, CASE objectid % 5 WHEN 0 THEN 'drain' WHEN 1 THEN 'stream' ELSE 'river' END AS waterway,
              ax + objectid * 37 % 500 - 250 AS ax, ay + objectid * 53 % 400 - 200 AS ay,
              bx + objectid * 37 % 500 - 250 AS bx, b_y + objectid * 53 % 400 - 200 AS b_y FROM fx_branch""",
)
fixture(
    "fx_ground",
    """SELECT ox + 50 + i * 100 AS x, oy + 50 + j * 100 AS y, (basin_id * 31 + i * 7 + j * 13) % 101 AS z
       FROM fx_basin {each:i:0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19} {each:j:0,1,2,3,4,5,6,7,8,9,10}""",
)
