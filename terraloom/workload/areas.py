"""Coverage, spatial joins and overlays."""

from pyspark.sql import functions as F

from ..operators import overlay
from ..operators import spatial_join as sj
from . import fixtures  # noqa: F401
from .registry import query

CELL = 10_000.0

LOG_PAIRS = """
flat AS (SELECT unique_id AS log_id, table_a AS table_name, xmin, ymin, xmax, ymax FROM fx_log
         UNION SELECT unique_id, table_b, xmin, ymin, xmax, ymax FROM fx_log WHERE table_b IS NOT NULL),
pairs AS (SELECT r.aoi_id, r.table_name, f.log_id,
                 greatest(r.xmin, f.xmin) AS x0, greatest(r.ymin, f.ymin) AS y0,
                 least(r.xmax, f.xmax) AS x1, least(r.ymax, f.ymax) AS y1
          FROM fx_request r JOIN flat f ON r.table_name = f.table_name AND f.xmin <= r.xmax AND f.xmax >= r.xmin
               AND f.ymin <= r.ymax AND f.ymax >= r.ymin)"""


def coverage_log(fx):
    """The log with its table names as one array column."""
    tables = F.array_distinct(F.array_compact(F.array("table_a", "table_b")))
    return fx("fx_log").select("unique_id", tables.alias("source_table_list"), "xmin", "ymin", "xmax", "ymax")


@query("j6_coverage_lookup", f"WITH {LOG_PAIRS} SELECT aoi_id, table_name, log_id FROM pairs")
def j6(fx):
    found = overlay.coverage_lookup(fx("fx_request"), coverage_log(fx), CELL)
    return found.select("aoi_id", "table_name", "log_id")


@query(
    "ov1_uncovered_area",
    f"""WITH {LOG_PAIRS},
    edges AS (SELECT aoi_id, xmin, ymin, xmax, ymax FROM fx_request
              UNION ALL SELECT aoi_id, x0, y0, x1, y1 FROM pairs),
    xs AS (SELECT aoi_id, v AS x0, lead(v) OVER (PARTITION BY aoi_id ORDER BY v) AS x1
           FROM (SELECT aoi_id, xmin AS v FROM edges UNION SELECT aoi_id, xmax FROM edges)),
    ys AS (SELECT aoi_id, v AS y0, lead(v) OVER (PARTITION BY aoi_id ORDER BY v) AS y1
           FROM (SELECT aoi_id, ymin AS v FROM edges UNION SELECT aoi_id, ymax FROM edges)),
    cells AS (SELECT xs.aoi_id, x0, x1, y0, y1 FROM xs JOIN ys ON xs.aoi_id = ys.aoi_id
              WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
    open_cells AS (SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.aoi_id = c.aoi_id
              AND p.x0 <= c.x0 AND c.x1 <= p.x1 AND p.y0 <= c.y0 AND c.y1 <= p.y1))
    SELECT r.aoi_id, r.table_name, coalesce(sum((x1 - x0) * (y1 - y0)), 0)::BIGINT AS uncovered_area,
           sum((x1 - x0) * (y1 - y0)) IS NULL AS fully_covered
    FROM fx_request r LEFT JOIN open_cells o ON r.aoi_id = o.aoi_id GROUP BY r.aoi_id, r.table_name""",
)
def ov1(fx):
    requests = fx("fx_request")
    pieces = overlay.uncovered_area(requests, coverage_log(fx), CELL)
    summary = overlay.area_summary(requests, pieces)
    return summary.withColumn("uncovered_area", F.round("uncovered_area").cast("long"))
