"""Geometry as a struct column, with predicates and measures as plain Column expressions.

A geometry is ``kind`` (upper-case WKT name without ``MULTI``'s brackets resolved), ``parts`` and a stored
bounding box. ``parts`` is always polygons -> rings -> points; a line or a point is a part with one "ring".
The bounding box is stored so Parquet statistics prune row groups before a predicate is evaluated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_TYPE = "struct<x:double,y:double>"
PARTS_TYPE = f"array<array<array<{POINT_TYPE}>>>"
GEOMETRY_TYPE = f"struct<kind:string,parts:{PARTS_TYPE},xmin:double,ymin:double,xmax:double,ymax:double>"
BOX = ("xmin", "ymin", "xmax", "ymax")

# Bracket depth of each WKT / GeoJSON geometry's coordinate list.
_LEVELS = {"POINT": 0, "LINESTRING": 1, "MULTIPOINT": 1, "POLYGON": 2, "MULTILINESTRING": 2, "MULTIPOLYGON": 3}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Inside higher-order functions Spark shares no subexpressions, so a repeated term is a repeated cost.
    """
    return F.transform(F.array(value), body)[0]


def point(x: Column | str, y: Column | str) -> Column:
    """A coordinate pair struct."""
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def geometry(kind: Column | str, parts: Column) -> Column:
    """Assemble a geometry struct and its bounding box from ``parts``."""
    kind_col = F.lit(kind) if isinstance(kind, str) else kind

    def boxed(row: Column) -> Column:
        return F.struct(
            row["kind"].alias("kind"),
            row["parts"].alias("parts"),
            F.array_min(F.transform(row["flat"], lambda p: p["x"])).alias("xmin"),
            F.array_min(F.transform(row["flat"], lambda p: p["y"])).alias("ymin"),
            F.array_max(F.transform(row["flat"], lambda p: p["x"])).alias("xmax"),
            F.array_max(F.transform(row["flat"], lambda p: p["y"])).alias("ymax"),
        )

    flattened = let(
        F.struct(kind_col.alias("kind"), parts.alias("parts")),
        lambda row: F.struct(
            row["kind"].alias("kind"), row["parts"].alias("parts"), F.flatten(F.flatten(row["parts"])).alias("flat")
        ),
    )
    return let(flattened, boxed)


def point_geometry(x: Column | str, y: Column | str) -> Column:
    return geometry("POINT", F.array(F.array(F.array(point(x, y)))))


def line_geometry(points: Column) -> Column:
    """Line string from an array of point structs."""
    return geometry("LINESTRING", F.array(F.array(points)))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed ring of a rectangle, counter-clockwise from its lower-left corner."""
    return F.array(
        point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin)
    )


def box_geometry(xmin: Column | str, ymin: Column | str, xmax: Column | str, ymax: Column | str) -> Column:
    """Rectangle constructor."""
    return geometry("POLYGON", F.array(F.array(box_ring(_c(xmin), _c(ymin), _c(xmax), _c(ymax)))))


# ---------------------------------------------------------------- text in and out


def _parts_from_json(kind: Column, coords: Column) -> Column:
    """``coords``: JSON array text at the natural depth of ``kind``, with points as two-element arrays."""
    nested = "array<array<array<array<double>>>>"

    def wrapped(left: str, right: str) -> Column:
        return F.from_json(F.concat(F.lit(left), coords, F.lit(right)), nested)

    def each_alone(items: Column) -> Column:
        return F.transform(items, lambda item: F.array(item))

    single_part = F.element_at(wrapped("[[", "]]"), 1)
    raw = (
        F.when(kind == "MULTIPOLYGON", wrapped("", ""))
        .when(kind == "POLYGON", wrapped("[", "]"))
        .when(kind == "LINESTRING", wrapped("[[", "]]"))
        .when(kind == "POINT", wrapped("[[[", "]]]"))
        .when(kind == "MULTILINESTRING", each_alone(F.element_at(wrapped("[", "]"), 1)))
        .when(
            kind == "MULTIPOINT",
            each_alone(F.transform(F.element_at(single_part, 1), lambda p: F.array(p))),
        )
    )
    return F.transform(
        raw,
        lambda part: F.transform(
            part, lambda ring: F.transform(ring, lambda p: point(F.element_at(p, 1), F.element_at(p, 2)))
        ),
    )


def from_wkt(wkt: Column | str) -> Column:
    """Parse WKT (2D, single or multi geometries, no collections); null for other input."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"

    def parse(text: Column) -> Column:
        kind = F.upper(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
        body = F.regexp_replace(text, r"^[A-Za-z]+\s*", "")
        # "(x y)" inside a MULTIPOINT is optional; drop the inner brackets so both spellings parse alike.
        body = F.when(
            kind == "MULTIPOINT", F.concat(F.lit("("), F.regexp_replace(body, r"[()]", ""), F.lit(")"))
        ).otherwise(body)
        pairs = F.regexp_replace(body, rf"({number}) ({number})", "[$1,$2]")
        coords = F.translate(F.regexp_replace(pairs, r"\s", ""), "()", "[]")
        coords = F.when(kind == "POINT", F.regexp_extract(coords, r"^\[(.*)\]$", 1)).otherwise(coords)
        return F.struct(kind.alias("kind"), coords.alias("coords"))

    return let(let(F.trim(F.regexp_replace(_c(wkt), r"\s+", " ")), parse), _from_kind_and_coords)


def from_geojson(text: Column | str) -> Column:
    """Parse the text of a GeoJSON geometry object."""
    col = _c(text)
    kind = F.upper(F.get_json_object(col, "$.type"))
    coords = F.get_json_object(col, "$.coordinates")
    return let(F.struct(kind.alias("kind"), coords.alias("coords")), _from_kind_and_coords)


def _from_kind_and_coords(row: Column) -> Column:
    known = row["kind"].isin(*_LEVELS)
    return F.when(known, geometry(row["kind"], _parts_from_json(row["kind"], row["coords"])))


def number_text(value: Column) -> Column:
    """Shortest plain decimal text of a coordinate (no exponent), kept to 9 decimals."""
    text = value.cast("decimal(30,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def to_wkt(geom: Column | str) -> Column:
    """WKT text of a geometry."""
    g = _c(geom)

    def points_text(ring: Column) -> Column:
        return F.array_join(
            F.transform(ring, lambda p: F.concat(number_text(p["x"]), F.lit(" "), number_text(p["y"]))), ", "
        )

    def ring_text(ring: Column) -> Column:
        return F.concat(F.lit("("), points_text(ring), F.lit(")"))

    def part_text(part: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(part, ring_text), ", "), F.lit(")"))

    # A part of a line or point geometry holds one "ring", so its bare ring text is the part's text.
    line_parts = F.array_join(F.transform(g["parts"], lambda part: ring_text(F.element_at(part, 1))), ", ")
    polygon_parts = F.array_join(F.transform(g["parts"], part_text), ", ")
    body = (
        F.when(g["kind"].isin("POINT", "LINESTRING"), line_parts)
        .when(g["kind"] == "POLYGON", polygon_parts)
        .when(g["kind"] == "MULTIPOLYGON", F.concat(F.lit("("), polygon_parts, F.lit(")")))
        .otherwise(F.concat(F.lit("("), line_parts, F.lit(")")))
    )
    return F.concat(g["kind"], F.lit(" "), body)


# ---------------------------------------------------------------- measures


def _segment_fold(ring: Column, term) -> Column:
    """Sum ``term(p, q)`` over consecutive points of a ring."""
    n = F.size(ring)
    starts = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    ends = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.aggregate(F.zip_with(starts, ends, term), F.lit(0.0), lambda acc, value: acc + value)


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area of a closed ring."""
    first = F.element_at(ring, 1)

    # Offsetting by the first vertex keeps full precision for projected coordinates in the millions.
    def cross(p: Column, q: Column) -> Column:
        return (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"])

    return F.abs(_segment_fold(ring, cross)) / 2.0


def area(geom: Column | str) -> Column:
    """Polygon area: outer rings minus holes; 0 for lines and points."""
    g = _c(geom)

    def part_area(part: Column) -> Column:
        return let(
            F.transform(part, ring_area),
            lambda rings: F.element_at(rings, 1) * 2.0 - F.aggregate(rings, F.lit(0.0), lambda acc, value: acc + value),
        )

    value = F.aggregate(F.transform(g["parts"], part_area), F.lit(0.0), lambda acc, value: acc + value)
    # Boxes, of which there may be very many, need no sum over their segments.
    value = F.when(is_box(g), (g["xmax"] - g["xmin"]) * (g["ymax"] - g["ymin"])).otherwise(value)
    return F.when(g["kind"].isin("POLYGON", "MULTIPOLYGON"), value).otherwise(F.lit(0.0))


def length(geom: Column | str) -> Column:
    """Total length of all parts (perimeter for polygons)."""

    def hop(p: Column, q: Column) -> Column:
        return F.hypot(q["x"] - p["x"], q["y"] - p["y"])

    rings = F.transform(F.flatten(_c(geom)["parts"]), lambda ring: _segment_fold(ring, hop))
    return F.aggregate(rings, F.lit(0.0), lambda acc, value: acc + value)


def bounds(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row: the bounding box of every geometry in the frame."""
    return total_bounds(df, *(F.col(f"{geom}.{side}") for side in BOX))


def total_bounds(df: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column, *keys: str) -> DataFrame:
    """Bounding box of the frame, or of each group of ``keys``."""
    return df.groupBy(*keys).agg(
        F.min(xmin).alias("xmin"), F.min(ymin).alias("ymin"), F.max(xmax).alias("xmax"), F.max(ymax).alias("ymax")
    )


# ---------------------------------------------------------------- structure


def explode_parts(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row per part of a multi geometry, numbered by ``part_no`` from 0."""
    single = F.regexp_replace(F.col(f"{geom}.kind"), "^MULTI", "")
    return (
        df.select("*", F.posexplode(f"{geom}.parts").alias("part_no", "_part"))
        .withColumn(geom, geometry(single, F.array(F.col("_part"))))
        .drop("_part")
    )


def first_point(geom: Column | str) -> Column:
    return F.element_at(F.flatten(F.flatten(_c(geom)["parts"])), 1)


def last_point(geom: Column | str) -> Column:
    return F.element_at(F.flatten(F.flatten(_c(geom)["parts"])), -1)


def reversed_line(geom: Column | str) -> Column:
    """The same line or lines, drawn from the other end."""
    geom = _c(geom)
    turned = F.transform(geom["parts"], lambda part: F.transform(part, lambda points: F.reverse(points)))
    return geom.withField("parts", F.reverse(turned))


def segments(geom: Column | str) -> Column:
    """Array of ``struct<a,b>`` over all consecutive point pairs."""

    def ring_segments(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(
            F.slice(ring, F.lit(1), n),
            F.slice(ring, F.lit(2), n),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )

    return F.flatten(F.transform(F.flatten(_c(geom)["parts"]), ring_segments))


def running_totals(values: Column) -> Column:
    """The sums of the values up to and with each, as an array, in time n log n.

    Each step adds the totals of up to seven neighbours to the left, so that runs of 8, 64, 512 ... values are summed;
    an array that is no longer than a run is done.
    """

    def step(totals: Column, reach: int) -> Column:
        def widened(own: Column) -> Column:
            def added(total: Column, at: Column) -> Column:
                for k in range(1, 8):
                    total = total + F.when(at >= k * reach, F.get(own, at - k * reach)).otherwise(0.0)
                return total

            return F.transform(own, added)

        if reach >= 1 << 30:
            return totals
        return let(totals, lambda own: F.when(F.size(own) <= reach, own).otherwise(step(widened(own), reach * 8)))

    return step(values, 1)


def measured_segments(geom: Column | str) -> Column:
    """:func:`segments` with their ``length`` and the length of the line ``before`` them."""

    def measured(parts: Column) -> Column:
        lengths = F.transform(parts, lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))
        def placed(own: Column) -> Column:
            ways = F.zip_with(own, running_totals(own), lambda way, upto: F.struct(way.alias("length"), (upto - way).alias("before")))
            return F.zip_with(parts, ways, lambda s, w: F.struct(s["a"].alias("a"), s["b"].alias("b"), w["length"].alias("length"), w["before"].alias("before")))

        return let(lengths, placed)

    return let(segments(geom), measured)


# ---------------------------------------------------------------- predicates


def boxes_intersect(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Closed rectangles share at least a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_contains(outer: Sequence[Column], inner: Sequence[Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def box_strictly_contains(outer: Sequence[Column], inner: Sequence[Column]) -> Column:
    """The inner box does not reach the outer one's boundary."""
    return (outer[0] < inner[0]) & (outer[1] < inner[1]) & (inner[2] < outer[2]) & (inner[3] < outer[3])


def box_columns(geom: Column | str) -> tuple[Column, Column, Column, Column]:
    g = _c(geom)
    return g["xmin"], g["ymin"], g["xmax"], g["ymax"]


def _orient(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _in_span(a: Column, b: Column, p: Column) -> Column:
    return (
        (F.least(a["x"], b["x"]) <= p["x"])
        & (p["x"] <= F.greatest(a["x"], b["x"]))
        & (F.least(a["y"], b["y"]) <= p["y"])
        & (p["y"] <= F.greatest(a["y"], b["y"]))
    )


def _segments_touch(s: Column, t: Column) -> Column:
    o1, o2 = _orient(s["a"], s["b"], t["a"]), _orient(s["a"], s["b"], t["b"])
    o3, o4 = _orient(t["a"], t["b"], s["a"]), _orient(t["a"], t["b"], s["b"])
    return (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & _in_span(s["a"], s["b"], t["a"]))
        | ((o2 == 0) & _in_span(s["a"], s["b"], t["b"]))
        | ((o3 == 0) & _in_span(t["a"], t["b"], s["a"]))
        | ((o4 == 0) & _in_span(t["a"], t["b"], s["b"]))
    )


def _on_segments(segs: Column, p: Column) -> Column:
    return F.exists(segs, lambda s: (_orient(s["a"], s["b"], p) == 0) & _in_span(s["a"], s["b"], p))


def _inside_segments(segs: Column, p: Column) -> Column:
    def crosses(acc: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(((a["y"] > p["y"]) != (b["y"] > p["y"])) & F.coalesce(p["x"] < at, F.lit(False)), ~acc).otherwise(acc)

    return F.aggregate(F.filter(segs, lambda s: s["a"]["y"] != s["b"]["y"]), F.lit(False), crosses)


def _covered(segs: Column, p: Column) -> Column:
    return _inside_segments(segs, p) | _on_segments(segs, p)


def point_on_boundary(p: Column, geom: Column | str) -> Column:
    return _on_segments(segments(geom), p)


def point_inside(p: Column, geom: Column | str) -> Column:
    """Even-odd test over all rings, so holes count as outside; boundary points are not reliable here."""
    return _inside_segments(segments(geom), p)


def covers_point(geom: Column | str, p: Column) -> Column:
    """Polygon covers the point, boundary included."""
    g = _c(geom)
    inside_box = (g["xmin"] <= p["x"]) & (p["x"] <= g["xmax"]) & (g["ymin"] <= p["y"]) & (p["y"] <= g["ymax"])
    return inside_box & let(segments(g), lambda segs: _covered(segs, p))


def _with_segments(a: Column, b: Column, body) -> Column:
    both = F.struct(
        a.alias("a"), b.alias("b"), segments(a).alias("sa"), segments(b).alias("sb")
    )
    return let(both, lambda row: body(row["a"], row["b"], row["sa"], row["sb"]))


def _is_polygon(g: Column) -> Column:
    return g["kind"].isin("POLYGON", "MULTIPOLYGON")


def is_box(geom: Column) -> Column:
    """A polygon of one ring that is its own box: opposite corners, and the two others made of their coordinates."""
    ring = F.get(F.get(geom["parts"], F.lit(0)), F.lit(0))
    p, q, r, s, end = (F.get(ring, F.lit(i)) for i in range(5))

    def corner(v: Column, at_x: Column, at_y: Column) -> Column:
        return (v["x"] == at_x["x"]) & (v["y"] == at_y["y"])

    single = (F.size(geom["parts"]) == 1) & (F.size(F.get(geom["parts"], F.lit(0))) == 1) & (F.size(ring) == 5)
    turns = (corner(q, p, r) & corner(s, r, p)) | (corner(q, r, p) & corner(s, p, r))
    return _is_polygon(geom) & single & corner(end, p, p) & (p["x"] != r["x"]) & (p["y"] != r["y"]) & turns


def intersects(a: Column | str, b: Column | str, b_is_box: bool = False) -> Column:
    """Geometries share at least one point; touching boundaries count. ``b_is_box``: ``b`` is known to be made as a box.

    Where one is a box, the other's box mostly settles the matter, or a vertex in it, without a look at the segments, which
    cost far more.
    """
    ga, gb = _c(a), _c(b)

    def test(ga: Column, gb: Column, sa: Column, sb: Column) -> Column:
        edges = F.exists(sa, lambda s: F.exists(sb, lambda t: _segments_touch(s, t)))
        # When no edges meet, either one geometry lies wholly in the other or they are apart. Testing one
        # point of every part catches the first case.
        a_in_b = _is_polygon(gb) & F.exists(ga["parts"], lambda part: _covered(sb, part[0][0]))
        b_in_a = _is_polygon(ga) & F.exists(gb["parts"], lambda part: _covered(sa, part[0][0]))
        points = (ga["kind"] == "POINT") & (gb["kind"] == "POINT")
        same_point = points & (ga["xmin"] == gb["xmin"]) & (ga["ymin"] == gb["ymin"])
        on_line = ((ga["kind"] == "POINT") & _on_segments(sb, first_point(ga))) | (
            (gb["kind"] == "POINT") & _on_segments(sa, first_point(gb))
        )
        return a_in_b | b_in_a | edges | same_point | on_line

    box_a, box_b = box_columns(ga), box_columns(gb)

    def vertex_in(geom: Column, box: Sequence[Column]) -> Column:
        xmin, ymin, xmax, ymax = box

        def inside(v: Column) -> Column:
            return (v["x"] >= xmin) & (v["x"] <= xmax) & (v["y"] >= ymin) & (v["y"] <= ymax)

        return F.exists(geom["parts"], lambda part: F.exists(part, lambda ring: F.exists(ring, inside)))

    def spanned(geom: Column, own: Sequence[Column], box: Sequence[Column]) -> Column:
        """One ring or line that reaches beyond the box along one axis at most: it is connected, so it meets the box."""
        single = (F.size(geom["parts"]) == 1) & (F.size(F.get(geom["parts"], F.lit(0))) == 1)
        return single & (((box[0] <= own[0]) & (own[2] <= box[2])) | ((box[1] <= own[1]) & (own[3] <= box[3])))

    of_b = F.lit(True) if b_is_box else is_box(gb)
    settled = (spanned(ga, box_a, box_b) & of_b) | (spanned(gb, box_b, box_a) & is_box(ga))
    held = (of_b & vertex_in(ga, box_b)) | (is_box(ga) & vertex_in(gb, box_a))
    return boxes_intersect(box_a, box_b) & F.when(settled, F.lit(True)).when(held, F.lit(True)).otherwise(_with_segments(ga, gb, test))


def contains(outer: Column | str, inner: Column | str) -> Column:
    """Polygon ``outer`` contains ``inner``: every vertex is covered and no edge leaves it.

    An edge leaves when it properly crosses an outer edge, or when some stretch of it between two outer vertices
    that lie on it runs outside; so notches that an edge spans from tip to tip are found.
    """
    go, gi = _c(outer), _c(inner)

    def proper_cross(s: Column, t: Column) -> Column:
        return (_orient(s["a"], s["b"], t["a"]) * _orient(s["a"], s["b"], t["b"]) < 0) & (
            _orient(t["a"], t["b"], s["a"]) * _orient(t["a"], t["b"], s["b"]) < 0
        )

    def stretches_inside(so: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]

        def on_edge(p: Column) -> Column:
            within_x = (p["x"] >= F.least(a["x"], b["x"])) & (p["x"] <= F.greatest(a["x"], b["x"]))
            within_y = (p["y"] >= F.least(a["y"], b["y"])) & (p["y"] <= F.greatest(a["y"], b["y"]))
            return within_x & within_y & (_orient(a, b, p) == 0)

        def along(p: Column) -> Column:
            return F.when(F.abs(dx) >= F.abs(dy), (p["x"] - a["x"]) / dx).otherwise((p["y"] - a["y"]) / dy)

        ends = F.array(F.lit(0.0), F.lit(1.0))
        cuts = F.array_sort(F.concat(ends, F.transform(F.filter(so, lambda o: on_edge(o["a"])), lambda o: along(o["a"]))))

        def middle(c: Column, i: Column) -> Column:
            t = (F.get(c, i - 1) + F.get(c, i)) / 2.0
            return point(a["x"] + dx * t, a["y"] + dy * t)

        return let(cuts, lambda c: F.forall(F.sequence(F.lit(1), F.size(c) - 1), lambda i: let(middle(c, i), lambda m: _covered(so, m))))

    def test(go: Column, gi: Column, so: Column, si: Column) -> Column:
        return (
            F.forall(F.flatten(F.flatten(gi["parts"])), lambda p: _covered(so, p))
            & F.forall(si, lambda s: stretches_inside(so, s))
            & ~F.exists(si, lambda s: F.exists(so, lambda t: proper_cross(s, t)))
        )

    # What lies in the box of a box lies in it.
    return box_contains(box_columns(go), box_columns(gi)) & F.when(is_box(go), F.lit(True)).otherwise(_with_segments(go, gi, test))


# ---------------------------------------------------------------- distances


def box_distance_sq(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared distance between closed rectangles (0 when they meet); points are boxes of no size."""
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0))
    return dx * dx + dy * dy


def point_segment_distance_sq(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    len_sq = dx * dx + dy * dy
    raw = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(len_sq != 0, len_sq)
    along = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))

    def distance(t: Column) -> Column:
        ex, ey = p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy)
        return ex * ex + ey * ey

    return let(along, distance)


def segment_box_distance_sq(a: Column, b: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Squared distance between a segment and a closed rectangle."""
    corners = F.array(*(point(x, y) for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))))
    to_corners = F.array_min(F.transform(corners, lambda c: point_segment_distance_sq(c, a, b)))
    box = (xmin, ymin, xmax, ymax)
    to_ends = [box_distance_sq((p["x"], p["y"], p["x"], p["y"]), box) for p in (a, b)]

    # The segment passes through the rectangle when the parameter intervals inside both slabs overlap
    # (Liang and Barsky 1984). A segment parallel to a slab is inside it always or never.
    def slab(p: Column, q: Column, low: Column, high: Column) -> Column:
        run = F.when(q != p, q - p)
        t0, t1 = (low - p) / run, (high - p) / run
        inside = (p >= low) & (p <= high)
        return F.struct(
            F.coalesce(F.when(run.isNotNull(), F.least(t0, t1)), F.when(inside, 0.0).otherwise(2.0)).alias("lo"),
            F.coalesce(F.when(run.isNotNull(), F.greatest(t0, t1)), F.lit(1.0)).alias("hi"),
        )

    slabs = F.struct(slab(a["x"], b["x"], xmin, xmax).alias("x"), slab(a["y"], b["y"], ymin, ymax).alias("y"))
    meets = let(
        slabs,
        lambda s: F.greatest(s["x"]["lo"], s["y"]["lo"], F.lit(0.0)) <= F.least(s["x"]["hi"], s["y"]["hi"], F.lit(1.0)),
    )
    return F.when(meets, F.lit(0.0)).otherwise(F.least(to_corners, *to_ends))


def grow(box: Sequence[Column], distance: float) -> tuple[Column, Column, Column, Column]:
    """Rectangle grown by ``distance`` on all sides; the exact round buffer is this plus a distance test."""
    return box[0] - distance, box[1] - distance, box[2] + distance, box[3] + distance


# ---------------------------------------------------------------- clipping


def _half_plane_clip(ring: Column, plane: Column) -> Column:
    """Open ring clipped to ``plane.a * x + plane.b * y <= plane.c`` (Sutherland and Hodgman 1974)."""

    def side(p: Column) -> Column:
        return plane["a"] * p["x"] + plane["b"] * p["y"] - plane["c"]

    def kept(p: Column, q: Column) -> Column:
        sp, sq = side(p), side(q)
        t = sp / (sp - sq)
        cut = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
        none = F.array().cast(f"array<{POINT_TYPE}>")
        return (
            F.when((sp <= 0) & (sq <= 0), F.array(q))
            .when((sp <= 0) & (sq > 0), F.when(sp == 0, none).otherwise(F.array(cut)))
            .when((sp > 0) & (sq <= 0), F.when(sq == 0, F.array(q)).otherwise(F.array(cut, q)))
            .otherwise(none)
        )

    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    return F.flatten(F.zip_with(ring, following, kept)).cast(f"array<{POINT_TYPE}>")


PLANE_TYPE = "struct<a:double,b:double,c:double>"


def plane(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))


def clip_ring(ring: Column, planes: Column) -> Column:
    """Closed ring clipped to all half planes; an empty array when nothing is left."""
    opened = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).cast(f"array<{POINT_TYPE}>")
    clipped = F.aggregate(planes, opened, _half_plane_clip)
    none = F.array().cast(f"array<{POINT_TYPE}>")
    return let(clipped, lambda r: F.when(F.size(r) >= 3, F.concat(r, F.slice(r, F.lit(1), F.lit(1)))).otherwise(none))


def box_planes(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(
        plane(-one, zero, -xmin), plane(one, zero, xmax), plane(zero, -one, -ymin), plane(zero, one, ymax)
    )


def clip_to_box(geom: Column | str, xmin: Column, ymin: Column, xmax: Column, ymax: Column, boxed: Column | None = None) -> Column:
    """Polygon clipped to a rectangle, ring by ring; null when they share no area. ``boxed`` tells, where it is known
    already, whether the polygon is a box (:func:`is_box`).

    A concave ring may come back with edges doubled along the rectangle; its area is still right.
    """
    g = _c(geom)
    planes = box_planes(xmin, ymin, xmax, ymax)
    clipped = F.transform(
        g["parts"],
        lambda part: F.filter(F.transform(part, lambda ring: clip_ring(ring, planes)), lambda ring: F.size(ring) > 0),
    )
    # A part whose outer ring is gone has no holes left either, as they lie inside it.
    parts = F.filter(clipped, lambda part: F.size(part) > 0)
    cut = let(parts, lambda rest: F.when(F.size(rest) > 0, geometry(g["kind"], rest)))
    # What only touches the rectangle from outside leaves a ring of no width.
    cut = let(cut, lambda c: F.when((c["xmin"] < c["xmax"]) & (c["ymin"] < c["ymax"]), c))
    # What boxes have in common is a box, told without clipping, which costs far more.
    low = [F.greatest(xmin, g["xmin"]).cast("double"), F.greatest(ymin, g["ymin"]).cast("double")]
    high = [F.least(xmax, g["xmax"]).cast("double"), F.least(ymax, g["ymax"]).cast("double")]
    shared = F.struct(
        g["kind"].alias("kind"), F.array(F.array(box_ring(*low, *high))).alias("parts"), *(c.alias(side) for c, side in zip([*low, *high], BOX, strict=True))
    )
    of_boxes = F.when((low[0] < high[0]) & (low[1] < high[1]), shared)
    whole = box_contains((xmin, ymin, xmax, ymax), box_columns(g))
    return F.when(whole, g).when(is_box(g) if boxed is None else boxed, of_boxes).otherwise(cut)
