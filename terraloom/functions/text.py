"""String, JSON and duration helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column) -> Column:
    """Remove all surrounding whitespace, newlines included (``trim`` removes spaces only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def blank_to_null(col: Column) -> Column:
    """An empty or blank string counts as missing."""
    return F.when(strip(col) != "", col)


def title_from_name(col: Column) -> Column:
    """``static_files`` -> ``Static Files``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without directories and its last suffix."""
    return F.regexp_extract(file_name(path), r"^(.+?)(?:\.[^.]*)?$", 1)


def file_suffix(path: Column) -> Column:
    """Last suffix with its dot, or an empty string."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def canonical_json(col: Column) -> Column:
    """JSON text with sorted keys and no spacing, so equal documents are equal strings.

    Numbers keep their value, not their spelling (50.0 is 50); a string "50" stays a string. Text that is no JSON
    gives null, so one bad document cannot end a job. Of a repeated key the last value counts in sessions with the
    library's defaults (``spark.sql.variant.allowDuplicateKeys``); elsewhere such a document gives null.
    """
    return F.to_json(F.try_parse_json(col))


def duration_minutes(col: Column) -> Column:
    """``'10m'``, ``'24h'`` or ``'2d'`` to minutes; null for other text."""
    number = F.regexp_extract(col, r"^\D*?(\d+)\s*([mhd])", 1)
    unit = F.regexp_extract(col, r"^\D*?(\d+)\s*([mhd])", 2)
    factor = F.when(unit == "m", 1).when(unit == "h", 60).when(unit == "d", 1440)
    return F.when(number != "", number.cast("int")) * factor


def parse_epsg(col: Column) -> Column:
    """EPSG code inside a CRS name such as ``urn:ogc:def:crs:EPSG::2193`` or ``EPSG:2193``; CRS84 is 4326."""
    code = F.regexp_extract(F.upper(col), r"EPSG:+(?:[0-9.]*:)?([0-9]+)$", 1)
    return F.when(F.upper(col).rlike(r"\bCRS:?84$"), 4326).when(code != "", code.cast("int"))
