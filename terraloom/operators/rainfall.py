"""Design storms: duration tables to hyetographs, and rain forcing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import weighted
from ..functions.text import duration_minutes
from ..session import cut_lineage
from ..sources import tables
from .series import resample

# Storm durations, hyetograph methods and rain input types.
DURATIONS = ("10m", "20m", "30m", "1h", "2h", "6h", "12h", "24h", "48h", "72h", "96h", "120h")
ALT_BLOCK, CHICAGO = "alt_block", "chicago"
UNIFORM, VARYING = "uniform", "varying"
#: Sites of one row of the wide form.
SITES_PER_BLOCK = 128


def filter_duration(rain: DataFrame, duration: str = "all") -> DataFrame:
    """Rows of one duration (``'10m'`` .. ``'120h'``) or all."""
    if duration == "all":
        return rain
    if duration not in DURATIONS:
        raise ValueError(f"unknown duration {duration!r}")
    return rain.filter(F.col("duration_mins") == duration_minutes(F.lit(duration)))


def filter_scenario(rain: DataFrame, ari: float, rcp: float | None = None, time_period: str | None = None) -> DataFrame:
    """One return period under one climate scenario; both scenario values missing means historical."""
    if (rcp is None) != (time_period is None):
        raise ValueError("give both rcp and time_period, or neither")
    return rain.filter(
        F.col("rcp").eqNullSafe(F.lit(rcp)) & F.col("time_period").eqNullSafe(F.lit(time_period)) & (F.col("ari") == ari)
    )


def scenario_for_sites(rain: DataFrame, sites: DataFrame, ari: float, rcp: float | None = None, time_period: str | None = None) -> DataFrame:
    """The scenario's rows of the listed sites, all sites at once."""
    return filter_scenario(rain, ari, rcp, time_period).join(sites.select("site_id"), "site_id", "left_semi")


def minutes_of(name: str) -> int:
    """Minutes of a duration column's name."""
    return int(name[:-1]) * {"m": 1, "h": 60}[name[-1]]


def long_durations(wide: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """One row per site and duration from one column per duration; missing depths are dropped.

    Minutes are read off the column names while planning, not per row.
    """
    pairs = [
        F.struct(F.lit(minutes_of(c)).cast("long").alias("mins"), F.col(f"`{c}`").cast("double").alias("depth"))
        for c in wide.columns
        if c in DURATIONS
    ]
    return wide.select(*keys, F.inline(F.array(*pairs))).filter("depth IS NOT NULL")


def wide_columns(sites: DataFrame) -> DataFrame:
    """Place of each site in the wide form: ``site_id, block, column``.

    A table of as many columns as there are sites has no bound, so every ``SITES_PER_BLOCK`` of them make a block of rows.
    """
    ids = sites.select(F.col("site_id").cast("long").alias("site_id")).filter("site_id IS NOT NULL").distinct()
    none = ids.select(F.lit(0).cast("bigint").alias("_no")).limit(0)
    placed = tables.with_new_ids(ids, none, "_no", ["site_id"]).withColumn("_no", F.col("_no") - 1)
    return placed.select("site_id", F.floor(F.col("_no") / SITES_PER_BLOCK).alias("block"), (F.col("_no") % SITES_PER_BLOCK).cast("int").alias("column"))


def wide_from_long(series: DataFrame, places: DataFrame, value: str, index: str = "seconds") -> DataFrame:
    """One row per time step and block of sites, one column ``0, 1, ..`` per site of :func:`wide_columns`; the listed
    columns keep the pivot from scanning for them."""
    placed = series.select("site_id", index, value).join(places, "site_id")
    return placed.groupBy(index, "block").pivot("column", list(range(SITES_PER_BLOCK))).agg(F.first(value))


def long_from_wide(wide: DataFrame, places: DataFrame, value: str, index: str = "seconds") -> DataFrame:
    columns = [c for c in wide.columns if c not in (index, "block")]
    long = wide.unpivot([index, "block"], columns, "column", value).filter(F.col(value).isNotNull())
    return long.withColumn("column", F.col("column").cast("int")).join(places, ["block", "column"]).select("site_id", index, value)


def interpolated(depths: DataFrame, increment: int, method: str = "linear") -> DataFrame:
    """Cumulative depth at every ``increment`` minutes, starting from no rain at minute 0."""
    if increment <= 0 or increment > duration_limit():
        raise ValueError("the increment is out of range")
    return resample(depths.select("site_id", "mins", "depth"), ["site_id"], "mins", "depth", increment, method, from_zero=True)


def duration_limit() -> int:
    return 120 * 60


def increments(cumulative: DataFrame) -> DataFrame:
    """Rain of each step: the difference to the step before."""
    order = Window.partitionBy("site_id").orderBy("mins")
    change = F.col("depth") - F.lag("depth").over(order)
    return cumulative.withColumn("depth", change).filter("mins > 0")


def storm_increments(steps: DataFrame, storm_length: int, increment: int) -> DataFrame:
    """Steps within the storm; a storm shorter than the first step is an error."""
    if storm_length < increment:
        raise ValueError("the storm is shorter than the shortest duration in the data")
    return steps.filter(F.col("mins") <= storm_length)


def _check_peak(storm_length: int, time_to_peak: float) -> None:
    if time_to_peak < storm_length / 2:
        raise ValueError("the time to peak is earlier than half of the storm")


def with_time(blocks: DataFrame) -> DataFrame:
    """Add seconds and hours to ``minutes``."""
    minutes = F.col("minutes").cast("double")
    return blocks.withColumn("minutes", minutes).withColumn("seconds", minutes * 60.0).withColumn("hours", minutes / 60.0)


def alternating_blocks(steps: DataFrame, storm_length: int, time_to_peak: float, increment: int) -> DataFrame:
    """Largest block at the peak, the next ones alternately after and before it (Chow et al. 1988)."""
    _check_peak(storm_length, time_to_peak)
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("depth"), "mins"))
    half = F.floor(F.col("_rank") / 2)
    offset = F.when(F.col("_rank") % 2 == 0, half).otherwise(-half)
    placed = steps.withColumn("_rank", rank).withColumn("minutes", F.lit(float(time_to_peak)) + offset * increment)
    return with_time(placed.select("site_id", "minutes", "depth"))


def chicago(steps: DataFrame, storm_length: int, time_to_peak: float, increment: int) -> DataFrame:
    """Each step's rain split in halves mirrored around the peak, on half steps (Keifer and Chu 1957)."""
    _check_peak(storm_length, time_to_peak)
    after = F.lit(float(time_to_peak)) + F.col("mins") / 2.0
    before = F.lit(float(time_to_peak)) - (F.col("mins") - increment) / 2.0
    halves = steps.select("site_id", F.explode(F.array(before, after)).alias("minutes"), (F.col("depth") / 2.0).alias("depth"))
    return with_time(halves)


def transformed(steps: DataFrame, storm_length: int, time_to_peak: float, increment: int, method: str) -> DataFrame:
    if method == ALT_BLOCK:
        return alternating_blocks(steps, storm_length, time_to_peak, increment)
    if method == CHICAGO:
        return chicago(steps, storm_length, time_to_peak, increment)
    raise ValueError(f"unknown hyetograph method {method!r}")


def intensity(blocks: DataFrame, increment: int, method: str) -> DataFrame:
    """Depth per block to mm per hour; the second method works on half steps."""
    step = increment / 2.0 if method == CHICAGO else float(increment)
    return blocks.withColumn("intensity", F.col("depth") * 60.0 / step).drop("depth")


def hyetograph(
    depths: DataFrame, storm_length: int, time_to_peak: float, increment: int, interpolation: str = "linear", method: str = ALT_BLOCK
) -> DataFrame:
    """Intensity over time for every site, from its duration table ``site_id, mins, depth``."""
    # Steps after the storm go first, as no step depends on a later one. The rows of a step list are many times those of
    # the duration tables, so they are dealt anew by their own number before they are sorted.
    cumulative = interpolated(depths, increment, interpolation).filter(F.col("mins") <= storm_length).repartition("site_id")
    steps = storm_increments(increments(cumulative), storm_length, increment)
    return intensity(transformed(steps, storm_length, time_to_peak, increment, method), increment, method)


# ---------------------------------------------------------------- forcing


def mean_rainfall(hyetographs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Area-weighted intensity per area and time step; ``coverage`` holds ``aoi_id, site_id, site_share``.

    An area's sum runs over all its sites and their steps, of which there are far more than results. So the series of a
    block of sites are one matrix in a task, the shares come past it, and only sums leave the task (:mod:`..functions.weighted`).
    Areas are dealt to buckets where few blocks would leave few tasks.
    """
    rain = hyetographs.filter("site_id IS NOT NULL").groupBy("site_id").agg(
        F.sort_array(F.collect_list(F.struct("seconds", F.col("intensity").cast("double").alias("intensity")))).alias("_s")
    )
    # Written once, for its size and for the copies that go to the buckets.
    rain = cut_lineage(rain.select("site_id", F.col("_s.seconds").alias("seconds"), F.col("_s.intensity").alias("intensity")))
    blocks = max(1, math.ceil((rain.agg(F.sum(F.size("seconds"))).first()[0] or 0) / weighted.VALUES))
    spark = rain.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    buckets = math.ceil(tasks / blocks)
    shares = coverage.select("aoi_id", "site_id", F.col("site_share").cast("double").alias("site_share")).filter("site_id IS NOT NULL")
    kinds = {name: coverage.schema[name].dataType for name in ("aoi_id",)} | {"site_share": "double"}
    # Blocks go by the id as its series has it.
    shares = shares.withColumn("site_id", F.col("site_id").cast(rain.schema["site_id"].dataType))
    block = F.pmod(F.xxhash64("site_id"), F.lit(blocks)).cast("int").alias("_block")
    series = rain.select(
        block, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"), F.lit(False).alias("_weights"), "site_id", "seconds", "intensity",
        *(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()),
    )
    weights = shares.select(
        block, F.pmod(F.xxhash64("aoi_id"), F.lit(buckets)).cast("int").alias("_bucket"), F.lit(True).alias("_weights"), "site_id",
        # Empty, not null: Arrow's writer goes over all nulls of a list column again with every row.
        *(F.array().cast(rain.schema[name].dataType).alias(name) for name in ("seconds", "intensity")), *kinds,
    )
    placed = series.unionByName(weights).repartition(max(tasks, blocks * buckets), "_block", "_bucket").sortWithinPartitions("_block", "_bucket", "_weights", "aoi_id")
    step = rain.schema["seconds"].dataType.elementType
    fields = [StructField("aoi_id", kinds["aoi_id"]), StructField("seconds", step), StructField("intensity", DoubleType())]
    sums = placed.mapInArrow(weighted.summed("aoi_id", "site_id", "seconds", "intensity", "site_share"), StructType(fields))
    return sums.groupBy("aoi_id", "seconds").agg(F.sum("intensity").alias("intensity"))


def rain_cube(cells: DataFrame, hyetographs: DataFrame, site_of_cell: DataFrame) -> DataFrame:
    """Intensity per cell and time step: ``raster_id, cx, cy, seconds, intensity``.

    ``site_of_cell(raster_id, cx, cy, site_id)`` is the nearest site (the Thiessen polygon holding the cell).
    """
    located = cells.select("raster_id", "cx", "cy").distinct().join(site_of_cell, ["raster_id", "cx", "cy"])
    # By shuffle: the rows of the series are many times what the duration tables' files say.
    return located.join(hyetographs.select("site_id", "seconds", "intensity").hint("merge"), "site_id").select(
        "raster_id", "cx", "cy", "seconds", "intensity"
    )
