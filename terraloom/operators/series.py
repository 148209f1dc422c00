"""Resampling of breakpoint series onto a fixed step."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Workers unpickle the spline helper without importing this package, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Interpolation names.
METHODS = ("linear", "nearest", "nearest-up", "zero", "slinear", "quadratic", "cubic", "previous", "next")
SPLINE_DEGREE = {"quadratic": 2, "cubic": 3}


def resample(df: DataFrame, keys: Sequence[str], x: str, y: str, step: int, method: str = "linear", from_zero: bool = False) -> DataFrame:
    """``keys, x, y`` at every multiple of ``step`` between the first and last breakpoint of each series.

    Each pair of neighbouring breakpoints lists the steps it covers, so no join is needed; only the two
    spline methods need a whole (short) series at once. ``from_zero`` puts a breakpoint (0, 0) before each
    series, whose own breakpoints must be above 0.
    """
    if method not in METHODS:
        raise ValueError(f"unknown interpolation method {method!r}")
    if step <= 0:
        raise ValueError("the step must be positive")
    keys = list(keys)
    if method in SPLINE_DEGREE:
        return _spline(df.select(*keys, x, y), keys, x, y, step, SPLINE_DEGREE[method], from_zero)
    order = Window.partitionBy(*keys).orderBy(x)
    brackets = df.select(
        *keys,
        F.col(x).cast("long").alias("_x0"),
        F.col(y).cast("double").alias("_y0"),
        F.lead(F.col(x).cast("long")).over(order).alias("_x1"),
        F.lead(F.col(y).cast("double")).over(order).alias("_y1"),
    )
    if from_zero:
        # The first breakpoint also closes the bracket that opens at (0, 0).
        opening = F.struct(F.lit(0).cast("long").alias("_x0"), F.lit(0.0).alias("_y0"), F.col("_x0").alias("_x1"), F.col("_y0").alias("_y1"))
        own = F.struct("_x0", "_y0", "_x1", "_y1")
        is_first = F.lag(F.lit(1)).over(order).isNull()
        listed = df.select(
            *keys,
            F.col(x).cast("long").alias("_x0"),
            F.col(y).cast("double").alias("_y0"),
            F.lead(F.col(x).cast("long")).over(order).alias("_x1"),
            F.lead(F.col(y).cast("double")).over(order).alias("_y1"),
            is_first.alias("_is_first"),
        )
        brackets = listed.select(*keys, F.explode(F.when(F.col("_is_first"), F.array(opening, own)).otherwise(F.array(own))).alias("_b")).select(*keys, "_b.*")
    first = F.ceil(F.col("_x0") / step) * step
    # A bracket owns its left end; the last breakpoint is a bracket of its own.
    last = F.coalesce(F.floor((F.col("_x1") - 1) / step) * step, F.col("_x0"))
    steps = brackets.filter(first <= last).withColumn("_x", F.explode(F.sequence(first, last, F.lit(step).cast("long"))))
    return steps.select(*keys, F.col("_x").alias(x), _between(method).alias(y))


def _between(method: str) -> Column:
    x, x0, x1, y0, y1 = (F.col(c) for c in ("_x", "_x0", "_x1", "_y0", "_y1"))
    linear = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    by_method = {
        "linear": linear,
        "slinear": linear,
        "previous": y0,
        "zero": y0,
        "next": y1,
        "nearest": F.when((x - x0) * 2 <= x1 - x0, y0).otherwise(y1),
        "nearest-up": F.when((x - x0) * 2 < x1 - x0, y0).otherwise(y1),
    }
    return F.when(x1.isNull() | (x == x0), y0).otherwise(by_method[method])


def spline_weights(x: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Weights of the breakpoints' values at each point of an interpolating B-spline with not-a-knot ends (de Boor 1978)."""
    half = (degree + 1) // 2 if degree % 2 else degree // 2
    inner = x if degree % 2 else (x[1:] + x[:-1]) / 2.0
    knots = np.r_[[x[0]] * (degree + 1), inner[half:-half], [x[-1]] * (degree + 1)]

    def basis(points: np.ndarray) -> np.ndarray:
        low, high = knots[:-1], knots[1:]
        inside = (points[:, None] >= low) & (points[:, None] < high)
        inside[points == x[-1], np.flatnonzero(low < high)[-1]] = True
        values = inside.astype(float)
        for k in range(1, degree + 1):
            n = len(knots) - 1 - k
            left, right = knots[k : k + n] - knots[:n], knots[k + 1 : k + 1 + n] - knots[1 : 1 + n]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(left > 0, (points[:, None] - knots[:n]) / left, 0.0)
                down = np.where(right > 0, (knots[k + 1 : k + 1 + n] - points[:, None]) / right, 0.0)
            values = up * values[:, :n] + down * values[:, 1 : n + 1]
        return values

    return np.linalg.solve(basis(x).T, basis(at).T).T


def _spline(df: DataFrame, keys: list[str], x: str, y: str, step: int, degree: int, from_zero: bool) -> DataFrame:
    """A spline is linear in the values, so each distinct list of breakpoints is solved once for its weights."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    if from_zero:
        pairs = F.concat(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), pairs)
    series = df.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.col("_p.x").alias("_xs"), F.col("_p.y").alias("_ys"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs in batch.column(0).to_pylist():
                if len(xs) <= degree:
                    raise ValueError(f"a degree {degree} spline needs more than {degree} breakpoints")
                at = np.arange(np.ceil(xs[0] / step), np.floor(xs[-1] / step) + 1) * step
                weights = spline_weights(np.array(xs), at, degree)
                columns = [pa.array([xs] * len(at), pa.list_(pa.float64())), pa.array(at.astype("int64")), pa.array(list(weights), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_xs", "_at", "_w"])

    weights = series.select("_xs").distinct().mapInArrow(weigh, "_xs array<double>, _at bigint, _w array<double>")
    value = F.aggregate(F.zip_with("_ys", "_w", lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    return series.join(weights, "_xs").select(*keys, F.col("_at").alias(x), value.alias(y))
