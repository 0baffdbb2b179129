"""Per-frame grid arithmetic as column expressions over row-major arrays.

A frame is one row, its grid one array, so none of these shuffle, sort or
explode.  ``let`` binds an array once; without it the optimiser may inline the
expression that produced the array into every element of a lambda.  For the same
reason computed arrays are unfolded with ``explode_outer``: plain ``explode``
makes the optimiser add a size filter that repeats the whole expression.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .pixels import box_mean

SIGMA = 0.08  # fixed value: edge weight scale of the smoother


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(a, lambda x: let(b, lambda y: body(x, y)))


def at(z: Column, i: Column) -> Column:
    return F.get(z, i.cast("int"))


def cells(h: Column, w: Column) -> Column:
    return F.sequence(F.lit(0), (h * w - 1).cast("int"))


def per_cell(h: Column, w: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """Array over a grid of body(index, y, x)."""
    return F.transform(cells(h, w), lambda i: body(i, F.floor(i / w), F.pmod(i, w)))


def total(z: Column) -> Column:
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + v)


def mean(z: Column) -> Column:
    return total(z) / F.size(z)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def clamp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(hi, F.greatest(lo, v))


def even_step(i: Column, n: Column, m: Column) -> Column:
    """i-th of m evenly spaced positions over 0..n-1, exact at the end."""
    return F.when((i == m - 1) & (m > 1), (n - 1).cast("double")).otherwise(
        i.cast("double") * ((n - 1).cast("double") / F.greatest(m - 1, F.lit(1))))


def luma(b: Column, g: Column, r: Column, h: Column, w: Column, max_width: int = 160) -> Column:
    """Luma in [0,1]; every step-th row and column when wider than ``max_width``."""
    step = F.greatest(F.lit(1), F.ceil(w / F.lit(max_width)).cast("int"))
    picks = F.flatten(F.transform(F.sequence(F.lit(0), h - 1, step), lambda y: F.transform(
        F.sequence(F.lit(0), w - 1, step), lambda x: y * w + x)))
    return let2(b, g, lambda bb, gg: let(r, lambda rr: F.transform(picks, lambda i: (
        at(bb, i) * 0.114 + at(gg, i) * 0.587 + at(rr, i) * 0.299) / 255.0)))


def once(c: Column) -> Column:
    """The same value, but never copied into the expressions that use it.

    The guard is always true; being non-deterministic to the optimiser, it keeps a
    costly array from being inlined into lambdas or into a Python function's arguments.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


@F.pandas_udf(ArrayType(DoubleType()))
def _blur_udf(z: pd.Series, h: pd.Series, w: pd.Series, radius: pd.Series) -> pd.Series:
    return pd.Series([box_mean(np.asarray(plane, dtype=np.float64).reshape(rows, cols), r).ravel() for plane, rows, cols, r in zip(z, h, w, radius)])


def box_blur(frames: DataFrame, radius: int, **planes: str) -> DataFrame:
    """Adds ``out=plane`` columns: the (2r+1)^2 mean with repeated edges.

    Running sums over Arrow batches: the window size does not change the cost, while a
    lambda per cell and tap measured about a hundred times slower.
    """
    names = set(planes.values())
    f = frames.withColumns({n: once(F.col(n)) for n in names})
    return f.withColumns({out: _blur_udf(F.col(n), F.col("h"), F.col("w"), F.lit(radius)) if radius > 0 else F.col(n)
                          for out, n in planes.items()})


def contrast(mean: str, mean_of_squares: str) -> Column:
    """Local standard deviation from a blurred plane and its blurred squares."""
    return F.zip_with(mean, mean_of_squares, lambda x, y: F.sqrt(F.greatest(F.lit(0.0), y - x * x)))


# Fixed values of the image-cue depth estimate.
CUES = {"detail": 0.58, "ground": 0.27, "saturation": 0.15}
FINE_RADIUS, COARSE_RADIUS, OUTPUT_RADIUS = 2, 6, 3
FINE_SCALE, COARSE_SCALE = 900.0, 260.0
HORIZON, GROUND_POWER = 0.32, 1.35


def ground_prior(y: Column, h: Column) -> Column:
    """Rows below the horizon read nearer."""
    y01 = F.when(h > 1, even_step(y, h, h) / F.greatest(h - 1, F.lit(1))).otherwise(F.lit(0.0))
    return F.pow(clamp((y01 - HORIZON) / (1 - HORIZON), 0, 1), GROUND_POWER)


def saturation(b: Column, g: Column, r: Column) -> Column:
    pair = F.zip_with(b, g, lambda p, q: F.struct(F.greatest(p, q).alias("hi"), F.least(p, q).alias("lo")))
    return F.zip_with(pair, r, lambda s, q: (F.greatest(s["hi"], q) - F.least(s["lo"], q)) / 255.0
                      / F.greatest(F.greatest(s["hi"], q) / 255.0, F.lit(1e-4)))


def cue_detail(fine: Column, coarse: Column) -> Column:
    return F.zip_with(fine, coarse, lambda f, c: (
        F.log1p(f * FINE_SCALE) * 0.68 + F.log1p(c * COARSE_SCALE) * 0.32) / F.log1p(F.lit(FINE_SCALE)))


def cue_mix(detail: Column, sat: Column, h: Column, w: Column) -> Column:
    return let2(detail, sat, lambda d, s: per_cell(h, w, lambda i, y, x: (
        at(d, i) * CUES["detail"] + ground_prior(y, h) * CUES["ground"] + at(s, i) * CUES["saturation"])))


def margin(w: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.bround(w * min(max(fraction, 0.0), 0.25), 0).cast("int"))


def in_margin(x: Column, w: Column, fraction: float) -> Column:
    m = margin(w, fraction)
    return (x < m) | (x >= w - m)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
