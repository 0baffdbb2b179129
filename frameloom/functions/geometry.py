"""Frame sizes and budgets as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAX_WIDTH, MAX_FEATURE_WIDTH, MIN_FEATURE_EDGE = 8192, 640, 16
BYTES_PER_CELL, WORKING_SET = 18, 3 * 1024 ** 3


def _half_even(c: Column) -> Column:
    return F.rint(c).cast("bigint")


def normalized_size(w: Column, h: Column, rotation: Column, target: int = 720) -> tuple[Column, Column]:
    """(width, error): display width at the target height, rounded up to even."""
    turned = rotation.isin(90, 270)
    dw, dh = F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)
    out = F.floor((dw * target + dh - 1) / dh).cast("bigint")
    out = out + out % 2
    return out, F.when(out > MAX_WIDTH, "too_wide")


def feature_size(w: Column, h: Column, downscale: int = 320, widest: int = MAX_FEATURE_WIDTH,
                 smallest: int = MIN_FEATURE_EDGE) -> tuple[Column, Column]:
    """Size bounded by area, so portrait and landscape cost the same."""
    tw = F.greatest(F.lit(1), F.least(F.lit(downscale), w, F.lit(widest)))
    budget = tw * F.greatest(F.lit(1), _half_even(tw * 9 / 16))
    scale = F.least(F.lit(1.0), F.sqrt(budget.cast("double") / (w * h).cast("double")))
    return (F.greatest(F.lit(smallest), _half_even(w * scale)), F.greatest(F.lit(smallest), _half_even(h * scale)))


def preview_size(w: Column, h: Column, widest: int) -> tuple[Column, Column]:
    if widest <= 0:
        return w, h
    sh = F.greatest(F.lit(2), _half_even((h * widest).cast("double") / w))
    fits = w <= widest
    return (F.when(fits, w).otherwise(F.lit(widest - widest % 2)), F.when(fits, h).otherwise(sh - sh % 2))


def frame_bytes(w: Column, h: Column) -> Column:
    return w * h * 3


def max_frames(w: Column, h: Column, budget: int = WORKING_SET, per_cell: int = BYTES_PER_CELL) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(budget) / (w * h * per_cell)))


def frame_geometry(media: DataFrame, target: int = 720, downscale: int = 320, preview: int = 640) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    nw, err = normalized_size(w, h, F.col("rotation"), target)
    fw, fh = feature_size(w, h, downscale)
    pw, ph = preview_size(w, h, preview)
    return media.withColumns({
        "normalized_width": nw, "size_error": err, "feature_width": fw, "feature_height": fh, "preview_width": pw,
        "preview_height": ph, "reference_width": F.greatest(w.cast("double"), h.cast("double") * (16.0 / 9.0)),
        "frame_bytes": frame_bytes(w, h), "max_frames": max_frames(w, h)})
