"""Two-view rendering: what is a column expression; the pixel work is in ``pixels``."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grid as G
from .pixels import GAMMA, LEAKAGE, LEFT_MATRIX, LUMINANCE, MAX_FILL, RIGHT_MATRIX, SATURATION  # noqa: F401  all of one picture's constants in one place

DISPLAY_ASPECT = 16.0 / 9.0  # fixed value


def reference_width(w: Column, h: Column, aspect: float = DISPLAY_ASPECT) -> Column:
    return F.greatest(w.cast("double"), h.cast("double") * aspect)


def eased(prev: dict[str, Column], target: dict[str, Column], frame_in_shot: Column, names: list[str]) -> dict[str, Column]:
    """Parameters on their way from the last shot's to this one's over the first frames of a fade."""
    n, s = target["transition_frames"], target["temporal_smoothing"]
    step = F.greatest(F.lit(1), frame_in_shot + 1)
    curve = F.when(s >= 1.0 - 1e-7, step / n).otherwise(
        (1.0 - F.pow(s, step.cast("double"))) / F.greatest(1.0 - F.pow(s, n.cast("double")), F.lit(1e-9)))
    blend = G.clamp(curve, 0, 1)
    done = (n <= 0) | (frame_in_shot >= n)
    return {k: F.when(done, target[k]).otherwise(prev[k] + (target[k] - prev[k]) * blend) for k in names}
