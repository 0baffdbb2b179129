"""Frames to two views and one mixed picture, with masks for quality checks."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import pixels as P
from ..functions import stereo as T
from .ordered import interval_join, with_previous

C = F.col
EASED = ["depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm"]


def ease_parameters(frames: DataFrame, shots: DataFrame, script: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Per frame the parameters in force: eased at the start of a fade, the shot's own elsewhere.

    Frames of a shot that has no script keep their row, with null parameters.
    """
    names = [*EASED, "temporal_smoothing", "transition_frames", "edge_protection"]
    s = shots.select(*keys, "shot_id", "start_frame", "end_frame", "transition").join(
        script.select(*keys, "shot_id", F.struct(*names).alias("_t")), [*keys, "shot_id"], "left")
    s = with_previous(s, keys, "shot_id", ["_t"], "_p")
    f = interval_join(frames, s, keys, "frame_index", "start_frame", "end_frame")
    fading = (C("transition") == "fade") & C("_p._t").isNotNull() & C("_t").isNotNull()
    tgt = {n: C(f"_t.{n}") for n in names}
    mixed = T.eased({n: C(f"_p._t.{n}") for n in EASED}, tgt, C("frame_index") - C("start_frame"), EASED)
    cols = {n: (F.when(fading, mixed[n]).otherwise(tgt[n]) if n in mixed else tgt[n]) for n in names}
    return f.withColumns(cols).drop("_t", "_p")


PLANE, CELLS = "array<double>", "array<bigint>"
PARAMS = ["convergence_depth_percentile", "depth_strength", "max_popout_disparity_norm", "max_background_disparity_norm", "edge_protection"]


def _disparity(f: dict, fraction: float) -> dict:
    z = np.clip(np.nan_to_num(np.asarray(f["z"], np.float64), nan=1.0), 0, 1)
    conv = P.percentile(z, f["convergence_depth_percentile"])
    d = P.disparity(z, conv, f["w"], f["depth_strength"], f["max_popout_disparity_norm"], f["max_background_disparity_norm"], f["edge_protection"], fraction)
    return {"z": z, "conv": conv, "disparity": d, "shift": d * f["_ref"]}


def _splat(f: dict) -> dict:
    left, right = P.splat(f["z"], f["shift"], f["w"])
    return {"left_src": left, "right_src": right}


def _fill(f: dict, widest: int) -> dict:
    out = {}
    for side in ("left", "right"):
        painted, holes = P.fill(f[f"{side}_src"], f["w"], [f[c] for c in "bgr"], widest)
        out |= {f"{side}_{c}": v for c, v in zip("bgr", painted, strict=True)} | {f"{side}_hole": holes}
    return out


def _mix(f: dict, mode: str, swap: bool = False) -> dict:
    left, right = ({c: f[f"{side}_{c}"] for c in "bgr"} for side in (("right", "left") if swap else ("left", "right")))
    return {"mix": P.mix(left, right, mode)}


def _holes(f: dict) -> dict:
    return {"holes": (f["left_src"] < 0) | (f["right_src"] < 0) | f["left_hole"] | f["right_hole"]}


MAKES = {
    "disparity": f"z {PLANE}, conv double, disparity {PLANE}, shift {PLANE}",
    "splat": f"left_src {CELLS}, right_src {CELLS}",
    "fill": ", ".join([f"{s}_{c} {PLANE}" for s in ("left", "right") for c in "bgr"] + [f"{s}_hole array<boolean>" for s in ("left", "right")]),
    "holes": "holes array<boolean>",
    "mix": "mix array<struct<b:double,g:double,r:double>>",
}


def _with_ref(frames: DataFrame, ref_width: Column | None) -> DataFrame:
    return frames.withColumn("_ref", (T.reference_width(C("w"), C("h")) if ref_width is None else ref_width).cast("double"))


def with_disparity(frames: DataFrame, ref_width: Column | None = None, fraction: float = 0.05) -> DataFrame:
    """Adds conv (screen-plane depth), disparity (share of width) and shift (cells, full)."""
    return P.pixel_step(_with_ref(frames, ref_width), ["z", "w", "_ref", *PARAMS], MAKES["disparity"], lambda f: _disparity(f, fraction), drop=["_ref"])


def splat(frames: DataFrame) -> DataFrame:
    """Adds left_src and right_src: the source cell shown at each target cell, -1 for holes."""
    return P.pixel_step(frames, ["z", "shift", "w"], MAKES["splat"], _splat)


def fill_gaps(frames: DataFrame, widest: int = T.MAX_FILL) -> DataFrame:
    """Paints both views and adds left_hole and right_hole for cells that stay empty."""
    return P.pixel_step(frames, ["left_src", "right_src", "w", "b", "g", "r"], MAKES["fill"], lambda f: _fill(f, widest))


def edge_violation_mask(frames: DataFrame, fraction: float = 0.05, limit: float = 0.002) -> DataFrame:
    return frames.withColumn("edge_mask", F.transform(
        "disparity", lambda d, i: G.in_margin(F.pmod(i, C("w")), C("w"), fraction) & (d > limit)))


def hole_union(frames: DataFrame) -> DataFrame:
    """Cells not covered by the left or the right view, or left unfilled in either."""
    return P.pixel_step(frames, ["left_src", "right_src", "left_hole", "right_hole"], MAKES["holes"], _holes)


def mix_views(frames: DataFrame, mode: str = "calibrated", swap: bool = False) -> DataFrame:
    return P.pixel_step(frames, [f"{s}_{c}" for s in ("left", "right") for c in "bgr"], MAKES["mix"], lambda f: _mix(f, mode, swap))


def render_frames(frames: DataFrame, ref_width: Column | None = None, mode: str = "calibrated",
                  edge_limit: float = 0.002, fraction: float = 0.05, widest: int = T.MAX_FILL, plane: Sequence[str] = ()) -> DataFrame:
    """Frames with colours, depth and parameters in force, to views, masks and the mix: one narrow step.

    ``plane`` names the columns of the depth's own height and width, where it is to be resized first.
    """
    def work(f: dict) -> dict:
        if plane and (f[plane[0]], f[plane[1]]) != (f["h"], f["w"]):
            f = f | {"z": P.resize_bilinear(np.asarray(f["z"], np.float64), f[plane[0]], f[plane[1]], f["h"], f["w"])}
        out = _disparity(f, fraction)
        out |= _splat(f | out)
        out |= _fill(f | out, widest)
        out |= _mix(out, mode)
        x, m = np.arange(len(out["z"])) % f["w"], P.margin(f["w"], fraction)
        out["edge_mask"] = ((x < m) | (x >= f["w"] - m)) & (out["disparity"] > edge_limit)
        return out | _holes(out)

    makes = ", ".join([*[m for k, m in MAKES.items() if k != "holes"], "edge_mask array<boolean>", MAKES["holes"]])
    uses = ["z", "h", "w", "_ref", "b", "g", "r", *PARAMS, *plane]
    return P.pixel_step(_with_ref(frames, ref_width), uses, makes, work, drop=["_ref", *plane])


def select_output(frames: DataFrame, output: str) -> DataFrame:
    """One picture per frame as (y, x, b, g, r) rows: left, right, side-by-side or mixed."""
    key = ["video_id", "shot_id", "frame_index"]

    def cells(side, dx):
        packed = F.zip_with(F.zip_with(f"{side}_b", f"{side}_g", lambda b, g: F.struct(b.alias("b"), g.alias("g"))), f"{side}_r",
                            lambda q, r: F.struct(q["b"].alias("b"), q["g"].alias("g"), r.alias("r")))
        return F.transform(packed, lambda p, i: F.struct(
            F.floor(i / C("w")).alias("y"), (F.pmod(i, C("w")) + dx).cast("bigint").alias("x"), p["b"].alias("b"), p["g"].alias("g"), p["r"].alias("r")))

    if output in ("left", "right"):
        body = cells(output, F.lit(0))
    elif output == "side-by-side":
        body = F.concat(cells("left", F.lit(0)), cells("right", C("w")))
    elif output == "mix":
        body = F.transform("mix", lambda p, i: F.struct(
            F.floor(i / C("w")).alias("y"), F.pmod(i, C("w")).cast("bigint").alias("x"), p["b"].alias("b"), p["g"].alias("g"), p["r"].alias("r")))
    else:
        raise ValueError(f"unknown output {output}")
    return frames.select(*key, F.explode_outer(body).alias("_c")).select(*key, "_c.*")


def ordered_output(frames: DataFrame) -> DataFrame:
    """Frames in (video, shot, frame) order across and inside partitions, as many as the session's settings give."""
    return (frames.repartitionByRange("video_id", "shot_id", "frame_index")
            .sortWithinPartitions("video_id", "shot_id", "frame_index"))
