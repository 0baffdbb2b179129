"""Depth grids per shot: robust statistics, normalisation, temporal smoothing, change."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import pixels as PX
from ..functions.grid import COARSE_RADIUS, COARSE_SCALE, CUES, FINE_RADIUS, FINE_SCALE, GROUND_POWER, HORIZON, OUTPUT_RADIUS
from .ordered import block_of, carry_in, exact_quantiles, join_small, with_previous

SHOT = ["video_id", "shot_id"]
PLANE_BLOCK = 32  # planes that a block holds


def _values(planes: DataFrame, keys: Sequence[str], z: str) -> DataFrame:
    return planes.select(*keys, F.explode_outer(z).alias("v")).where(G.finite(F.col("v")))


def norm_stats(planes: DataFrame, keys: Sequence[str] = SHOT, z: str = "z",
               lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """Per shot over finite cells: median, lower and upper quantile, range, invalid share, reliability.

    A shot without any finite cell has null statistics and ``valid`` false.
    """
    ok = F.filter(z, G.finite)
    base = planes.groupBy(*keys).agg(
        F.sum(F.size(z)).alias("_n"), F.sum(F.size(ok)).alias("_ok"),
        F.min(F.array_min(ok)).cast("double").alias("raw_min"), F.max(F.array_max(ok)).cast("double").alias("raw_max"))
    qs = exact_quantiles(_values(planes, keys, z), keys, "v",
                         {"median": 0.5, "clip_lower": lower, "clip_upper": upper})
    bad = 1 - F.col("_ok") / F.col("_n")
    flat = F.col("clip_upper") - F.col("clip_lower") <= F.greatest(F.abs("clip_upper"), F.lit(1.0)) * 1e-7
    return (base.join(qs, list(keys), "left")
            .withColumn("invalid_fraction", bad).withColumn("flat", flat)
            .withColumn("reliability", F.when(flat, 0.0).otherwise(G.clamp(1 - F.col("invalid_fraction") * 2, 0, 1)))
            .withColumn("valid", F.col("_ok") > 0).drop("_n", "_ok"))


def normalize(planes: DataFrame, stats: DataFrame, keys: Sequence[str] = SHOT, z: str = "z") -> DataFrame:
    """Scale each shot once by its own quantiles; invalid cells take the median, flat shots 0.5.

    A shot without any finite cell has nothing to scale by: its planes stay, as nulls, and its
    statistics say why (``valid`` false).
    """
    s = stats.where("valid").select(*keys, F.struct("median", "clip_lower", "clip_upper", "flat").alias("_s"))
    lo, span = F.col("_s.clip_lower"), F.col("_s.clip_upper") - F.col("_s.clip_lower")
    scaled = F.transform(z, lambda v: F.when(F.col("_s.flat"), 0.5).otherwise(G.clamp(
        (F.when(G.finite(v), v.cast("double")).otherwise(F.col("_s.median")) - lo) / span, 0, 1)))
    joined = join_small(planes, s, keys, F.col("frame_index"), "left")
    return joined.withColumn(z, F.when(F.col("_s").isNotNull(), scaled)).drop("_s")


RESIZES = {"nearest": PX.resize_nearest, "area": PX.resize_area, "bilinear": PX.resize_bilinear}


def resize(planes: DataFrame, h: int, w: int, how: str = "bilinear", z: str = "z") -> DataFrame:
    """Planes of ``h`` by ``w`` cells: nearest cell, mean of the covered cells, or end-aligned bilinear."""
    sized = RESIZES[how]
    made = PX.pixel_step(planes, [z, "h", "w"], f"{z} array<double>", lambda f: {z: sized(np.asarray(f[z], np.float64), f["h"], f["w"], h, w)})
    return made.withColumns({"h": F.lit(h), "w": F.lit(w)}).select(*planes.columns)


def smooth_space(planes: DataFrame, amount: float = 0.15, z: str = "z") -> DataFrame:
    """Each cell blended with its similar neighbours; null planes stay null."""
    if amount <= 0:
        return planes
    smoothed, sigma = PX.edge_aware, G.SIGMA
    work = lambda f: {z: smoothed(f[z], f["h"], f["w"], amount, sigma)}
    return PX.narrowed(PX.pixel_step(planes, [z, "h", "w"], f"{z} array<double>", work), planes.columns)


def smooth_time(planes: DataFrame, keep: float = 0.82, keys: Sequence[str] = SHOT, order: str = "frame_index",
                z: str = "z", tile: int = 64, block: int = 256, fan: int = 256) -> DataFrame:
    """y0 = x0, y_t = keep*y_(t-1) + (1-keep)*x_t per cell, clipped, from the first plane present in a shot.

    Planes are cut into tiles and runs of frames; a run acts on its entry tile as
    y -> a*y + b, or gives c where no plane came before it, and such maps compose, so one
    very long shot is many tasks.
    """
    if keep <= 0:
        return planes
    lost, planes = planes.where(F.col(z).isNull()), planes.where(F.col(z).isNotNull())
    rest = [c for c in planes.columns if c not in (*keys, order, z)]
    n = F.floor((F.size(z) + tile - 1) / tile).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.slice(z, t * tile + 1, F.lit(tile)))
    tiles = (planes.withColumn("_meta", F.struct(*rest)).select(*keys, order, "_meta", F.posexplode_outer(cut).alias("_tile", "_v"))
             .withColumn("_blk", block_of(order, block)))
    part = [*keys, "_tile"]
    runs = tiles.groupBy(*part, "_blk").agg(F.array_sort(F.collect_list(
        F.struct(F.col(order).alias("k"), F.transform("_v", lambda v: v.cast("double")).alias("v"), F.col("_meta").alias("m")))).alias("_run"))
    mix = lambda p, v: F.zip_with(p, v, lambda a, b: a * keep + b * (1 - keep))
    first = F.col("_run")[0]["v"]
    zeros = F.transform(first, lambda v: F.lit(0.0))

    def step(s, it):
        return F.struct((s["a"] * keep).alias("a"), mix(s["b"], it["v"]).alias("b"), mix(s["c"], it["v"]).alias("c"))

    on = lambda f, s: F.zip_with(f["b"], s, lambda b, y: b + f["a"] * y)
    after = lambda f, s: F.when(s.isNull(), f["c"]).otherwise(on(f, s))
    fns = runs.select(*part, "_blk", F.aggregate(
        F.slice("_run", 2, block), F.struct(F.lit(keep).alias("a"), F.transform(first, lambda v: v * (1 - keep)).alias("b"), first.alias("c")), step).alias("_f"))
    enter = carry_in(fns, part, "_f",
                     lambda f, g: F.struct((f["a"] * g["a"]).alias("a"), on(g, f["b"]).alias("b"), on(g, f["c"]).alias("c")),
                     after, F.lit(None).cast("array<double>"), "_y", fan)
    none = F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("k"), zeros.alias("v"), F.col("_run")[0]["m"].alias("m"))), 1, 0)

    def emit(s, it):
        y = F.when(s["y"].isNull(), it["v"]).otherwise(mix(s["y"], it["v"]))
        return G.let(y, lambda v: F.struct(v.alias("y"), F.concat(s["o"], F.array(
            F.struct(it["k"].cast("bigint").alias("k"), v.alias("v"), it["m"].alias("m")))).alias("o")))

    out = (runs.join(enter, [*part, "_blk"])
           .select(*part, F.explode_outer(F.aggregate("_run", F.struct(F.slice("_y", F.lit(1), F.size(F.col("_run")[0]["v"])).alias("y"), none.alias("o")),
                                                emit, lambda s: s["o"])).alias("_o"))
           .select(*part, F.col("_o.k").alias(order), F.col("_o.m").alias("_m"), F.col("_o.v").alias("_v")))
    whole = (out.groupBy(*keys, order)
             .agg(F.array_sort(F.collect_list(F.struct("_tile", "_v"))).alias("_t"), F.first("_m").alias("_m")))
    joined = F.flatten(F.transform("_t", lambda t: t["_v"]))
    smooth = whole.select(*keys, order, F.col("_m.*"), F.transform(joined, lambda v: G.clamp(v, 0, 1)).alias(z))
    return smooth.unionByName(lost.select(*smooth.columns))


def temporal_change(planes: DataFrame, keys: Sequence[str] = SHOT, z: str = "z") -> DataFrame:
    """Mean absolute change from the frame before in the shot; null for the first or another shape."""
    p = with_previous(planes, keys, "frame_index", ["h", "w", z], "_p", PLANE_BLOCK)
    same = (F.col("_p.h") == F.col("h")) & (F.col("_p.w") == F.col("w"))
    return p.withColumn("change", F.when(same, G.mean_abs_diff(F.col(z), F.col("_p")[z]))).drop("_p")


def depth_stats(planes: DataFrame, keys: Sequence[str] = SHOT, z: str = "z", near: float = 0.75) -> DataFrame:
    """Spread p90 - p10, share of near cells, mean frame-to-frame change; zeros when nothing is finite."""
    ok = F.filter(z, G.finite)
    counts = planes.groupBy(*keys).agg(
        F.sum(F.size(ok)).alias("_n"), F.sum(F.size(F.filter(z, lambda v: G.finite(v) & (v >= near)))).alias("_near"))
    qs = exact_quantiles(_values(planes, keys, z), keys, "v", {"_lo": 0.1, "_hi": 0.9})
    moved = temporal_change(planes, keys, z).groupBy(*keys).agg(F.avg("change").alias("temporal_change"))
    zero = F.lit(0.0)
    return (counts.join(qs, list(keys), "left").join(moved, list(keys), "left")
            .select(*keys, F.coalesce(G.clamp(F.col("_hi") - F.col("_lo"), 0, 1), zero).alias("depth_spread"),
                    F.when(F.col("_n") > 0, F.col("_near") / F.col("_n")).otherwise(zero).alias("foreground_ratio"),
                    F.coalesce("temporal_change", zero).alias("temporal_change")))


def edge_bands(planes: DataFrame, fraction: float = 0.05, near: float = 0.75, z: str = "z") -> DataFrame:
    """Cells of the left and right margins as one population: per frame, how many and how many near."""
    w = F.col("w")
    inside = lambda v, i: G.in_margin(F.pmod(i, w), w, fraction)
    return planes.select("video_id", "shot_id", "frame_index",
                         F.size(F.filter(z, inside)).alias("band_cells"),
                         F.size(F.filter(z, lambda v, i: inside(v, i) & (v >= near))).alias("near_cells"))


def edge_near_shots(planes: DataFrame, keys: Sequence[str] = SHOT, limit: float = 0.02,
                    fraction: float = 0.05, near: float = 0.75) -> DataFrame:
    b = edge_bands(planes, fraction, near).groupBy(*keys).agg(
        F.sum("near_cells").alias("n"), F.sum("band_cells").alias("d"))
    return b.select(*keys, (F.col("n") / F.col("d")).alias("near_share"), (F.col("n") / F.col("d") >= limit).alias("edge_near"))


def _cue_plane(f: dict) -> dict:
    h, w = f["h"], f["w"]
    b, g, r = (np.asarray(f[c], np.float64).reshape(h, w) for c in "bgr")
    luma = (b * 0.114 + g * 0.587 + r * 0.299) / 255.0
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    strong = (high - low) / 255.0 / np.maximum(high / 255.0, 1e-4)

    def contrast(radius: int) -> np.ndarray:
        mean = PX.box_mean(luma, radius)
        return np.sqrt(np.maximum(0.0, PX.box_mean(luma * luma, radius) - mean * mean))

    detail = (np.log1p(contrast(FINE_RADIUS) * FINE_SCALE) * 0.68 + np.log1p(contrast(COARSE_RADIUS) * COARSE_SCALE) * 0.32) / np.log1p(FINE_SCALE)
    y01 = PX.even_positions(h, h) / max(h - 1, 1)
    ground = np.power(np.clip((y01 - HORIZON) / (1 - HORIZON), 0, 1), GROUND_POWER)[:, None]
    mixed = (PX.box_mean(detail, COARSE_RADIUS) * CUES["detail"] + ground * CUES["ground"]
             + PX.box_mean(strong, COARSE_RADIUS) * CUES["saturation"])
    return {"z": PX.box_mean(mixed, OUTPUT_RADIUS).ravel()}


def image_cue_depth(frames: DataFrame) -> DataFrame:
    """Relative depth of each frame from detail, ground plane and saturation; higher is nearer.

    One step in numpy: a blur after a blur by column functions was a Python worker each.
    """
    return PX.pixel_step(frames, ["b", "g", "r", "h", "w"], "z array<double>", _cue_plane)


def local_contrast(frames: DataFrame, z: str, radius: int, out: str) -> DataFrame:
    """Adds the local standard deviation of a plane column."""
    f = frames.withColumn("_sq", F.transform(z, lambda v: v * v))
    f = G.box_blur(f, radius, _m=z, _m2="_sq")
    return f.withColumn(out, G.contrast("_m", "_m2")).drop("_sq", "_m", "_m2")


def synthetic_depth(shots: DataFrame, h: int, w: int, pattern: str = "moving-ramp") -> DataFrame:
    """Deterministic test planes for every frame of every shot."""
    f = shots.select("video_id", "shot_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("end_frame") - F.col("start_frame"))).alias("frame_index"))
    X = lambda x: x / float(max(w - 1, 1))
    Y = lambda y: y / float(max(h - 1, 1))
    i, s = F.col("frame_index"), F.col("shot_id")
    if pattern == "flat":
        cell = lambda k, y, x: F.lit(0.5)
    elif pattern == "radial":
        cx = F.sin((i + s) * 0.15) * 0.15 + 0.5
        cell = lambda k, y, x: G.clamp(1.0 - F.sqrt(F.pow(X(x) - cx, 2.0) + F.pow(Y(y) - 0.5, 2.0)) * 1.6, 0, 1)
    else:
        off = F.sin((i + s * 7) * 0.12) * 0.05
        cell = lambda k, y, x: G.clamp((1.0 - Y(y)) * 0.65 + X(x) * 0.35 + off, 0, 1)
    return f.withColumns({"h": F.lit(h), "w": F.lit(w)}).withColumn("z", G.per_cell(F.lit(h), F.lit(w), cell))


def estimate_depth(raw: DataFrame, keep: float = 0.82, amount: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Normalised, spatially and temporally smoothed planes, and the per-shot statistics.

    Planes of shots that can't be normalised are in the result with a null ``z``.
    """
    stats = norm_stats(raw)
    return smooth_time(smooth_space(normalize(raw, stats), amount), keep), stats
