"""Per-shot features from colour frames: motion, brightness, camera movement."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import pixels as PX
from .depth import SHOT, depth_stats
from .ordered import exact_quantiles, with_previous
from .segment import even_positions

C = F.col
FULL_MOTION = 0.18  # fixed value: mean luma change that counts as full motion


def luma_pairs(frames: DataFrame, max_width: int = 160, keys: Sequence[str] = SHOT, also: Sequence[str] = ()) -> DataFrame:
    """Each frame's luma with the frame before it in the shot (frames of a shot count from 0).

    Sampled frames carry their real number in ``frame_no``.
    """
    no = C("frame_no") if "frame_no" in frames.columns else C("frame_index")
    h, w = C("h"), C("w")
    step = F.greatest(F.lit(1), F.ceil(w / F.lit(max_width)).cast("int"))
    f = frames.select(*keys, "frame_index", no.alias("no"), *also, F.ceil(h / step).cast("int").alias("lh"), F.ceil(w / step).cast("int").alias("lw"),
                      G.luma(C("b"), C("g"), C("r"), h, w, max_width).alias("luma"))
    return with_previous(f, keys, "frame_index", ["no", "luma"], "prev", 64)


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Mean absolute luma change of frames whose predecessor index is consecutive."""
    near = C("prev.no") == C("no") - 1
    return pairs.withColumn("score", F.when(near, G.mean_abs_diff(C("luma"), C("prev.luma"))))


def motion_score(frames: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    scored = pair_scores(luma_pairs(frames, keys=keys)).where("score is not null").select(*keys, "score")
    p75 = exact_quantiles(scored, keys, "score", {"_p": 0.75})
    return (frames.select(*keys).distinct().join(p75, list(keys), "left")
            .select(*keys, F.coalesce(G.clamp(C("_p") / FULL_MOTION, 0, 1), F.lit(0.0)).alias("motion_score")))


def brightness(frames: DataFrame, samples: int = 12, keys: Sequence[str] = SHOT) -> DataFrame:
    """Mean of the frame means over up to ``samples`` evenly spaced frames, over 255."""
    plan = (frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .select(*keys, F.explode(even_positions(C("_n"), samples)).alias("frame_index")))
    m = (G.total(C("b")) + G.total(C("g")) + G.total(C("r"))) / (F.size("b") * 3)
    return (frames.select(*keys, "frame_index", m.alias("_m")).join(plan, [*keys, "frame_index"])
            .groupBy(*keys).agg((F.avg("_m") / 255.0).alias("brightness")))


def sampled_translations(frames: DataFrame, samples: int = 8, radius: int = 3, keys: Sequence[str] = SHOT) -> DataFrame:
    """Best (dx, dy) of up to ``samples`` evenly spaced adjacent pairs per shot."""
    h, w = C("h"), C("w")
    step = F.greatest(F.lit(1), F.ceil(w / F.lit(96)).cast("int"))
    if "frame_no" in frames.columns:
        # Sampled shots hold a bounded handful of frames: rank their consecutive pairs.
        per = Window.partitionBy(*keys).orderBy("frame_index")
        nxt_no = F.lead("frame_no").over(per)
        real = frames.select(*keys, "frame_index", (nxt_no == C("frame_no") + 1).alias("_ok")).where("_ok")
        real = real.withColumns({"_i": F.row_number().over(per) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
        plan = real.where(F.array_contains(even_positions(C("_n"), samples), C("_i").cast("bigint"))).select(*keys, C("frame_index").alias("_i"))
    else:
        plan = (frames.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_n")).where("_n > 0")
                .select(*keys, F.explode(even_positions(C("_n"), samples)).alias("_i")))
    wanted = plan.select(*keys, F.explode(F.array(C("_i"), C("_i") + 1)).alias("frame_index")).distinct()
    # Planned frames and their partners only: everything after this join is a few frames per shot.
    few = frames.join(wanted, [*keys, "frame_index"])
    f = few.select(*keys, "frame_index", F.ceil(h / step).cast("int").alias("lh"), F.ceil(w / step).cast("int").alias("lw"),
                   G.luma(C("b"), C("g"), C("r"), h, w, 96).alias("luma"))
    nxt = f.select(*keys, (C("frame_index") - 1).alias("frame_index"), C("luma").alias("next"))
    pairs = f.join(nxt, [*keys, "frame_index"]).join(plan.withColumnRenamed("_i", "frame_index"), [*keys, "frame_index"])
    match = PX.block_match
    moved = PX.pixel_step(pairs.select(*keys, "frame_index", "luma", "next", "lh", "lw"), ["luma", "next", "lh", "lw"], "dx bigint, dy bigint",
                          lambda f: dict(zip(("dx", "dy"), match(f["luma"], f["next"], f["lh"], f["lw"], radius), strict=True)))
    return moved.select(*keys, "frame_index", C("dx").cast("int").alias("dx"), C("dy").cast("int").alias("dy"))


def camera_movement(translations: DataFrame, motion: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """static, lateral, vertical or unstable per shot."""
    # At most eight translations per shot, so the list is bounded.
    t = translations.groupBy(*keys).agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"),
                                        F.collect_list(F.struct("dx", "dy")).alias("_l"))
    dev = G.mean(F.transform("_l", lambda s: F.sqrt(F.pow(s["dx"] - C("mx"), 2.0) + F.pow(s["dy"] - C("my"), 2.0))))
    t = t.select(*keys, "mx", "my", F.round(dev, 9).alias("deviation"), F.round(F.sqrt(C("mx") * C("mx") + C("my") * C("my")), 9).alias("magnitude"))
    ax, ay = F.abs("mx"), F.abs("my")
    kind = (F.when((C("motion_score") < 0.08) | C("mx").isNull(), "static")
            .when((C("deviation") > F.greatest(F.lit(1.5), C("magnitude") * 1.2)) | (C("motion_score") > 0.82), "unstable")
            .when(C("magnitude") < 0.6, "unstable").when(ax > ay * 1.4, "lateral").when(ay > ax * 1.4, "vertical").otherwise("unstable"))
    return motion.join(t, list(keys), "left").withColumn("camera_movement", kind)


def shot_features(frames: DataFrame, planes: DataFrame, shots: DataFrame, speech: DataFrame, reliability: DataFrame,
                  keys: Sequence[str] = SHOT) -> DataFrame:
    """One row per shot with everything the direction rules read."""
    from ..functions.rules import cut_context
    motion = motion_score(frames, keys)
    out = shots.select(*keys, (C("end_time") - C("start_time")).alias("duration_seconds"))
    for part in (camera_movement(sampled_translations(frames, keys=keys), motion, keys).select(*keys, "motion_score", "camera_movement"),
                 depth_stats(planes, keys).drop("temporal_change"), brightness(frames, keys=keys),
                 speech.select(*keys, "speech_ratio"), reliability.select(*keys, C("reliability").alias("depth_reliability"))):
        out = out.join(part, list(keys), "left")
    return out.withColumn("cut_frequency_context", cut_context(C("duration_seconds")))
