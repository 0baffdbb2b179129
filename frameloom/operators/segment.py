"""Cutting frame series into shots, and choosing frames inside shots."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import pixels as PX
from ..sources.artifacts import materialize
from .ordered import (BLOCK, block_of, blocked, carry_in, emit_states, interval_join, join_small,
                      running_sum, with_next, with_previous)

VIDEO = ["video_id"]
PLANE_BLOCK = 64  # gray planes that a block holds


def gray_planes(frames: DataFrame, width: int = 320) -> DataFrame:
    """``gray``: each frame's gray levels, area-resized to ``width`` at most, from its b, g, r planes."""
    def work(f):
        h2, w2 = PX.small_size(f["h"], f["w"], width)
        return {"gray": PX.resize_area(PX.gray(f["b"], f["g"], f["r"]), f["h"], f["w"], h2, w2)}
    return PX.pixel_step(frames, ["b", "g", "r", "h", "w"], "gray array<double>", work)


def _scored_blocks(frames: DataFrame, keys: Sequence[str], value: str, block: int, tag: Column) -> DataFrame:
    """keys, ``_blk`` and ``_s``: frame number c, score and tag of a block's frames in order.

    The score is the absolute change from the frame before: of a number, or the mean one of a plane's
    cells.  Only the last frame of a block goes to the next block.
    """
    stored = blocked(frames.select(*keys, "frame_index", F.col(value).alias("v"), tag.alias("t")), keys, "frame_index", block)
    over = Window.partitionBy(*keys).orderBy("_blk")
    halo = stored.select(*keys, "_blk", F.col("_last.v").alias("_e")).select(*keys, "_blk", F.lag("_e").over(over).alias("_halo"))
    rows = stored.select(*keys, "_blk", "_rows").join(halo, [*keys, "_blk"])
    if not isinstance(frames.schema[value].dataType, ArrayType):
        before = rows.withColumn("_before", F.concat(F.array("_halo"), F.transform("_rows", lambda r: r["v"])))
        return before.select(*keys, "_blk", F.transform("_rows", lambda r, i: F.struct(
            r["frame_index"].alias("c"), F.abs(r["v"] - F.get(F.col("_before"), i)).alias("score"), r["t"].alias("t"))).alias("_s"))

    def run(batches):
        for t in batches:
            scores = []
            for k in range(t.num_rows):
                planes = t["_rows"][k].values.field("v")
                own = [t["_halo"][k], *planes]
                scores.append(PX.changes([x.values.to_numpy(zero_copy_only=False).astype(np.float64) if x.is_valid else None for x in own]))
            rest = [t["_rows"][k].values for k in range(t.num_rows)]
            offsets = np.cumsum([0, *map(len, rest)]).astype(np.int32)
            told = pa.StructArray.from_arrays([pa.concat_arrays([x.field("frame_index") for x in rest]), pa.array([v for x in scores for v in x], pa.float64()),
                                               pa.concat_arrays([x.field("t") for x in rest])], ["c", "score", "t"]) if rest else None
            if told is not None:
                yield pa.RecordBatch.from_arrays([*(t[c] for c in keys), t["_blk"], pa.ListArray.from_arrays(offsets, told)], [*keys, "_blk", "_s"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "_blk"])
    return rows.mapInArrow(run, f"{made}, _s array<struct<c: bigint, score: double, t: boolean>>")


def frame_diff(frames: DataFrame, keys: Sequence[str] = VIDEO, value: str = "value",
               block: int = BLOCK) -> DataFrame:
    """Absolute change from the frame before (null for the first): ``score`` beside the frame's columns.

    ``value`` is a number, or a gray plane, of which the mean change of cells counts (null where the size changes).
    """
    if not isinstance(frames.schema[value].dataType, ArrayType):
        return (with_previous(frames, keys, "frame_index", [value], "_p", block)
                .withColumn("score", F.abs(F.col(value) - F.col("_p")[value])).drop("_p"))
    scored = _scored_blocks(frames, keys, value, min(block, PLANE_BLOCK), F.lit(None).cast("boolean"))
    return scored.select(*keys, F.explode("_s").alias("_e")).select(*keys, F.col("_e.c").alias("frame_index"), F.col("_e.score").alias("score"))


def shot_boundaries(scored: DataFrame, threshold: float, min_gap: int,
                    keys: Sequence[str] = VIDEO, block: int = BLOCK, fan: int = 512,
                    tag: Column | None = None) -> DataFrame:
    """Greedy boundaries: score reaches ``threshold`` and the last accepted one is ``min_gap`` back.

    The state between frames is how many frames are still barred (0..min_gap) and
    how many boundaries there were, so each block of frames boils down to a table
    from entry state to (exit state, boundaries accepted).  Returns frame_index,
    the boundary's running number from 1 and the optional ``tag`` of its frame.
    """
    tag = F.lit(None).cast("boolean") if tag is None else tag
    blocks = (scored.withColumn("_blk", block_of("frame_index", block))
              .groupBy(*keys, "_blk")
              .agg(F.array_sort(F.collect_list(F.when(
                  F.col("score") >= threshold, F.struct(F.col("frame_index").alias("c"), tag.alias("t"))))).alias("_c")))
    return _greedy(blocks, min_gap, keys, block, fan)


def _greedy(blocks: DataFrame, min_gap: int, keys: Sequence[str], block: int, fan: int) -> DataFrame:
    """Boundaries of blocks (keys, _blk) with their candidates ``_c`` (frame c, tag t) in order."""
    long = lambda v: F.lit(v).cast("bigint")
    first, last = F.col("_blk") * block, (F.col("_blk") + 1) * block

    def leave(barred: Column) -> Column:
        return F.aggregate(
            "_c", F.struct((first + barred).alias("s"), long(0).alias("n")),
            lambda a, c: F.when(c["c"] >= a["s"], F.struct((c["c"] + min_gap).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a),
            lambda a: F.struct(F.greatest(long(0), a["s"] - last).alias("s"), a["n"].alias("n")))

    def then(g: Column, a: Column) -> Column:
        step = F.get(g, a["s"].cast("int"))
        return F.struct(step["s"].alias("s"), (a["n"] + step["n"]).alias("n"))

    tabled = materialize(blocks.withColumn("_f", F.transform(F.sequence(long(0), long(min_gap)), leave)))
    enter = carry_in(tabled.select(*keys, "_blk", "_f"), keys, "_f",
                     lambda f, g: F.transform(f, lambda a: then(g, a)), then,
                     F.struct(long(min_gap).alias("s"), long(0).alias("n")), "_s", fan)
    free = emit_states(F.col("_c"), first + F.col("_s.s"), lambda s, c: F.when(c["c"] >= s, c["c"] + min_gap).otherwise(s),
                       lambda s, t, c: F.when(c["c"] >= s, c))
    kept = F.filter(free, lambda c: c.isNotNull())
    return (tabled.where(F.size("_c") > 0).select(*keys, "_blk", "_c").join(enter, [*keys, "_blk"])
            .select(*keys, F.col("_s.n").alias("_n"), F.posexplode_outer(kept).alias("_i", "_k")).where("_k is not null")
            .select(*keys, F.col("_k.c").alias("frame_index"), (F.col("_n") + F.col("_i") + 1).alias("number"),
                    F.col("_k.t").alias("tag")))


def shot_manifest(bounds: DataFrame, counts: DataFrame, rate: float = 24.0,
                  keys: Sequence[str] = VIDEO) -> DataFrame:
    """Any boundary list to contiguous closed shots numbered from 1.

    ``counts`` holds ``frame_count`` per video; boundaries outside 0 < b < count
    and repeats are dropped.  A boundary with a true ``tag`` starts a fade.
    """
    c = counts.where("frame_count > 0")
    inner = (join_small(bounds.select(*keys, F.col("frame_index").alias("start_frame"), "tag"), c, keys, F.col("start_frame"))
             .where("start_frame > 0 and start_frame < frame_count")
             .groupBy(*keys, "start_frame").agg(F.max("frame_count").alias("frame_count"), F.max("tag").alias("tag")))
    s = running_sum(inner, keys, "start_frame", F.lit(1).cast("bigint"), "number")
    return _shot_rows(s, c, rate, keys)


def _shot_rows(numbered: DataFrame, counts: DataFrame, rate: float, keys: Sequence[str]) -> DataFrame:
    """Shots from boundaries (start_frame, number from 1, tag): each ends before the next one, the last with its video."""
    long = lambda v: F.lit(v).cast("bigint")
    s = numbered.select(*keys, "start_frame", (F.col("number") + 1).alias("shot_id"), "tag")
    # A first shot at 0, and an end that is no shot.
    ends = F.explode(F.array(F.struct(long(0).alias("at"), long(1).alias("id")), F.struct(F.col("frame_count").cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("id"))))
    more = counts.where("frame_count > 0").select(*keys, ends.alias("_e"))
    s = s.unionByName(more.select(*keys, F.col("_e.at").alias("start_frame"), F.col("_e.id").alias("shot_id"), F.lit(None).cast("boolean").alias("tag")))
    s = with_next(s, keys, "start_frame", ["start_frame"], "_n").where("shot_id is not null")
    end = F.col("_n.start_frame") - 1
    return s.select(
        *keys, "shot_id", "start_frame", end.alias("end_frame"),
        (F.col("start_frame") / rate).alias("start_time"), ((end + 1) / rate).alias("end_time"),
        F.when(F.col("start_frame") == 0, "start").when(F.col("tag"), "fade").otherwise("cut").alias("transition"))


def frame_counts(frames: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    return frames.groupBy(*keys).agg((F.max("frame_index") + 1).alias("frame_count"))


def detect_shots(frames: DataFrame, counts: DataFrame, threshold: float, min_gap: int, rate: float = 24.0,
                 fade: Column | None = None, block: int = BLOCK, keys: Sequence[str] = VIDEO, value: str = "value", fan: int = 512) -> DataFrame:
    """Frames to shots; boundaries are already numbered and distinct.

    The frames are cut into blocks once; scores and candidates are worked out inside them.  ``value``
    is a number or a gray plane as in :func:`frame_diff`.
    """
    block = min(block, PLANE_BLOCK) if isinstance(frames.schema[value].dataType, ArrayType) else block
    scored = _scored_blocks(frames, keys, value, block, F.lit(None).cast("boolean") if fade is None else fade)
    held = F.transform(F.filter("_s", lambda x: x["score"] >= threshold), lambda x: F.struct(x["c"].alias("c"), x["t"].alias("t")))
    b = _greedy(scored.select(*keys, "_blk", held.alias("_c")), min_gap, keys, block, fan)
    return _shot_rows(b.withColumnRenamed("frame_index", "start_frame"), counts, rate, keys)


def assign_shots(frames: DataFrame, bounds: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Running shot number of every frame, from its boundary flags."""
    flag = bounds.select(*keys, "frame_index", F.lit(1).cast("bigint").alias("_f"))
    f = frames.join(flag, [*keys, "frame_index"], "left")
    return (running_sum(f, keys, "frame_index", F.coalesce(F.col("_f"), F.lit(0)), "_n")
            .withColumn("shot_id", F.col("_n") + 1).drop("_f", "_n"))


def frame_to_shot(frames: DataFrame, shots: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    return interval_join(frames, shots.select(*keys, "shot_id", "start_frame", "end_frame", "transition"),
                         keys, "frame_index", "start_frame", "end_frame")


def scan_frames(frames: DataFrame, shots: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Frames read per shot against the shot's length; ``complete`` is false when any are missing.

    Frames outside every shot of a video are one more row, of null shot and not complete.
    """
    held = (frame_to_shot(frames, shots, keys).groupBy(*keys, "shot_id")
            .agg(F.count(F.lit(1)).alias("frames_read")))
    counted = (shots.join(held, [*keys, "shot_id"], "left")
               .select(*keys, "shot_id", F.coalesce("frames_read", F.lit(0)).alias("frames_read"),
                       (F.col("end_frame") - F.col("start_frame") + 1).alias("frames_expected")))
    owned = held.groupBy(*keys).agg(F.sum("frames_read").alias("_owned"))
    left = F.col("_all") - F.coalesce("_owned", F.lit(0))
    over = (frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).join(owned, list(keys), "left").where(left > 0)
            .select(*keys, F.lit(None).cast(shots.schema["shot_id"].dataType).alias("shot_id"), left.alias("frames_read"), F.lit(0).cast("bigint").alias("frames_expected")))
    return counted.unionByName(over).withColumn("complete", F.col("frames_read") == F.col("frames_expected"))


def representative_indices(start: Column, count: Column, limit: int = 12) -> Column:
    """At most ``limit`` frame numbers: evenly spread adjacent pairs, or all of a short shot."""
    if limit < 1:
        raise ValueError("limit must be positive")
    middle = start + F.floor((count - 1) / 2)
    whole = F.sequence(start, start + count - 1)
    if limit == 1:
        return F.when(count <= 1, whole).otherwise(F.array(middle))
    pairs = limit // 2
    last = count - 2
    if pairs == 1:
        firsts = F.array(F.floor(last / 2))
    else:
        d = pairs - 1
        firsts = F.transform(F.sequence(F.lit(0), F.lit(pairs - 1)),
                             lambda k: F.floor((k * last + d // 2) / d))
    chosen = F.array_distinct(F.flatten(F.transform(firsts, lambda p: F.array(start + p, start + p + 1))))
    chosen = F.when(F.size(chosen) < limit, F.array_distinct(F.concat(chosen, F.array(middle)))).otherwise(chosen)
    return F.when(count <= limit, whole).otherwise(F.slice(F.array_sort(chosen), 1, limit))


def sample_plan(shots: DataFrame, limit: int = 12, keys: Sequence[str] = VIDEO) -> DataFrame:
    n = F.col("end_frame") - F.col("start_frame") + 1
    return shots.select(*keys, "shot_id", F.explode_outer(
        representative_indices(F.col("start_frame"), n, limit)).alias("frame_index"))


def even_positions(n: Column, k: int) -> Column:
    """Array of floor(linspace(0, n-1, min(n, k))), in double arithmetic."""
    m = F.least(n, F.lit(k))
    step = (n - 1).cast("double") / F.greatest(m - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), m.cast("bigint") - 1), lambda i: F.when(
        i == m - 1, F.when(m == 1, F.lit(0).cast("bigint")).otherwise(n - 1))
        .otherwise(F.floor(i.cast("double") * step)))


def scan_sampled(frames: DataFrame, plan: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Only the planned frames.  The plan is an equi-join key, never a collected list."""
    return frames.join(plan, [*keys, "frame_index"])


def plan_problems(plan: DataFrame, shots: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Shots whose sample plan is absent, foreign, repeated or outside the shot."""
    p = plan.groupBy(*keys, "shot_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("frame_index").alias("u"),
        F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"))
    s = shots.select(*keys, "shot_id", "start_frame", "end_frame")
    j = p.join(s, [*keys, "shot_id"], "full_outer")
    why = (F.when(F.col("n").isNull(), "missing").when(F.col("start_frame").isNull(), "foreign")
           .when(F.col("n") != F.col("u"), "duplicate")
           .when((F.col("lo") < F.col("start_frame")) | (F.col("hi") > F.col("end_frame")), "outside"))
    return j.withColumn("problem", why).where("problem is not null").select(*keys, "shot_id", "problem")


def collapse_ranges(ids: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Sorted ids to maximal runs of consecutive ids."""
    had = ids.select(*keys, (F.col(order) + 1).alias(order), F.lit(1).cast("bigint").alias("_prev"))
    f = ids.select(*keys, order).distinct().join(had.distinct(), [*keys, order], "left")
    f = running_sum(f, keys, order, F.when(F.col("_prev").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), "_run")
    return (f.groupBy(*keys, "_run").agg(F.min(order).alias("range_start"), F.max(order).alias("range_end"))
            .drop("_run"))


def adjacent_pairs(frames: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows whose direct predecessor (index - 1) is present, with that row's columns.

    An equi-join on the index, so gaps fall out and no ordering is needed.
    """
    prev = frames.select(*keys, (F.col("frame_index") + 1).alias("frame_index"),
                         F.struct(*cols).alias("prev"))
    return frames.join(prev, [*keys, "frame_index"])


def hard_cut_runs(shots: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Number the runs of shots between hard cuts (anything but a fade starts a run)."""
    hard = F.when(F.col("transition") != "fade", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return running_sum(shots, keys, "shot_id", hard, "run_id")


def previous_shot(shots: DataFrame, cols: Sequence[str], keys: Sequence[str] = VIDEO) -> DataFrame:
    return with_previous(shots, keys, "shot_id", cols, "prev")


def speech_ratio(shots: DataFrame, spans: DataFrame, keys: Sequence[str] = VIDEO, width: float = 3600.0) -> DataFrame:
    """Adds the share of each shot that spans cover, 1 at most; spans that overlap count twice.

    The shots are read once: each is listed in the cells it touches, met there by the spans of the
    cell if any, and summed up again.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    v = spans.select(*keys, "start_s", "end_s").withColumn("_cell", cell("start_s", "end_s"))
    both = shots.withColumn("_cell", cell("start_time", "end_time")).join(v, [*keys, "_cell"], "left")
    begins = F.greatest("start_time", "start_s")
    part = F.when(F.col("start_s").isNotNull() & (F.col("_cell") == F.floor(begins / width)), F.greatest(F.lit(0.0), F.least("end_time", "end_s") - begins))
    whole = both.groupBy(*shots.columns).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("_overlap"))
    length = F.greatest(F.col("end_time") - F.col("start_time"), F.lit(1e-9))
    return whole.withColumn("speech_ratio", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_overlap") / length))).drop("_overlap")


def shot_at_time(heads: DataFrame, shots: DataFrame, keys: Sequence[str] = VIDEO,
                 width: float = 4.0) -> DataFrame:
    """Shot with start <= t < end for each playhead; t is first clamped to the video."""
    length = shots.groupBy(*keys).agg(F.max("end_time").alias("_len"))
    h = (join_small(heads, length, keys, F.col("head_id"))
         .withColumn("t", F.least(F.col("_len"), F.greatest(F.lit(0.0), F.col("t")))).drop("_len"))
    m = interval_join(h, shots.select(*keys, "shot_id", "start_time", "end_time"), keys, "t",
                      "start_time", "end_time", width, "left")
    m = m.withColumn("shot_id", F.when(F.col("t") < F.col("end_time"), F.col("shot_id")))
    return m.groupBy(*keys, "head_id", "t").agg(F.max("shot_id").alias("shot_id"))


def draft_coverage(plan: DataFrame, shots: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Sampled and total frames of every shot, 0 sampled where the plan has none."""
    got = plan.groupBy(*keys, "shot_id").agg(F.count(F.lit(1)).alias("_n"))
    return shots.join(got, [*keys, "shot_id"], "left").select(
        *keys, "shot_id", F.coalesce("_n", F.lit(0).cast("bigint")).alias("sampled_frames"), (F.col("end_frame") - F.col("start_frame") + 1).alias("total_frames"))
