"""Quality checks: per frame, per shot and per video, plus the report page."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from .depth import SHOT, temporal_change

C = F.col
# Fixed values of the report (limits here, warning texts in qc_report).
BINS, BIN_LOW, BIN_HIGH = 40, -0.05, 0.05
LARGE_HOLE, DRIFT_SECONDS = 256, 0.050


def _largest(mask: np.ndarray) -> int:
    """Largest 4-connected region: union of row runs that touch in adjacent rows."""
    parent: list[int] = []
    size: list[int] = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    above: list[tuple[int, int, int]] = []
    for row in mask:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        runs = []
        j = 0
        for s, e in zip(edges[::2], edges[1::2]):
            k = len(parent)
            parent.append(k)
            size.append(int(e - s))
            runs.append((int(s), int(e), k))
            while j < len(above) and above[j][1] <= s:
                j += 1
            t = j
            while t < len(above) and above[t][0] < e:
                a, b = root(k), root(above[t][2])
                if a != b:
                    parent[b] = a
                    size[a] += size[b]
                t += 1
        above = runs
    return max((size[i] for i in range(len(parent)) if parent[i] == i), default=0)


def _component(mask: np.ndarray, rows: int, cols: int, most: int) -> int:
    grid = mask.astype(bool).reshape(rows, cols)
    if not most or rows * cols <= most:
        return _largest(grid)
    b = 2
    while -(-rows // b) * -(-cols // b) > most:
        b += 1
    padded = np.pad(grid, ((0, -rows % b), (0, -cols % b)))
    blocks = padded.reshape(padded.shape[0] // b, b, padded.shape[1] // b, b).any(axis=(1, 3))
    return min(int(grid.sum()), _largest(blocks) * b * b)


def largest_component(frames: DataFrame, mask: str, out: str = "largest", max_cells: int = 0) -> DataFrame:
    """Adds the largest 4-connected region of a boolean grid, exact at any size.

    With ``max_cells``, grids over that size give an upper bound instead: they are first OR-reduced by the smallest block size that fits; the
    block count is scaled back and held to the number of set cells.  Each frame is
    one row, so this is a narrow step over Arrow batches.
    """
    return P.pixel_step(frames, [mask, "h", "w"], f"`{out}` bigint", lambda f: {out: _component(f[mask], f["h"], f["w"], max_cells)})


def frame_qc(frames: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """One row per rendered frame; ``depth_temporal_change`` is null for a shot's first frame."""
    used = [*keys, "frame_index", "h", "w", "z", "disparity", "edge_mask", "holes", "largest_hole_pixels"]
    f = P.narrowed(largest_component(frames, "holes", "largest_hole_pixels"), used)
    zero = F.lit(0.0)
    count = lambda m: F.size(F.filter(m, lambda v: v)).cast("bigint")
    told = f.select(
        *keys, "frame_index", "h", "w", "z", F.greatest(zero, F.array_max("disparity")).alias("max_popout_disparity_norm"),
        F.greatest(zero, -F.array_min("disparity")).alias("max_background_disparity_norm"), count("edge_mask").alias("edge_violation_pixels"),
        count("holes").alias("hole_pixels"), "largest_hole_pixels")
    return temporal_change(told, keys, "z").drop("h", "w", "z").withColumnRenamed("change", "depth_temporal_change")


def shot_qc(frames: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Maxima and sums per shot; the mean change counts only frames that have a predecessor."""
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"), F.max("max_popout_disparity_norm").alias("max_popout_disparity_norm"),
        F.max("max_background_disparity_norm").alias("max_background_disparity_norm"), F.sum("edge_violation_pixels").alias("edge_violation_pixels"),
        F.sum("hole_pixels").alias("hole_pixels"), F.max("largest_hole_pixels").alias("largest_hole_pixels"),
        F.coalesce(F.avg("depth_temporal_change"), F.lit(0.0)).alias("depth_temporal_change"))


def with_actions(shots: DataFrame, script: DataFrame, depth_meta: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Adds the limit codes of each shot and whether its depth fell back or failed."""
    s = script.select(*keys, F.transform("guard_actions", lambda a: a["code"]).alias("comfort_overrides"))
    d = depth_meta.select(*keys, "fallback_used", C("error_code").isNotNull().alias("depth_failed"))
    return (shots.join(s, list(keys), "left").join(d, list(keys), "left")
            .withColumns({"comfort_overrides": F.coalesce("comfort_overrides", F.array().cast("array<string>")),
                          "fallback_used": F.coalesce("fallback_used", F.lit(False)),
                          "depth_failed": F.coalesce("depth_failed", F.lit(False))}))


def disparity_histogram(frames: DataFrame, keys: Sequence[str] = ("video_id",), values: str = "disparity") -> DataFrame:
    """Counts over 40 equal bins on [-0.05, 0.05]; the last bin is closed, outside values are dropped.

    Counted inside each frame first, so a frame sends at most 40 rows on.
    """
    width = (BIN_HIGH - BIN_LOW) / BINS
    v = frames.select(*keys, F.explode_outer(values).alias("v")).where((C("v") >= BIN_LOW) & (C("v") <= BIN_HIGH))
    b = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((C("v") - BIN_LOW) / width))).cast("bigint")
    # The quotient may land one bin off at an edge; the edge itself decides.
    edge = lambda k: F.when(k == BINS, BIN_HIGH).otherwise(F.lit(BIN_LOW) + k * F.lit(width))
    exact = (F.when(C("v") < edge(C("b")), C("b") - 1)
             .when((C("v") >= edge(C("b") + 1)) & (C("b") < BINS - 1), C("b") + 1).otherwise(C("b")))
    counts = v.withColumn("b", b).withColumn("bin", exact).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = frames.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))))
    return every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def qc_report(shots: DataFrame, media: DataFrame, key: str = "video_id") -> DataFrame:
    """One row per video: totals, maxima, weighted change and the warnings that apply.

    ``media``: expected_frames, rendered_frames, duplicated_frames, audio_seconds,
    video_seconds, synthetic (booleans and numbers per video).
    """
    t = shots.groupBy(key).agg(
        F.max("max_popout_disparity_norm").alias("max_popout_disparity_norm"), F.max("max_background_disparity_norm").alias("max_background_disparity_norm"),
        F.sum("edge_violation_pixels").alias("edge_violations"), F.sum("hole_pixels").alias("hole_pixels"),
        F.max("largest_hole_pixels").alias("largest_hole_pixels"), F.sum("frame_count").alias("_n"),
        F.sum(C("depth_temporal_change") * C("frame_count")).alias("_c"),
        F.sum(F.when(F.size("comfort_overrides") > 0, 1).otherwise(0)).cast("bigint").alias("shots_with_overrides"),
        F.sum(F.when(C("fallback_used"), 1).otherwise(0)).cast("bigint").alias("shots_using_fallback"),
        F.sum(F.when(C("depth_failed"), 1).otherwise(0)).cast("bigint").alias("depth_failures"))
    r = media.join(t, key, "left")
    nil = lambda c, v=0: F.coalesce(C(c), F.lit(v))
    dropped = F.greatest(F.lit(0), C("expected_frames") - C("rendered_frames"))
    drift = F.abs(C("audio_seconds") - C("video_seconds"))
    warn = F.array_compact(F.array(
        F.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(" expected frames were not rendered"))),
        F.when(C("duplicated_frames") > 0, F.concat(C("duplicated_frames").cast("string"), F.lit(" duplicated frames were detected"))),
        F.when(drift > DRIFT_SECONDS, F.lit("Audio/video duration differs by more than 50 ms")),
        F.when(nil("edge_violations") > 0, F.lit("Potential stereo window-edge violations were detected")),
        F.when(nil("largest_hole_pixels") > LARGE_HOLE, F.lit("Large disocclusion holes remain in one or more shots")),
        F.when(C("synthetic"), F.lit("Render used synthetic demo depth and is not a production deliverable"))))
    return r.select(
        key, C("rendered_frames").alias("frame_count"), "expected_frames", dropped.alias("dropped_frames"),
        F.greatest(F.lit(0), C("duplicated_frames")).alias("duplicated_frames"), drift.alias("audio_video_difference"),
        nil("max_popout_disparity_norm", 0.0).alias("max_popout_disparity_norm"), nil("max_background_disparity_norm", 0.0).alias("max_background_disparity_norm"),
        nil("edge_violations").alias("edge_violations"), nil("hole_pixels").alias("hole_pixels"), nil("largest_hole_pixels").alias("largest_hole_pixels"),
        (nil("_c", 0.0) / F.greatest(F.lit(1), nil("_n"))).alias("depth_temporal_change"),
        nil("shots_with_overrides").alias("shots_with_overrides"), nil("shots_using_fallback").alias("shots_using_fallback"),
        nil("depth_failures").alias("depth_failures"), warn.alias("warnings"))


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_rows(shots: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Table rows of the report page, one per shot, keyed and ordered by shot."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    four = lambda c: F.format_string("%.4f", F.bround(c, 4))
    return shots.select(*keys, "shot_id", F.concat(
        F.lit("<tr>"), cell(C("shot_id").cast("string")), cell(C("frame_count").cast("string")), cell(four("max_popout_disparity_norm")),
        cell(four("max_background_disparity_norm")), cell(C("edge_violation_pixels").cast("string")), cell(C("hole_pixels").cast("string")), F.lit("</tr>")).alias("line"))


def qc_html(shots: DataFrame, report: DataFrame, chunk: int = 1024, key: str = "video_id") -> DataFrame:
    """The report page as ordered text chunks per video (``part`` 0 is the head), for ``write.text``.

    Rows are joined in chunks of shots, so a video with very many shots spreads over tasks.
    """
    items = F.array_join(F.transform("warnings", lambda m: F.concat(F.lit("<li>"), escape(m), F.lit("</li>"))), "")
    head = report.select(key, F.lit(0).cast("bigint").alias("part"), F.concat(
        F.lit("<h1>Quality-control report</h1><p>Rendered "), C("frame_count").cast("string"), F.lit(" of "), C("expected_frames").cast("string"),
        F.lit(' expected frames.</p><ul class="warning">'), items,
        F.lit("</ul><table><tr><th>Shot</th><th>Frames</th><th>Max pop-out</th><th>Max background</th><th>Edge pixels</th><th>Hole pixels</th></tr>")).alias("html"))
    body = (html_rows(shots, [key]).groupBy(key, (F.floor(C("shot_id") / chunk) + 1).alias("part"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shot_id", "line"))), lambda s: s["line"]), "").alias("html")))
    tail = report.select(key, F.lit(2 ** 62).cast("bigint").alias("part"), F.lit("</table>").alias("html"))
    return head.unionByName(body).unionByName(tail)
