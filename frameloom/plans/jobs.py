"""Whole jobs: compositions of the operators, one DataFrame in, one or a few out.

A stage's table is used by several later steps, so each stage ends in ``save``: by default
a table in the shared checkpoint folder, read back.  Nothing upstream of it runs twice, and a
lost executor costs one stage at most.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import pixels as PX
from ..functions import rules as R
from ..operators import chunks as CH
from ..operators import depth as D
from ..operators import direct as X
from ..operators import features as FE
from ..operators import ledger as L
from ..operators import quality as K
from ..operators import render as V
from ..operators import segment as SEG
from ..sources.artifacts import materialize

C = F.col
Save = Callable[[DataFrame], DataFrame]
SHOT = ["video_id", "shot_id"]


def hard_cut() -> Column:
    return C("transition") != "fade"


def script_digest() -> Column:
    return L.digest("shot_id", "preset", *[L.number_text(c) for c in ("confidence", *R.PARAMS[:5])], "transition_frames",
                    "edge_protection", "manual_override", F.array_join(F.transform("guard_actions", lambda a: a["code"]), ","))


def _partners(features: DataFrame, edge: DataFrame, shots: DataFrame) -> DataFrame:
    return L.join_shot_tables({"shots": shots.select(*SHOT, "transition"), "features": features, "depth": edge.select(*SHOT, "edge_near")})


def direct(features: DataFrame, edge: DataFrame, shots: DataFrame, suggestions: DataFrame | None = None,
           existing: DataFrame | None = None, width: int = 1280, choose=R.select_preset) -> DataFrame:
    """Features to a guarded script; outside suggestions and manual edits are honoured.

    Shots that lack a partner table's row are not in the script but in :func:`direct_errors`.
    """
    whole = _partners(features, edge, shots).where(F.size("missing") == 0)
    f = whole.select(*SHOT, "features.*", C("depth.edge_near").alias("edge_near"), C("shots.transition").alias("transition"), F.lit(width).alias("video_width"))
    if suggestions is None:
        script = X.create_script(f, hard_cut(), choose=choose)
    else:
        rows = X.with_preset(X.merge_recommendations(f, suggestions))
        script = X.comfort_guard(rows, hard_cut()).withColumn("manual_override", F.lit(False))
    return script if existing is None else X.carry_overrides(existing, script)[0]


def direct_errors(features: DataFrame, edge: DataFrame, shots: DataFrame) -> DataFrame:
    """One row for each table that lacks a shot another one names."""
    gone = _partners(features, edge, shots).select(*SHOT, F.explode("missing").alias("_m"))
    return gone.select(*SHOT, F.lit("direct").alias("stage"), F.concat(F.lit("missing_"), "_m").alias("error"), F.lit(1).cast("bigint").alias("rows"))


def scan_errors(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """Shots with frames missing, and videos with frames that belong to no shot."""
    s = SEG.scan_frames(frames, shots).where("not complete")
    what = F.when(C("shot_id").isNull(), "frames_left_over").otherwise("frames_missing")
    return s.select(*SHOT, F.lit("scan").alias("stage"), what.alias("error"), F.abs(C("frames_read") - C("frames_expected")).alias("rows"))


def render_errors(rendered: DataFrame) -> DataFrame:
    """Frames that could not be rendered, counted by shot and cause."""
    bad = rendered.where("error is not null").groupBy(*SHOT, "error").agg(F.count(F.lit(1)).alias("rows"))
    return bad.select(*SHOT, F.lit("render").alias("stage"), "error", "rows")


def sampled(frames: DataFrame, shots: DataFrame, limit: int = 12) -> DataFrame:
    """Representative frames renumbered from 0 in their shot, the real number kept in frame_no."""
    s = SEG.scan_sampled(frames.drop("shot_id"), SEG.sample_plan(shots, limit))
    w = Window.partitionBy(*SHOT).orderBy("frame_no")  # at most `limit` rows
    return s.withColumnRenamed("frame_index", "frame_no").withColumn("frame_index", F.row_number().over(w).cast("bigint") - 1)


def local_frames(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """All frames with their shot, numbered from 0 in the shot, the real number kept in video_frame."""
    f = SEG.frame_to_shot(frames.drop("shot_id"), shots)
    return (f.withColumn("video_frame", C("frame_index")).withColumn("frame_index", C("frame_index") - C("start_frame"))
            .drop("start_frame", "end_frame", "transition"))


def analyze_draft(frames: DataFrame, shots: DataFrame, spans: DataFrame, existing: DataFrame | None = None,
                  save: Save = materialize) -> dict[str, DataFrame]:
    """Quick analysis from representative frames: features, script, coverage, revision."""
    shots = save(shots)
    few = save(D.image_cue_depth(sampled(frames, shots)))
    planes, stats = D.estimate_depth(few, keep=0.0)
    planes, stats = save(planes), save(stats)
    feats = FE.shot_features(few, planes, shots, SEG.speech_ratio(shots, spans), stats)
    script = save(direct(feats, D.edge_near_shots(planes), shots, existing=existing))
    feats = script.select(*feats.columns)
    return {"features": feats, "script": script, "coverage": SEG.draft_coverage(SEG.sample_plan(shots), shots),
            "revision": L.tree_digest(script, ["video_id"], "shot_id", script_digest())}


def estimate_depth(frames: DataFrame, shots: DataFrame, save: Save = materialize, backend: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Depth of every frame, normalised and smoothed per shot, and each shot's statistics.

    Image cues, or a registered ``backend``, whose failing shots fall back to image cues and may
    claim less.  The statistics say which it was: backend, fallback_used, error_code.
    """
    local = local_frames(frames, shots)
    if backend is None:
        raw = D.image_cue_depth(local)
        how = [F.lit(None).cast("string").alias("error_code"), F.lit(False).alias("fallback_used"), F.lit("monocular-cues").alias("backend")]
    else:
        raw, told = CH.run_backend(save(local), backend)
    raw = save(PX.narrowed(raw, ["video_id", "shot_id", "frame_index", "h", "w", "z"]))
    planes, stats = D.estimate_depth(raw)
    stats = stats.select("*", *how) if backend is None else CH.capped_reliability(stats, told)
    return save(planes), save(stats)


def depth_gate(planes: DataFrame, stats: DataFrame, shots: DataFrame, grid: tuple[int, int] | None = None, max_shot_frames: int | None = None) -> DataFrame:
    """Per video why its depth may not ship (null when it may); of any grid unless one is given."""
    size = planes.where("z is not null").groupBy(*SHOT).agg(F.count(F.lit(1)).alias("frame_count"), F.max("h").alias("height"), F.max("w").alias("width"))
    meta = size.join(stats.select(*SHOT, "backend", C("backend").alias("video_backend"), F.lit(True).alias("ledger_current")), SHOT, "left")
    return L.release_gate(meta, shots, grid or (C("height"), C("width")), max_shot_frames, R.RELEASE_BACKENDS)


def extract_features(frames: DataFrame, planes: DataFrame, stats: DataFrame, shots: DataFrame, spans: DataFrame) -> DataFrame:
    return FE.shot_features(local_frames(frames, shots), planes, shots, SEG.speech_ratio(shots, spans), stats)


def render(frames: DataFrame, planes: DataFrame, shots: DataFrame, script: DataFrame, mode: str = "calibrated",
           ref_width: Column | None = None) -> DataFrame:
    """Views, masks and mixed picture of every frame, parameters eased at fades.

    ``planes``: video_id, shot_id, frame_index (in the shot), h, w, z; resized to the frame where needed.
    A frame without a plane or a script keeps its row: no pictures, and ``error`` says what lacks.
    """
    f = SEG.frame_to_shot(frames.drop("shot_id", "z"), shots)
    f = f.withColumn("_at", C("frame_index") - C("start_frame")).drop("shot_id", "start_frame", "end_frame", "transition")
    eased = V.ease_parameters(f, shots, script)
    z = planes.select(*SHOT, C("frame_index").alias("_at"), C("h").alias("_zh"), C("w").alias("_zw"), "z")
    j = eased.join(z, [*SHOT, "_at"], "left")
    error = F.when(C("depth_strength").isNull(), "missing_script").when(C("z").isNull(), "missing_plane")
    return V.render_frames(j.withColumn("error", error), ref_width, mode, plane=("_zh", "_zw"))


def preview_frames(frames: DataFrame, planes: DataFrame, shots: DataFrame, script: DataFrame, offset: int,
                   mode: str = "calibrated", ref_width: Column | None = None) -> DataFrame:
    """One rendered frame per shot at ``offset`` (clamped); the choice is made before any pixel work."""
    want = shots.select("video_id", F.least(C("start_frame") + offset, C("end_frame")).alias("frame_index"))
    return render(frames.join(want, ["video_id", "frame_index"], "left_semi"), planes, shots, script, mode, ref_width)


def final_with_qc(rendered: DataFrame, script: DataFrame, depth_meta: DataFrame, media: DataFrame,
                  save: Save = materialize) -> dict[str, DataFrame]:
    """Quality rows per frame, shot and video, the histogram and the page of a finished render."""
    good = rendered.where("error is null") if "error" in rendered.columns else rendered
    frames = save(K.frame_qc(good))
    shots = K.with_actions(K.shot_qc(frames), script, depth_meta)
    report = K.qc_report(shots, media)
    return {"frames": frames, "shots": shots, "report": report, "histogram": K.disparity_histogram(good),
            "html": K.qc_html(shots, report)}


def media_of(frames: DataFrame, rendered: DataFrame, stats: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """What the report compares, per video: frames expected, rendered and repeated, durations, and whether depth was made up.

    ``media``: audio_seconds and video_seconds of the finished file; unknown without it.
    """
    good = rendered.where("error is null").groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    made_up = stats.groupBy("video_id").agg(F.max((C("backend") == "synthetic") | C("fallback_used")).alias("_s"))
    out = frames.groupBy("video_id").agg(F.countDistinct("frame_index").alias("expected_frames")).join(good, "video_id", "left").join(made_up, "video_id", "left")
    if media is None:
        out = out.withColumns({"audio_seconds": F.lit(None).cast("double"), "video_seconds": F.lit(None).cast("double")})
    else:
        out = out.join(media.select("video_id", "audio_seconds", "video_seconds"), "video_id", "left")
    n = F.coalesce("_n", F.lit(0))
    return out.select("video_id", "expected_frames", n.alias("rendered_frames"), F.greatest(F.lit(0), n - C("expected_frames")).alias("duplicated_frames"),
                      "audio_seconds", "video_seconds", F.coalesce("_s", F.lit(False)).alias("synthetic"))


def find_shots(frames: DataFrame, threshold: float = 27.0, min_gap: int = 12, rate: float = 24.0, width: int = 320, save: Save = materialize) -> DataFrame:
    """Shots of every video from its pictures: gray planes of ``width`` cells at most, cut where they change."""
    gray = save(PX.narrowed(SEG.gray_planes(frames, width), ["video_id", "frame_index", "gray"]))
    return SEG.detect_shots(gray, SEG.frame_counts(gray), threshold, min_gap, rate, value="gray")


def run(frames: DataFrame, shots: DataFrame | None = None, spans: DataFrame | None = None, suggestions: DataFrame | None = None,
        existing: DataFrame | None = None, ref_width: Column | None = None, pending: DataFrame | None = None,
        save: Save = materialize, media: DataFrame | None = None, backend: str | None = None, grid: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """Shots, depth, features, direction, render and quality of every video (of ``pending`` ones when given).

    Shots are found in the frames where none are given.  ``errors`` lists what could not be done:
    nothing that lacks a partner vanishes without a row there.  ``gate`` says which videos may ship.
    """
    if pending is not None:
        todo = pending.select("video_id").distinct()
        frames, shots, spans = (d if d is None else d.join(todo, "video_id", "left_semi") for d in (frames, shots, spans))
        frames = save(frames)
    shots = save(find_shots(frames, save=save) if shots is None else shots)
    if spans is None:
        spans = frames.sparkSession.createDataFrame([], "video_id bigint, start_s double, end_s double")
    planes, stats = estimate_depth(frames, shots, save, backend)
    feats = save(extract_features(frames, planes, stats, shots, spans))
    edge = D.edge_near_shots(planes)
    script = save(X.guard_for_render(save(direct(feats, edge, shots, suggestions, existing)), hard_cut()))
    rendered = save(render(frames, planes, shots, script, ref_width=ref_width))
    errors = scan_errors(frames, shots).unionByName(direct_errors(feats, edge, shots)).unionByName(render_errors(rendered))
    meta = stats.select(*SHOT, "fallback_used", "error_code")
    return {"shots_found": shots, "depth": planes, "features": script.select(*feats.columns), "script": script, "rendered": rendered,
            "errors": errors, "gate": depth_gate(planes, stats, shots, grid),
            **final_with_qc(rendered, script, meta, media_of(frames, rendered, stats, media), save)}
