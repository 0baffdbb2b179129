"""Whole jobs on small tables that lack a plane, a script or a partner, and a project brought up to date."""
import pytest

from frameloom.operators import depth as D
from frameloom.operators import direct as X
from frameloom.operators import segment as SEG
from frameloom.plans import jobs as P
from frameloom.plans import project as PJ

N = 4


def frames_of(spark, videos=(1,), cut=3, count=6):
    """Flat pictures with a bright block that moves; another picture from frame ``cut`` on."""
    rows = []
    for v in videos:
        for i in range(count):
            z = [40.0 if i < cut else 200.0] * (N * N)
            z[(i + v) % (N * N)] = 250.0
            rows.append((v, i, N, N, z, z, z))
    return spark.createDataFrame(rows, "video_id long, frame_index long, h int, w int, b array<double>, g array<double>, r array<double>")


def test_planes_of_empty_shots_stay(spark):
    rows = [(1, 1, 0, 1, 2, [0.1, 0.9]), (1, 2, 0, 1, 2, [float("nan"), None]), (1, 1, 1, 1, 2, [0.2, 0.8])]
    raw = spark.createDataFrame(rows, "video_id long, shot_id long, frame_index long, h int, w int, z array<double>")
    planes, stats = D.estimate_depth(raw)
    got = {(r.shot_id, r.frame_index): r.z for r in planes.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[(2, 0)] is None and got[(1, 0)] is not None
    assert {r.shot_id: r.valid for r in stats.collect()} == {1: True, 2: False}


def test_missing_partners_are_errors(spark):
    feats = spark.createDataFrame([(1, 1, 0.1), (1, 3, 0.2)], "video_id long, shot_id long, motion_score double")
    edge = spark.createDataFrame([(1, 1, False), (1, 2, True)], "video_id long, shot_id long, edge_near boolean")
    shots = spark.createDataFrame([(1, 1, "start"), (1, 2, "cut")], "video_id long, shot_id long, transition string")
    got = {(r.shot_id, r.error) for r in P.direct_errors(feats, edge, shots).collect()}
    assert got == {(2, "missing_features"), (3, "missing_shots"), (3, "missing_depth")}


def test_unknown_preset_and_unsampled_shot_keep_their_row(spark):
    rows = spark.createDataFrame([(1, "neutral"), (2, "nonsense")], "shot_id long, preset string")
    got = {r.shot_id: r.depth_strength for r in X.with_preset(rows).collect()}
    assert set(got) == {1, 2} and got[2] is None and got[1] is not None
    shots = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 5, 9)], "video_id long, shot_id long, start_frame long, end_frame long")
    plan = spark.createDataFrame([(1, 1, 0)], "video_id long, shot_id long, frame_index long")
    assert {(r.shot_id, r.sampled_frames, r.total_frames) for r in SEG.draft_coverage(plan, shots).collect()} == {(1, 1, 5), (2, 0, 5)}


def test_frames_without_plane_or_script_are_rows(spark):
    frames = frames_of(spark)
    shots = spark.createDataFrame([(1, 1, 0, 2, "start"), (1, 2, 3, 5, "cut")], "video_id long, shot_id long, start_frame long, end_frame long, transition string")
    planes = spark.createDataFrame([(1, 1, i, N, N, [0.5] * 8 + [0.9] * 8) for i in (0, 2)], "video_id long, shot_id long, frame_index long, h int, w int, z array<double>")
    script = X.with_preset(spark.createDataFrame([(1, 1, "neutral")], "video_id long, shot_id long, preset string"))
    done = P.render(frames, planes, shots, script)
    got = {r.frame_index: (r.error, r.mix is not None) for r in done.select("frame_index", "error", "mix").collect()}
    assert got == {0: (None, True), 1: ("missing_plane", False), 2: (None, True), **{i: ("missing_script", False) for i in (3, 4, 5)}}
    assert {(r.shot_id, r.error, r.rows) for r in P.render_errors(done).collect()} == {(1, "missing_plane", 1), (2, "missing_script", 3)}


def test_run_from_frames(spark):
    """Shots found in the pictures, every frame rendered, nothing left over, depth that may ship."""
    out = P.run(frames_of(spark), media=spark.createDataFrame([(1, 1.0, 0.25)], "video_id long, audio_seconds double, video_seconds double"))
    assert [(r.start_frame, r.end_frame) for r in out["shots_found"].orderBy("shot_id").collect()] == [(0, 5)]
    (r,) = out["report"].collect()
    assert (r.frame_count, r.expected_frames, r.dropped_frames, r.duplicated_frames) == (6, 6, 0, 0)
    assert "Audio/video duration differs by more than 50 ms" in r.warnings and not any("synthetic" in w for w in r.warnings)
    assert out["errors"].count() == 0 and [g.reason for g in out["gate"].collect()] == [None]


def test_project_runs_only_what_changed(spark, tmp_path):
    frames = frames_of(spark, (1, 2))
    spans = spark.createDataFrame([(1, 0.0, 0.05)], "video_id long, start_s double, end_s double")
    more = spans.unionByName(spark.createDataFrame([(2, 0.0, 0.1)], spans.schema))
    project = PJ.Project(spark, str(tmp_path / "p"))
    ran = lambda *a, **k: sorted((r.video_id, r.stage, r.reason) for r in project.update(*a, upto="features", **k).collect())
    stages = ("depth", "features", "shots")
    assert ran(frames, spans) == [(v, s, "never_run") for v in (1, 2) for s in stages]
    assert ran(frames, spans) == []
    assert ran(frames, more) == [(2, "features", "input_changed")]
    got = {r.video_id: r.speech_ratio for r in project.table("features", "features").collect()}
    assert got[2] > 0 and got[1] > 0
    # A run that was lost before its ledger rows leaves nothing that counts.
    spark.createDataFrame([(2, 1, 0.0)], "video_id long, shot_id long, speech_ratio double").write.parquet(f"{project.folder}/features/features/run=9")
    assert ran(frames, more) == [] and project.table("features", "features").count() == 2
    assert ran(frames, more, force=("shots",)) == [(1, "shots", "forced"), (2, "shots", "forced")]


@pytest.mark.parametrize("changed", [True, False])
def test_changed_output_is_made_again(spark, tmp_path, changed):
    frames = frames_of(spark, (1,))
    project = PJ.Project(spark, str(tmp_path / "p"))
    spans = spark.createDataFrame([], "video_id long, start_s double, end_s double")
    assert project.update(frames, spans, upto="shots").count() == 1
    if changed:
        path = f"{project.folder}/shots/shots/run=1"
        rows = [tuple(r) for r in spark.read.parquet(path).collect()]
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([(*r[:-1], "fade") for r in rows], schema).write.mode("overwrite").parquet(path)
    assert [(r.stage, r.reason) for r in project.update(frames, spans, upto="shots").collect()] == ([("shots", "output_changed")] if changed else [])
