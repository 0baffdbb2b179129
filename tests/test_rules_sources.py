"""Rules, limits, edits, protocol lines, documents and jobs on small inputs."""
import json

import pytest
from pyspark.sql import functions as F

from frameloom.functions import rules as R
from frameloom.functions import text as TX
from frameloom.operators import direct as X
from frameloom.operators import ledger as L
from frameloom.operators import workspace as W
from frameloom.sources import artifacts as A
from frameloom.sources import probe as PR
from frameloom.operators import constraints as K
from frameloom.sources import protocol as PT
from frameloom.streaming import jobs as J

BASE = dict(motion_score=.2, speech_ratio=0.0, depth_spread=.4, foreground_ratio=.2, depth_reliability=1.0)


def feats(spark, *changes, transition="cut"):
    rows = [(1, i + 1, *{**BASE, **c}.values(), transition, False) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "video_id long, shot_id long, motion_score double, speech_ratio double, depth_spread double, "
                                       "foreground_ratio double, depth_reliability double, transition string, edge_near boolean")


def hard():
    return F.col("transition") != "fade"


def test_each_preset_is_reachable(spark):
    f = feats(spark, {}, {"speech_ratio": .8}, {"motion_score": .9}, {"depth_spread": .8, "foreground_ratio": .1}, {"depth_spread": .1, "foreground_ratio": .6})
    got = [r.preset for r in X.create_script(f, hard()).orderBy("shot_id").collect()]
    assert got == ["neutral", "dialogue_subtle", "action_controlled", "vista_deep", "closeup_flat"]


def asked(spark, conv=(0.5,), transition="cut", **other):
    f = feats(spark, *[dict(motion_score=.95, depth_reliability=.2)] * len(conv), transition=transition).withColumn("edge_near", F.lit(True))
    c = F.create_map(*[F.lit(x) for i, v in enumerate(conv) for x in (i + 1, v)])
    return f.withColumns({"preset": F.lit("action_controlled"), "confidence": F.lit(.2), "depth_strength": F.lit(1.8), "convergence_depth_percentile": F.try_element_at(c, F.col("shot_id").cast("int")),
                          "max_background_disparity_norm": F.lit(.03), "max_popout_disparity_norm": F.lit(.02), "temporal_smoothing": F.lit(.9), "transition_frames": F.lit(8), "edge_protection": F.lit(True)})


def test_limits_hold_and_are_logged(spark):
    r = X.comfort_guard(asked(spark), hard()).collect()[0]
    codes = [a.code for a in r.guard_actions]
    assert r.max_popout_disparity_norm == 0 and r.depth_strength <= 1 and r.max_background_disparity_norm == .01
    assert {"reduced_due_to_high_motion", "reduced_due_to_unreliable_depth", "popout_disabled_due_to_low_confidence"} <= set(codes)
    assert "popout_disabled_due_to_edge_violation" not in codes  # already zero: nothing changed, nothing logged


@pytest.mark.parametrize("kind,want", [("cut", .9), ("fade", .28)])
def test_convergence_chain(spark, kind, want):
    r = X.comfort_guard(asked(spark, (.1, .9), kind), hard()).orderBy("shot_id").collect()
    assert r[0].convergence_depth_percentile == .1 and r[1].convergence_depth_percentile == pytest.approx(want)


def test_guarding_again_changes_nothing(spark):
    one = X.comfort_guard(asked(spark, (.1, .9, .2), "fade"), hard()).withColumn("manual_override", F.lit(False))
    cols = ["shot_id", "depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm", "guard_actions"]
    two = X.guard_for_render(one, hard())
    assert sorted(map(str, one.select(cols).collect())) == sorted(map(str, two.select(cols).collect()))


def test_stale_or_wrong_edits_change_nothing(spark):
    s = X.create_script(feats(spark, {}, {}), hard())
    rev = L.tree_digest(s, ["video_id"], "shot_id", L.digest("shot_id", "preset"))
    now = rev.collect()[0].revision
    edit = lambda shot, r: X.with_preset(spark.createDataFrame([(1, shot, "vista_deep", r)], "video_id long, shot_id long, preset string, expected_revision string"))
    for shot, r, outcome in ((1, "0" * 64, "revision_conflict"), (9, now, "unknown_shot")):
        out, v = X.apply_overrides(s, edit(shot, r), rev)
        assert v.collect()[0].outcome == outcome and out.where("manual_override").count() == 0
    out, v = X.apply_overrides(s, edit(1, now), rev)
    assert v.collect()[0].outcome == "applied"
    assert [(r.shot_id, r.preset) for r in out.where("manual_override").collect()] == [(1, "vista_deep")]


def test_tree_digest_depends_on_order_and_rows(spark):
    d = lambda rows, fan: L.tree_digest(spark.createDataFrame(rows, "k long, o long, d string"), ["k"], "o", F.col("d"), fan=fan).collect()[0].revision
    rows = [(1, i, str(i)) for i in range(20)]
    assert d(rows, 4) == d(rows[::-1], 4) != d([(1, i, str(i + (i == 7))) for i in range(20)], 4)


def test_probe_document(spark):
    doc = {"format": {"duration": "2.0"}, "streams": [
        {"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "24000/1001", "r_frame_rate": "30/1", "nb_frames": "48", "codec_name": "h264", "side_data_list": [{"rotation": -90}]},
        {"codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "48000", "tags": {"language": "eng"}, "duration": "1.99"}]}
    r = PR.parse_probe(spark.createDataFrame([(json.dumps(doc),)], "probe string")).collect()[0]
    assert (r.frame_count, r.variable_frame_rate, r.rotation_degrees) == (48, True, 270)
    a = r.audio_streams[0]
    assert (a.language, a.duration_seconds, a.channels, a.sample_rate) == ("eng", 1.99, 2, 48000)


def test_request_lines(spark):
    contracts = {"ping": (set(), set()), "inspect": ({"input_path"}, {"input_path"})}
    lines = {'{"id":"1","method":"ping","params":{}}': None, '{"id":"1","method":"ping","params":{"x":1}}': "unknown_params",
             '{"id":"1","method":"inspect","params":{}}': "missing_params", '{"id":"1","method":"zap","params":{}}': "unknown_method",
             '{"id":"1","method":"inspect","params":{"a":[{"API-key":1}]}}': "secret_in_params", "nope": "not_an_object",
             '{"id":"1","method":"ping"} {': "not_an_object", '{"method":"ping"}': "bad_request", '{"id":"' + "x" * 400 + '"}': "too_large"}
    got = {r.value: r.error for r in PT.read_protocol(spark.createDataFrame([(k,) for k in lines], "value string"), contracts, max_bytes=300).collect()}
    assert got == lines


def test_request_values(spark):
    free = {"input_path", "project_dir", "name", "swap_eyes", "resume", "profile", "x"}
    contracts = {m: (free, set()) for m in ("inspect", "create_project", "render")}
    cases = [("inspect", {"input_path": "a"}, None), ("inspect", {"project_dir": "a", "x": 1}, None), ("inspect", {}, "inspect_input"),
             ("inspect", {"input_path": "a", "project_dir": "b"}, "inspect_input"), ("inspect", {"input_path": "a", "x": 1}, "inspect_input"),
             ("create_project", {"name": "My film"}, None), ("create_project", {}, None), ("create_project", {"name": "  \u00a0 "}, "bad_name"),
             ("create_project", {"name": "a\u0085b"}, "bad_name"), ("create_project", {"name": 5}, "bad_name"), ("create_project", {"name": None}, "bad_name"),
             ("create_project", {"name": "x" * 160}, None), ("create_project", {"name": "x" * 161}, "bad_name"), ("create_project", {"name": "a\tb"}, "bad_name"),
             ("render", {"swap_eyes": True, "resume": False}, None), ("render", {"swap_eyes": "true"}, "not_boolean:swap_eyes"),
             ("render", {"resume": None}, "not_boolean:resume"), ("render", {"resume": 1}, "not_boolean:resume"),
             ("render", {"profile": "representative_frames"}, None), ("render", {"profile": "all"}, "unknown_profile"), ("render", {"profile": 3}, "unknown_profile")]
    rows = [(i, json.dumps({"id": str(i), "method": m, "params": p})) for i, (m, p, _) in enumerate(cases)]
    got = {r.i: r.error for r in PT.read_protocol(spark.createDataFrame(rows, "i long, value string"), contracts).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(cases)}


def test_table_rules(spark):
    inf = float("inf")
    media = spark.createDataFrame([(1, 1920, 1080, 24.0, 2.0, 48, -90), (2, 16384, 16384, 24.0, 2.0, 48, 45), (3, 0, 10, 0.0, inf, -1, 0), (4, None, 10, float("nan"), 1.0, 1, 720)],
                                  "video_id long, width int, height int, frame_rate double, duration_seconds double, frame_count long, rotation_degrees int")
    got = {r.video_id: r.violations for r in K.table_violations(media, "media").collect()}
    assert got == {1: [], 2: ["rotation_degrees_unknown", "pixels_limit", "frame_bytes_limit"],
                   3: ["width_range", "frame_rate_above_0", "duration_seconds_range", "frame_count_range"],
                   4: ["width_range", "frame_rate_above_0", "frame_rate_range", "pixels_limit", "frame_bytes_limit"]}
    p = dict(depth_strength=.5, convergence_depth_percentile=.5, max_background_disparity_norm=.01, max_popout_disparity_norm=.0, temporal_smoothing=.9, transition_frames=4, edge_protection=True)
    script = spark.createDataFrame([(1, 1, "neutral", .5, p), (1, 0, "bold", 1.5, {**p, "depth_strength": 2.5}), (1, 2, "neutral", .5, None)],
                                   "video_id long, shot_id long, preset string, confidence double, parameters struct<depth_strength double, convergence_depth_percentile double, "
                                   "max_background_disparity_norm double, max_popout_disparity_norm double, temporal_smoothing double, transition_frames int, edge_protection boolean>")
    got = {r.shot_id: r.violations for r in K.table_violations(script, "script").collect()}
    assert got[1] == [] and got[0] == ["shot_id_range", "preset_unknown", "confidence_range", "depth_strength_range"] and len(got[2]) == 7
    told = K.rule_counts(script, "script").collect()[0]
    assert (told.row_count, told.bad_rows, told.broken["depth_strength_range"]) == (3, 2, 2)


def test_manifests(spark):
    runs = {1: ([(1, 0, 4), (2, 5, 9)], 10, []), 2: ([(1, 0, 4), (1, 5, 9)], 10, ["repeated_ids"]), 3: ([(1, 0, 4), (2, 6, 9)], 10, ["not_contiguous"]),
            4: ([(1, 0, 6), (2, 5, 9)], 10, ["not_contiguous"]), 5: ([(1, 0, 4)], 10, ["not_contiguous"]), 6: ([], 10, []), 7: ([(1, 0, 0)], 0, ["shots_of_nothing"]),
            8: ([(1, 5, 2)], 3, ["reversed_range", "not_contiguous"]), 9: ([(1, 0, 1)], None, ["no_media"]), 10: ([(1, 1, 9)], 10, ["not_contiguous"])}
    shots = spark.createDataFrame([(v, *s) for v, (ss, _, _) in runs.items() for s in ss], "video_id long, shot_id long, start_frame long, end_frame long")
    media = spark.createDataFrame([(v, n) for v, (_, n, _) in runs.items() if n is not None], "video_id long, frame_count long")
    assert {r.video_id: r.problems for r in K.manifest_problems(shots, media).collect()} == {v: w for v, (_, _, w) in runs.items()}


def test_redaction_and_bounds(spark):
    t = "Authorization: BEARER abc.def, x sk-12_3.z; bearer \"q mine"
    r = spark.createDataFrame([(t, "mine", "é" * 10)], "t string, s string, u string").select(
        TX.redact(F.col("t"), F.col("s")).alias("r"), TX.truncate_bytes(F.col("u"), 5, "+").alias("b"), TX.tail_bytes(F.col("u"), 4).alias("e")).collect()[0]
    assert r.r == 'Authorization: BEARER [redacted], x [redacted]; bearer "q [redacted]'
    assert r.b == "éé�+" and r.e == "éé"


def test_documents(spark, tmp_path):
    for n, body in {"ok": '{"a":1,"b":"x"}', "extra": '{"a":1,"b":"x","c":2}', "type": '{"a":"q","b":"x"}', "list": "[1]", "big": '{"a":1,"b":"' + "x" * 99 + '"}'}.items():
        (tmp_path / f"{n}.json").write_text(body)
    got = {r.path.rsplit("/", 1)[1]: r.error for r in A.read_artifacts(spark, str(tmp_path), "a long, b string", 60).collect()}
    assert got == {"ok.json": None, "extra.json": "unknown_field", "type.json": "bad_field", "list.json": "not_an_object", "big.json": "too_large"}


def test_documents_share_folders(spark, tmp_path):
    """A thousand documents come back whole from at most 256 folders, and no folder is one document's own root path."""
    docs = spark.range(1000).select(F.format_string("%d.json", "id").alias("name"), F.to_json(F.struct(F.col("id").alias("a"))).alias("value"))
    A.write_documents(docs, str(tmp_path / "docs"))
    got = A.read_artifacts(spark, str(tmp_path / "docs"), "a long")
    assert sorted((r.path.rsplit("/", 1)[1], r.doc.a, r.error) for r in got.collect()) == sorted((f"{i}.json", i, None) for i in range(1000))
    assert len(list((tmp_path / "docs").iterdir())) <= 256


def test_versions_are_never_overwritten(spark, tmp_path):
    A.write_artifacts(spark.range(3), str(tmp_path), 1)
    with pytest.raises(Exception):
        A.write_artifacts(spark.range(4), str(tmp_path), 1)


def test_pending_reasons(spark):
    s = "video_id long, stage string, fingerprint string, dependency_fingerprint string, output_fingerprints map<string,string>"
    want = spark.createDataFrame([(1, "depth", "abc", "d", {"o": "1"}), (2, "depth", "abc", "d", {"o": "2"}), (3, "depth", "new", "d", {"o": "1"})], s)
    led = spark.createDataFrame([(v, "depth", "abc", "d", {"o": "1"}, "complete", "1", "1") for v in (1, 2, 3)], s + ", status string, engine_version string, algorithm_version string")
    got = {r.video_id: (r.reason, r.dependencies_current) for r in L.pending_stages(want, led, "1", "1").collect()}
    assert got == {2: ("output_changed", True), 3: ("input_changed", True)}


def test_selection_left_empty(spark):
    shots = spark.createDataFrame([(1, 1), (2, 1)], "video_id long, shot_id long")
    kept, empty = W.select_shots(shots, spark.createDataFrame([(1, 1), (2, 5)], "video_id long, shot_id long"))
    assert kept.count() == 1 and [r.video_id for r in empty.collect()] == [2]


def test_streamed_shots_over_batches(spark, tmp_path):
    """Two batches with a late frame give what one pass over the frames in order gives."""
    vals = [0, 50, 0, 50, 50, 0, 0, 90, 0, 10, 80, 0]
    rows = [(1, i, float(v)) for i, v in enumerate(vals)]
    src = tmp_path / "in"
    one = "video_id long, frame_index long, value double"
    spark.createDataFrame(rows[:6], one).coalesce(1).write.parquet(str(src))
    stream = lambda: J.stream_shots(spark.readStream.schema(one).parquet(str(src)), 40.0, 3)
    J.run_to_table(stream(), str(tmp_path / "job"))
    spark.createDataFrame([(1, 2, 99.0), *rows[6:]], one).coalesce(1).write.mode("append").parquet(str(src))
    path = J.run_to_table(stream(), str(tmp_path / "job"))
    last, want = 0, []
    for i in range(1, len(vals)):
        if i - last >= 3 and abs(vals[i] - vals[i - 1]) >= 40:
            last = i
            want.append(i)
    assert sorted(r.frame_index for r in spark.read.parquet(path).collect()) == want


def test_backend_names(spark):
    rows = spark.createDataFrame([(" VDA_small ",), ("zoe",)], "n string").select(R.canonical_backend(F.col("n")).alias("b")).collect()
    assert [r.b for r in rows] == ["video-depth-anything-small", None]
