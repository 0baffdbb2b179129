"""Ordered primitives against plain loops, with blocks small enough that every border is crossed."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import depth as D
from frameloom.operators import direct as X
from frameloom.operators import ordered as O
from frameloom.operators import segment as SEG
from frameloom.streaming import jobs as J


def series(spark, n=300, videos=(1, 2), seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(v, i, float(x)) for v in videos for i, x in enumerate(rng.uniform(0, 100, n))],
                                 "video_id long, frame_index long, value double")


def test_number_rows_matches_sorting(spark):
    rng = np.random.default_rng(1)
    rows = [(int(v), int(t), i) for i, (v, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 50, 400)))]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    got = {r.id: r.p for r in O.number_rows(df, ["k"], ["t", "id"], [F.floor(F.col("t") / 7)], "p").collect()}
    for k in range(3):
        for place, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            assert got[r[2]] == place


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_previous_and_next(spark, block):
    df = series(spark, 20, (1,))
    rows = O.with_next(O.with_previous(df, ["video_id"], "frame_index", ["frame_index"], "p", block),
                       ["video_id"], "frame_index", ["frame_index"], "n", block).orderBy("frame_index").collect()
    assert len(rows) == 20
    for i, r in enumerate(rows):
        assert (r.p.frame_index if r.p else None) == (i - 1 if i else None)
        assert (r.n.frame_index if r.n else None) == (i + 1 if i < 19 else None)


@pytest.mark.parametrize("block,fan", [(8, 3), (50, 2), (1024, 512)])
def test_greedy_boundaries(spark, block, fan):
    df = series(spark)
    scored = SEG.frame_diff(df, block=block)
    got = {(r.video_id, r.frame_index): r.number for r in SEG.shot_boundaries(scored, 40.0, 7, block=block, fan=fan).collect()}
    want = {}
    for v in (1, 2):
        vals = [r.value for r in df.where(f"video_id = {v}").orderBy("frame_index").collect()]
        last, n = 0, 0
        for i in range(1, len(vals)):
            if i - last >= 7 and abs(vals[i] - vals[i - 1]) >= 40.0:
                last, n = i, n + 1
                want[(v, i)] = n
    assert got == want


def test_manifest_cleans_boundaries(spark):
    b = spark.createDataFrame([(1, x, False) for x in (10, 20, 20, -1, 100)], "video_id long, frame_index long, tag boolean")
    n = spark.createDataFrame([(1, 30)], "video_id long, frame_count long")
    s = SEG.shot_manifest(b, n, 10.0).orderBy("shot_id").collect()
    assert [(r.shot_id, r.start_frame, r.end_frame, r.transition) for r in s] == [
        (1, 0, 9, "start"), (2, 10, 19, "cut"), (3, 20, 29, "cut")]
    assert s[1].start_time == 1.0


@pytest.mark.parametrize("block,fan", [(5, 2), (1024, 512)])
def test_carried_clamp(spark, block, fan):
    rng = np.random.default_rng(5)
    rows = [(v, i + 1, float(rng.uniform()), bool(rng.uniform() < 0.05)) for v in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "video_id long, shot_id long, x double, hard boolean")
    got = {(r.video_id, r.shot_id): r.applied for r in X.carried_clamp(df, "x", 0.18, F.col("hard"), block=block, fan=fan).collect()}
    for v in (1, 2):
        y = None
        for _, s, x, hard in (r for r in rows if r[0] == v):
            y = x if hard or y is None else min(min(1.0, y + 0.18), max(max(0.0, y - 0.18), x))
            assert got[(v, s)] == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("tile,block,fan", [(5, 4, 2), (64, 256, 256)])
def test_smooth_time(spark, tile, block, fan):
    rng = np.random.default_rng(2)
    z = rng.uniform(size=(40, 12))
    df = spark.createDataFrame([(1, 1, i, 3, 4, [float(v) for v in z[i]]) for i in range(40)],
                               "video_id long, shot_id long, frame_index long, h int, w int, z array<double>")
    got = D.smooth_time(df, 0.82, tile=tile, block=block, fan=fan).orderBy("frame_index").collect()
    y = z[0]
    for i, r in enumerate(got):
        y = z[0] if i == 0 else 0.82 * y + 0.18 * z[i]
        assert np.allclose(r.z, np.clip(y, 0, 1), atol=1e-12)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    data = {1: rng.normal(size=501), 2: np.round(rng.normal(size=40), 1), 3: np.zeros(7), 4: np.asarray([2.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k long, v double")
    for r in O.exact_quantiles(df, ["k"], "v", {"a": 0.02, "b": 0.5, "c": 0.98}).collect():
        assert np.allclose([r.a, r.b, r.c], np.percentile(data[r.k], [2, 50, 98]), atol=1e-12)


@pytest.mark.parametrize("block", [3, 65_536])
def test_running(spark, block):
    df = series(spark, 30, (1,))
    d = O.running_max(O.running_sum(df, ["video_id"], "frame_index", F.col("value"), "s", block), ["video_id"], "frame_index", F.col("value"), "m", False, block)
    seen = []
    for r in d.orderBy("frame_index").collect():
        assert r.m == (max(seen) if seen else None)
        seen.append(r.value)
        assert r.s == pytest.approx(sum(seen))


@pytest.mark.parametrize("block", [4, 1024])
def test_stage_machine(spark, block):
    rng = np.random.default_rng(4)
    ops = ["start", "complete", "fail", "cancel"]
    rows = [(1, i, ops[int(rng.choice(4, p=[.4, .4, .1, .1]))], int(rng.integers(0, 3))) for i in range(60)]
    got = {r.seq: (r.completed_stages, r.running) for r in J.stage_machine(
        spark.createDataFrame(rows, "id long, seq long, op string, stage int"), 3, block=block).collect()}
    status = ["running", "locked", "locked"]
    for _, seq, op, k in rows:
        if op == "start" and status[k] != "complete" and (k == 0 or status[k - 1] == "complete"):
            status[k] = "running"
        elif op == "complete" and status[k] == "running":
            status[k] = "complete"
        elif op in ("fail", "cancel") and status[k] != "complete":
            status[k] = "failed"
        assert got[seq] == (status.count("complete"), "running" in status)


def test_speech_ratio_counts_overlaps_twice(spark):
    shots = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.0, 9000.0)], "video_id long, shot_id long, start_time double, end_time double")
    spans = spark.createDataFrame([(1, .25, .75), (1, .5, .6), (1, 3000.0, 8000.0)], "video_id long, start_s double, end_s double")
    got = {r.shot_id: r.speech_ratio for r in SEG.speech_ratio(shots, spans).collect()}
    assert got[1] == pytest.approx(0.6) and got[2] == pytest.approx(5000 / 8999)


def test_representatives(spark):
    s = spark.createDataFrame([(1, 1, 100, 199), (1, 2, 200, 204)], "video_id long, shot_id long, start_frame long, end_frame long")
    got = {}
    for r in SEG.sample_plan(s).collect():
        got.setdefault(r.shot_id, []).append(r.frame_index)
    assert sorted(got[1]) == [100, 101, 120, 121, 139, 140, 159, 160, 178, 179, 198, 199]
    assert sorted(got[2]) == [200, 201, 202, 203, 204]
    one = SEG.sample_plan(s, 1).where("shot_id = 1").collect()
    assert [r.frame_index for r in one] == [149]


def test_scan_frames_with_leftovers(spark):
    """Frames of no shot are a row of null shot; a shot without frames is not complete."""
    f = spark.createDataFrame([(1, i) for i in (0, 1, 2, 3, 9)], "video_id long, frame_index long")
    s = spark.createDataFrame([(1, 1, 0, 3, "start"), (1, 2, 4, 8, "cut")], "video_id long, shot_id long, start_frame long, end_frame long, transition string")
    got = {(r.shot_id, r.frames_read, r.frames_expected, r.complete) for r in SEG.scan_frames(f, s).collect()}
    assert got == {(1, 4, 4, True), (2, 0, 5, False), (None, 1, 0, False)}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_equally_bright_pictures_are_cut(spark, block):
    """A cut between pictures of one mean gray level is found in their cells; a missing plane and a new size are no cut."""
    a, b = [0.0, 100.0] * 8, [100.0, 0.0] * 8
    rows = [(1, i, 4, 4, *[a if i < 7 else b] * 3) for i in range(14)] + [(1, 14, 2, 2, *[[50.0] * 4] * 3), (1, 15, 2, 2, None, None, None), (1, 16, 2, 2, *[[50.0] * 4] * 3)]
    f = spark.createDataFrame(rows, "video_id long, frame_index long, h int, w int, b array<double>, g array<double>, r array<double>")
    g = SEG.gray_planes(f).select("video_id", "frame_index", "gray")
    assert {x.frame_index: x.score for x in SEG.frame_diff(g, value="gray", block=block).collect()} == {i: None if i in (0, 14, 15, 16) else pytest.approx(100.0 if i == 7 else 0.0) for i in range(17)}
    n = spark.createDataFrame([(1, 17)], "video_id long, frame_count long")
    got = SEG.detect_shots(g, n, 27.0, 5, value="gray", block=block).orderBy("shot_id").collect()
    assert [(r.shot_id, r.start_frame, r.end_frame) for r in got] == [(1, 0, 6), (2, 7, 16)]


def test_area_resize_of_planes():
    from frameloom.functions import pixels as PX
    rng = np.random.default_rng(1)
    for h, w, h2, w2 in [(6, 8, 3, 4), (5, 7, 2, 3), (4, 4, 4, 4), (3, 5, 1, 1)]:
        z = rng.uniform(size=h * w)
        ys, xs = [i * h // h2 for i in range(h2 + 1)], [i * w // w2 for i in range(w2 + 1)]
        want = [z.reshape(h, w)[ys[i]:ys[i + 1], xs[j]:xs[j + 1]].mean() for i in range(h2) for j in range(w2)]
        assert np.allclose(PX.resize_area(z, h, w, h2, w2), want)


def test_stacked_clamps_read_their_source_once(spark, tmp_path):
    """Two clamps on one another: the rows they came from are not in the plan again, the blocks written on the way are."""
    src = str(tmp_path / "rows")
    spark.createDataFrame([(1, i, (i * 37 % 100) / 100, i % 7 == 0) for i in range(40)], "video_id long, shot_id long, x double, hard boolean").write.parquet(src)
    once = X.carried_clamp(spark.read.parquet(src), "x", 0.18, F.col("hard"))
    twice = X.carried_clamp(once, "applied", 0.1, F.lit(False), out="again", had="_h")
    assert src not in " ".join(twice.inputFiles()) and twice.count() == 40
