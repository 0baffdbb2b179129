"""Frame and depth operators on small hand-made planes."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import grid as G
from frameloom.functions import pixels as PX
from frameloom.functions import stereo as T
from frameloom.operators import chunks as CH
from frameloom.operators import depth as D
from frameloom.operators import features as FE
from frameloom.operators import quality as K
from frameloom.operators import render as V

C = F.col
PLANE = "video_id long, shot_id long, frame_index long, h int, w int, z array<double>"


def planes(spark, arrays, shot=1):
    return spark.createDataFrame([(1, shot, i, a.shape[0], a.shape[1], [float(v) for v in a.ravel()]) for i, a in enumerate(arrays)], PLANE)


def test_shot_scale_is_global(spark):
    a = np.linspace(0, 1, 16).reshape(4, 4)
    raw = planes(spark, [a, a + 1])
    s = D.norm_stats(raw, lower=0.0, upper=1.0)
    r = D.normalize(raw, s).orderBy("frame_index").collect()
    assert max(r[0].z) == pytest.approx(0.5) and min(r[1].z) == pytest.approx(0.5)
    assert s.collect()[0].reliability == 1.0


def test_invalid_cells(spark):
    raw = planes(spark, [np.asarray([[0, math.nan], [math.inf, 1]])])
    s = D.norm_stats(raw)
    row = s.collect()[0]
    assert row.invalid_fraction == 0.5 and row.reliability == 0.0
    assert all(math.isfinite(v) for v in D.normalize(raw, s).collect()[0].z)


def test_depth_statistics(spark):
    r = D.depth_stats(planes(spark, [np.zeros((4, 4)), np.ones((4, 4))])).collect()[0]
    assert (r.depth_spread, r.foreground_ratio, r.temporal_change) == (1.0, 0.5, 1.0)


def test_bilinear_keeps_corners(spark):
    z = D.resize(planes(spark, [np.asarray([[0, 1], [1, 0]])]), 5, 7).collect()[0].z
    a = np.asarray(z).reshape(5, 7)
    assert (a[0, 0], a[0, -1], a[-1, 0], a[-1, -1]) == (0, 1, 1, 0)


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_blur(spark, radius):
    a = np.random.default_rng(0).uniform(size=(7, 9))
    got = np.asarray(G.box_blur(planes(spark, [a]), radius, out="z").collect()[0].out).reshape(7, 9)
    p = np.pad(a, radius, mode="edge")
    want = [[p[y:y + 2 * radius + 1, x:x + 2 * radius + 1].mean() for x in range(9)] for y in range(7)]
    assert np.allclose(got, want)


def test_block_match_finds_shift():
    a = np.random.default_rng(1).uniform(size=(12, 16))
    b = np.roll(a, (1, -2), (0, 1))
    assert PX.block_match(a.ravel(), b.ravel(), 12, 16) == (2, -1)
    flat = np.zeros(12)
    assert PX.block_match(flat, flat, 3, 4) == (-3, -2)  # the first of equal ones that fit


def test_collision_nearest_wins(spark):
    df = planes(spark, [np.asarray([[.1, .9, .1]])]).withColumn("shift", F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0)))
    assert V.splat(df).collect()[0].left_src == [-1, 1, 2]


@pytest.mark.parametrize("seed", [0, 1])
def test_splat_against_loop(spark, seed):
    rng = np.random.default_rng(seed)
    z, d = np.round(rng.uniform(size=(4, 30)), 1), rng.normal(0, 4, size=(4, 30))
    df = planes(spark, [z]).withColumn("shift", F.array(*[F.lit(float(v)) for v in d.ravel()]))
    r = V.splat(df).collect()[0]
    for sign, got in ((1, r.left_src), (-1, r.right_src)):
        want = {}
        for i in range(120):
            y, x = divmod(i, 30)
            t = int(np.rint(x + sign * d[y, x] / 2))
            if 0 <= t < 30 and (y * 30 + t not in want or z.flat[want[y * 30 + t]] < z[y, x]):
                want[y * 30 + t] = i
        assert got == [want.get(i, -1) for i in range(120)]


def paint(spark, src, colour, widest=16):
    """One row of cells with the same colour in every channel, painted from its sources."""
    cells = F.array(*[F.lit(float(v)) for v in colour])
    at = F.array(*[F.lit(int(v)).cast("bigint") for v in src])
    f = spark.range(1).select(F.lit(len(src)).alias("w"), cells.alias("b"), cells.alias("g"), cells.alias("r"), at.alias("left_src"), at.alias("right_src"))
    return V.fill_gaps(f, widest).select(F.col("left_b").alias("c"), F.col("right_hole").alias("o")).collect()[0]


def test_gap_is_blended(spark):
    r = paint(spark, [0, -1, -1, -1, 4], [10.0, 0.0, 0.0, 0.0, 50.0])
    assert r.c == [10, 20, 30, 40, 50] and not any(r.o)


@pytest.mark.parametrize("seed", range(3))
def test_fill_against_loop(spark, seed):
    rng = np.random.default_rng(seed)
    valid = np.ones(90, bool)
    for _ in range(6):
        s = int(rng.integers(0, 90))
        valid[s:s + int(rng.integers(1, 22))] = False
    colour = rng.integers(0, 256, 90).astype(float)
    r = paint(spark, [i if valid[i] else -1 for i in range(90)], colour.tolist())
    x = 0
    while x < 90:
        if valid[x]:
            assert r.c[x] == colour[x] and not r.o[x]
            x += 1
            continue
        e = x
        while e < 90 and not valid[e]:
            e += 1
        run, left, right = e - x, x - 1 if x else None, e if e < 90 else None
        for i in range(x, e):
            if run > 16 or (left is None and right is None):
                assert r.o[i] and r.c[i] == 0
            elif left is None or right is None:
                assert r.c[i] == colour[right if left is None else left]
            else:
                t = (i - x + 1) / (run + 1)
                v = np.float32(colour[left]) * np.float32(1 - t) + np.float32(colour[right]) * np.float32(t)
                assert r.c[i] == int(v)
        x = e


def test_basic_mix(spark):
    side = lambda n, *v: [F.array(F.lit(float(x))).alias(f"{n}_{k}") for k, x in zip("bgr", v)]
    f = spark.range(1).select(*side("left", 1, 2, 30), *side("right", 10, 20, 3))
    assert [tuple(V.mix_views(f, "basic", swap).collect()[0].mix[0]) for swap in (False, True)] == [(10, 20, 30), (1, 2, 3)]


def test_frames_without_depth_stay(spark):
    f = planes(spark, [np.zeros((2, 3)), np.ones((2, 3))]).withColumns({
        "z": F.when(F.col("z")[0] > 0, F.col("z")), "depth_strength": F.lit(0.9), "convergence_depth_percentile": F.lit(0.7), "max_background_disparity_norm": F.lit(0.01),
        "max_popout_disparity_norm": F.lit(0.01), "edge_protection": F.lit(True)})
    got = V.with_disparity(f).collect()
    assert len(got) == 2 and sorted(r.disparity is None for r in got) == [False, True]


def test_disparity_limits_and_edges(spark):
    ramp = np.tile(np.linspace(0, 1, 100), (10, 1))
    df = planes(spark, [ramp]).withColumns({"depth_strength": F.lit(0.9), "convergence_depth_percentile": F.lit(0.7), "max_background_disparity_norm": F.lit(0.01),
                                            "max_popout_disparity_norm": F.lit(0.001), "edge_protection": F.lit(True)})
    d = np.asarray(V.with_disparity(df).collect()[0].disparity).reshape(10, 100)
    assert d.min() >= -0.01 and d.max() <= 0.001 and d[:, -1].max() == 0


@pytest.mark.parametrize("shape,cells,limit,want", [
    ((3, 3), [(0, 0), (0, 1), (1, 0), (2, 2)], 65536, 3), ((6, 6), [(y, x) for y in range(1, 4) for x in range(2, 6)], 65536, 12),
    ((257, 257), [(0, 0), (0, 2)], 65536, 2), ((5, 5), [(0, 0), (0, 2), (0, 4), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4)], 65536, 8)])
def test_largest_region(spark, shape, cells, limit, want):
    m = np.zeros(shape, bool)
    for c in cells:
        m[c] = True
    df = spark.createDataFrame([(shape[0], shape[1], [bool(v) for v in m.ravel()])], "h int, w int, m array<boolean>")
    assert K.largest_component(df, "m", max_cells=limit).collect()[0].largest == want


def frames(spark, shades, nos=None):
    rows = [(1, 1, i, (nos or list(range(len(shades))))[i], 4, 4, *[[float(s)] * 16] * 3) for i, s in enumerate(shades)]
    return spark.createDataFrame(rows, "video_id long, shot_id long, frame_index long, frame_no long, h int, w int, b array<double>, g array<double>, r array<double>")


def test_motion(spark):
    assert FE.motion_score(frames(spark, [0, 255]).drop("frame_no")).collect()[0].motion_score == 1
    sparse = frames(spark, [0, 0, 255, 255], [0, 1, 50, 51])
    m = FE.motion_score(sparse)
    assert m.collect()[0].motion_score == 0
    assert FE.camera_movement(FE.sampled_translations(sparse), m).collect()[0].camera_movement == "static"


def test_failing_backend_falls_back(spark):
    f = frames(spark, [10, 20]).drop("frame_no")
    CH.register_backend("broken", lambda bgr: (_ for _ in ()).throw(RuntimeError("no model")))
    p, how = CH.run_backend(f, "broken")
    assert p.count() == 2 and how.collect()[0].error_code == "no model" and how.collect()[0].backend == "monocular-cues"
    stats = spark.createDataFrame([(1, 1, 0.9)], "video_id long, shot_id long, reliability double")
    assert CH.capped_reliability(stats, how).collect()[0].reliability == 0.62


def test_chunks_join_up(spark):
    base = [np.full((4, 4), float(i)) + np.arange(16).reshape(4, 4) * .05 for i in range(8)]
    c = CH.chunk_frames_of(planes(spark, base), 4, 2)
    c = c.withColumn("z", F.transform("z", lambda v: v * (C("chunk") * 2 + 1) - C("chunk") * 7))
    z = [np.median(r.z) for r in CH.align_chunks(c, 4, 2, block=2).orderBy("frame_index").collect()]
    assert np.allclose(np.diff(z), 1.0, atol=0.15)
    with pytest.raises(ValueError):
        CH.align_chunks(c, 4, 4)


@pytest.mark.parametrize("chunk,over", [(6, 4), (5, 4), (7, 5)])
def test_chunks_overlapping_over_half(spark, chunk, over):
    """Against a plain loop that keeps sums and counts of all frames; one cell is not finite, one shot is flat."""
    rng = np.random.default_rng(3)
    shots = {1: rng.normal(size=(17, 16)).cumsum(0), 2: np.ones((9, 16)), 3: rng.normal(size=(3, 16))}
    rows, want = [], {}
    for shot, z in shots.items():
        total, n = np.zeros_like(z), np.zeros(len(z))
        for k in range(len(z)):
            start = k * (chunk - over)
            end = min(len(z), start + chunk)
            part = z[start:end] * (1 + k % 3) - k + rng.normal(size=(end - start, 16)) * .05 * (shot != 2)
            part[0, 3] = np.nan if k == 2 else part[0, 3]
            rows += [(1, shot, k, start + i, 4, 4, p.tolist()) for i, p in enumerate(part)]
            both = np.flatnonzero(n[start:end] > 0)
            a, b = 1.0, 0.0
            if len(both):
                old, new = (total[start + both] / n[start + both, None]).ravel(), part[both].ravel()
                ok = np.isfinite(old) & np.isfinite(new)
                (o1, om, o3), (n1, nm, n3) = np.percentile(old[ok], [25, 50, 75]), np.percentile(new[ok], [25, 50, 75])
                a = np.clip((o3 - o1) / (n3 - n1), .1, 10) if n3 - n1 > 1e-6 else 1.0
                b = om - a * nm
            total[start:end] += part * a + b
            n[start:end] += 1
            if end == len(z):
                break
        want.update({(shot, i): v for i, v in enumerate(total / n[:, None])})
    c = spark.createDataFrame(rows, "video_id long, shot_id long, chunk long, frame_index long, h int, w int, z array<double>")
    got = {(r.shot_id, r.frame_index): np.array(r.z) for r in CH.align_chunks(c, chunk, over).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9, equal_nan=True)


def test_raw_frames(spark, tmp_path):
    from frameloom.sources.frames import read_raw_frames, write_raw_frames
    (tmp_path / "a.raw").write_bytes(bytes(range(24)) + b"xy")
    (tmp_path / "empty.raw").write_bytes(b"")
    rows = read_raw_frames(spark, str(tmp_path), 2, 2).orderBy("frame_index").collect()
    assert [r.error for r in rows] == [None, None, "partial_record"]
    assert bytes(rows[1].bgr) == bytes(range(12, 24)) and rows[2].bgr is None
    # In spans of one record each the rows are the same, and so are bytes written and read back.
    split = read_raw_frames(spark, str(tmp_path), 2, 2, 1)
    assert split.rdd.getNumPartitions() == 3 and split.orderBy("frame_index").collect() == rows
    made = spark.createDataFrame([(n, i, bytes([i] * 12)) for n in "pq" for i in (2, 0, 1)], "name string, frame_index long, bgr binary")
    write_raw_frames(made, str(tmp_path / "made"))
    assert (tmp_path / "made/q.bgr").read_bytes() == b"".join(bytes([i] * 12) for i in range(3))
    assert read_raw_frames(spark, str(tmp_path / "made"), 2, 2).count() == 6
    (tmp_path / "none").mkdir()
    assert read_raw_frames(spark, str(tmp_path / "none"), 2, 2).count() == 0


def test_histogram_edges(spark):
    v = [-0.05, -0.0475, 0.0, 0.05, 0.0500001, -0.0500001]
    df = spark.createDataFrame([(1, v)], "video_id long, disparity array<double>")
    got = [r.n for r in K.disparity_histogram(df).orderBy("bin").collect()]
    assert got == list(np.histogram(v, np.linspace(-0.05, 0.05, 41))[0])


def test_stacked_pixel_steps_share_a_worker(spark):
    """Disparity, views, filling, holes and their largest region: one Python step, which gives only what is asked for."""
    rng = np.random.default_rng(5)
    rows = [(1, 1, i, 4, 6, *([float(x) for x in rng.integers(0, 255, 24)] for _ in "bgr"), None if i == 2 else [float(x) for x in rng.uniform(size=24)]) for i in range(5)]
    f = spark.createDataFrame(rows, "video_id long, shot_id long, frame_index long, h int, w int, b array<double>, g array<double>, r array<double>, z array<double>").withColumns({
        "depth_strength": F.lit(0.9), "convergence_depth_percentile": F.lit(0.4), "max_background_disparity_norm": F.lit(0.05),
        "max_popout_disparity_norm": F.lit(0.03), "edge_protection": F.lit(False)})
    stacked = K.largest_component(V.hole_union(V.fill_gaps(V.splat(V.with_disparity(f, F.lit(64.0))), 1)), "holes")
    one = PX.narrowed(stacked, ["frame_index", "holes", "largest"])
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = V.splat(V.with_disparity(f, F.lit(64.0)).select("*"))
    apart = K.largest_component(V.hole_union(V.fill_gaps(apart.select("*"), 1).select("*")).select("*"), "holes").select("frame_index", "holes", "largest")
    got = sorted(map(tuple, one.collect()))
    assert got == sorted(map(tuple, apart.collect())) and got[2] == (2, None, None) and any(r[2] for r in got if r[2] is not None)
