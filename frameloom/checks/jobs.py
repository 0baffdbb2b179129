"""Registered queries and their SQL: extension points, chunk alignment, whole jobs."""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import SQL_COLOUR, SQL_FEATURES, SQL_PLANES, colour_frames, depth_planes, reel, table
from ..functions import rules as R
from ..operators import chunks as CH
from ..operators import depth as D
from ..operators import direct as X
from ..operators.ordered import r6
from ..plans import jobs as P
from ..plans import project as PJ
from ..sources import artifacts as A
from ..sources import frames as SF
from ..sources.artifacts import shared_folder
from .depth import S as DEPTH_SQL
from .depth import long_form
from .depth import SQL_EMA, SQL_NORM
from .direct import SEL_C, SEL_P, SQL_PRESETS, hard, r9, sql_guard
from .render import REF, SQL_EVEN, SQL_LUMA, SQL_MATCH

Q, S = {}, {}
C = F.col


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


CHUNK, OVER = 16, 4
SQL_CHUNKS = f"""WITH RECURSIVE {SQL_PLANES}, n AS (SELECT video_id, shot_id, count(*) AS n, CAST(greatest(0, ceil((count(*) - {CHUNK}) / {CHUNK - OVER}.0)) AS BIGINT) AS last FROM planes GROUP BY 1, 2),
 ch AS (SELECT video_id, shot_id, k AS chunk, frame_index, i, z * (1 + 0.3 * (k % 3)) + 0.1 * k AS v FROM (SELECT video_id, shot_id, unnest(range(last + 1)) AS k FROM n) JOIN px USING (video_id, shot_id)
   WHERE frame_index >= k * {CHUNK - OVER} AND frame_index < k * {CHUNK - OVER} + {CHUNK}),
 st AS (SELECT a.video_id, a.shot_id, a.chunk, quantile_cont(b.v, 0.5) AS mp, quantile_cont(a.v, 0.5) AS mc, quantile_cont(b.v, 0.75) - quantile_cont(b.v, 0.25) AS ip, quantile_cont(a.v, 0.75) - quantile_cont(a.v, 0.25) AS ic
   FROM ch a JOIN ch b ON (b.video_id, b.shot_id, b.frame_index, b.i) = (a.video_id, a.shot_id, a.frame_index, a.i) AND b.chunk = a.chunk - 1 GROUP BY 1, 2, 3),
 ft(video_id, shot_id, chunk, a, o) AS (SELECT video_id, shot_id, CAST(0 AS BIGINT), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM n
   UNION ALL SELECT s.video_id, s.shot_id, s.chunk, w.x, f.a * s.mp + f.o - w.x * s.mc FROM ft f JOIN st s ON s.video_id = f.video_id AND s.shot_id = f.shot_id AND s.chunk = f.chunk + 1
    CROSS JOIN LATERAL (SELECT least(10.0, greatest(0.1, CASE WHEN s.ic > 1e-6 THEN f.a * s.ip / s.ic ELSE 1.0 END)) AS x) w)
 SELECT video_id, shot_id, frame_index, i, round(avg(v * a + o), 6) + 0.0 AS z FROM ch JOIN ft USING (video_id, shot_id, chunk) GROUP BY 1, 2, 3, 4"""


@q("align_chunks", SQL_CHUNKS)
def align_chunks(spark, sf):
    c = CH.chunk_frames_of(depth_planes(spark, sf), CHUNK, OVER)
    c = c.withColumn("z", F.transform("z", lambda v: v.cast("double") * (C("chunk") % 3 * 0.3 + 1) + C("chunk") * 0.1))
    return long_form(CH.align_chunks(c, CHUNK, OVER))


@q("align_chunks_wide")
def align_chunks_wide(spark, sf):
    """Overlaps of three quarters of a chunk; tests hold it against a plain loop."""
    c = CH.chunk_frames_of(depth_planes(spark, sf), CHUNK, 12)
    c = c.withColumn("z", F.transform("z", lambda v: v.cast("double") * (C("chunk") % 3 * 0.3 + 1) + C("chunk") * 0.1))
    return long_form(CH.align_chunks(c, CHUNK, 12))


def _dark_is_near(bgr: np.ndarray) -> np.ndarray:
    if bgr[0, 0, 0].sum() > 470:
        raise ValueError("too bright to judge")
    return 1.0 - (bgr @ np.asarray([0.114, 0.587, 0.299])) / 255.0


_MONO = DEPTH_SQL["monocular_depth"]


@q("depth_backend", _MONO[:_MONO.rindex("SELECT video_id")] + """, bad AS (SELECT DISTINCT video_id, shot_id FROM cx WHERE i = 0 AND frame_index % 32 = 0 AND b + g + r > 470)
   SELECT video_id, shot_id, frame_index, y * 8 + x AS i, round(1 - l, 6) + 0.0 AS z FROM lu WHERE shot_id NOT IN (SELECT shot_id FROM bad)
   UNION ALL SELECT video_id, shot_id, frame_index, y * 8 + x AS i, round(v, 6) + 0.0 AS z FROM mo WHERE shot_id IN (SELECT shot_id FROM bad)""")
def depth_backend(spark, sf):
    CH.register_backend("dark-is-near", _dark_is_near)
    return long_form(CH.run_backend(colour_frames(spark, sf), "dark-is-near")[0])


@q("director_hook", "WITH RECURSIVE " + SQL_FEATURES + f""", {SQL_PRESETS}, sel AS (SELECT *, CASE WHEN p = 'action_controlled' THEN 'neutral' ELSE p END AS preset FROM (SELECT *, {SEL_P} AS p, {SEL_C} AS confidence FROM feats)),
  req AS (SELECT sel.*, presets.* EXCLUDE (preset) FROM sel JOIN presets USING (preset))""" + sql_guard("req", "script")
   + "SELECT video_id, shot_id, preset, round(confidence, 9) + 0.0 AS confidence, round(max_popout_disparity_norm, 9) + 0.0 AS max_popout_disparity_norm FROM script")
def director_hook(spark, sf):
    """A caller's own choice of preset; the limits still apply."""
    from ..fixtures import shot_features

    def calm():
        p, c = R.select_preset()
        return F.when(p == "action_controlled", "neutral").otherwise(p), c

    s = X.create_script(shot_features(spark, sf), hard(), choose=calm)
    return s.select("video_id", "shot_id", "preset", r9("confidence").alias("confidence"), r9("max_popout_disparity_norm").alias("max_popout_disparity_norm"))


@q("raw_frames", f"""WITH {SQL_COLOUR}, f AS (SELECT shot_id, frame_index, string_agg(printf('%02x%02x%02x', CAST(b AS INTEGER), CAST(g AS INTEGER), CAST(r AS INTEGER)), '' ORDER BY i) AS h FROM cx GROUP BY 1, 2)
  SELECT shot_id || '.bgr' AS dump, frame_index, sha256(unhex(h)) AS bgr_sha256, NULL::VARCHAR AS error FROM f
  UNION ALL SELECT shot_id || '.bgr', count(*), NULL, 'partial_record' FROM f WHERE shot_id % 3 = 0 GROUP BY 1""")
def raw_frames(spark, sf):
    """Frames written as dumps, one a shot, every third with a torn tail, and read back in spans of 50 records."""
    each = F.array_join(F.transform(F.arrays_zip("b", "g", "r"), lambda c: F.concat(*[F.lpad(F.hex(c[x].cast("bigint")), 2, "0") for x in "bgr"])), "")
    f = colour_frames(spark, sf).select(C("shot_id").alias("name"), "frame_index", F.unhex(each).alias("bgr"))
    torn = f.where("name % 3 = 0").groupBy("name").agg(F.count(F.lit(1)).alias("frame_index")).withColumn("bgr", F.unhex(F.lit("5859")))
    path = f"{shared_folder(spark)}/dumps-{uuid.uuid4().hex}"
    SF.write_raw_frames(f.unionByName(torn), path)
    return SF.read_raw_frames(spark, path, 8, 8, 50 * 192).select(F.element_at(F.split("path", "/"), -1).alias("dump"), "frame_index", F.sha2("bgr", 256).alias("bgr_sha256"), "error")


@q("write_read_artifacts", """SELECT o_orderkey AS shot_id, o_orderpriority AS preset, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS confidence FROM orders""")
def write_read_artifacts(spark, sf):
    """A version of JSON rows, written whole and read back against its schema."""
    k = C("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("shot_id"), C("o_orderpriority").alias("preset"), F.when(k % 7 != 0, C("o_totalprice")).alias("confidence"))
    path = A.write_artifacts(rows, f"{A.shared_folder(spark)}/artifacts-{uuid.uuid4().hex}", 1)
    return spark.read.schema("shot_id bigint, preset string, confidence double").option("mode", "FAILFAST").json(path)


FEATURES = ["video_id", "shot_id", "motion_score", "camera_movement", "depth_spread", "foreground_ratio", "brightness", "speech_ratio", "depth_reliability", "cut_frequency_context"]
SHOW = ["video_id", "shot_id", "preset", "confidence", "depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm", "manual_override"]


def _rounded(df, cols):
    kinds = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if kinds[c] == "double" else C(c) for c in cols])


@q("analyze_draft")
def analyze_draft(spark, sf):
    out = P.analyze_draft(*reel(spark, sf))
    s = out["script"].join(out["coverage"], ["video_id", "shot_id"]).join(out["revision"], "video_id")
    return _rounded(s, [*SHOW, "sampled_frames", "total_frames", "revision"])


# The same chain in SQL: image-cue depth, normalised, smoothed in space and time, then every feature.
_CHAIN = (_MONO[:_MONO.rindex("SELECT video_id")].replace(", mo AS (", ", mono AS (")
          + SQL_NORM.replace("CASE WHEN z > 0.3 THEN NULL ELSE z END AS z FROM px", "v AS z FROM mono") + SQL_EMA + SQL_LUMA + SQL_MATCH)


@q("extract_features", _CHAIN + f""", dd AS (SELECT video_id, shot_id, least(1.0, greatest(0.0, quantile_cont(v, 0.9) - quantile_cont(v, 0.1))) AS sp, avg(CASE WHEN v >= 0.75 THEN 1.0 ELSE 0.0 END) AS fg FROM ema GROUP BY 1, 2),
  pb AS (SELECT video_id, shot_id, {SQL_EVEN} AS f FROM (SELECT video_id, shot_id, n AS m, least(n, 12) AS k, unnest(range(least(n, 12))) AS i FROM cnt)),
  br AS (SELECT video_id, shot_id, avg(m) / 255.0 AS br FROM (SELECT c.video_id, c.shot_id, c.frame_index, avg((b + g + r) / 3.0) AS m FROM cx c JOIN pb ON (c.video_id, c.shot_id, c.frame_index) = (pb.video_id, pb.shot_id, pb.f) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  av AS (SELECT video_id, shot_id, avg(dx) AS mx, avg(dy) AS my FROM tr GROUP BY 1, 2),
  dv AS (SELECT video_id, shot_id, any_value(mx) AS mx, any_value(my) AS my, round(avg(sqrt(pow(dx - mx, 2) + pow(dy - my, 2))), 9) AS d, round(any_value(sqrt(mx * mx + my * my)), 9) AS g FROM tr JOIN av USING (video_id, shot_id) GROUP BY 1, 2)
  SELECT video_id, (shot_id - 1) // 2 + 1 AS shot_id, round(motion_score, 6) + 0.0 AS motion_score, CASE WHEN motion_score < 0.08 THEN 'static' WHEN d > greatest(1.5, g * 1.2) OR motion_score > 0.82 THEN 'unstable' WHEN g < 0.6 THEN 'unstable'
   WHEN abs(mx) > abs(my) * 1.4 THEN 'lateral' WHEN abs(my) > abs(mx) * 1.4 THEN 'vertical' ELSE 'unstable' END AS camera_movement, round(sp, 6) + 0.0 AS depth_spread, round(fg, 6) + 0.0 AS foreground_ratio, round(br, 6) + 0.0 AS brightness,
   CASE WHEN ((shot_id - 1) // 2 + 1) % 2 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS speech_ratio, CASE WHEN hi - lo <= greatest(abs(hi), 1.0) * 1e-7 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS depth_reliability,
   round(least(1.0, greatest(0.0, 1 - n / 24.0 / 8)), 6) + 0.0 AS cut_frequency_context FROM dd JOIN br USING (video_id, shot_id) JOIN dv USING (video_id, shot_id) JOIN mo USING (video_id, shot_id) JOIN st USING (video_id, shot_id) JOIN cnt USING (video_id, shot_id)""")
def extract_features(spark, sf):
    frames, shots, spans = reel(spark, sf)
    frames, shots = A.materialize(frames), A.materialize(shots)
    planes, stats = P.estimate_depth(frames, shots)
    return _rounded(P.extract_features(frames, planes, stats, shots, spans), FEATURES)


def _parts(spark, sf):
    frames, shots, spans = reel(spark, sf)
    frames, shots = A.materialize(frames), A.materialize(shots)
    planes, stats = P.estimate_depth(frames, shots)
    return frames, shots, spans, planes, stats


@q("direct", _CHAIN + f""", dd AS (SELECT video_id, shot_id, least(1.0, greatest(0.0, quantile_cont(v, 0.9) - quantile_cont(v, 0.1))) AS sp, avg(CASE WHEN v >= 0.75 THEN 1.0 ELSE 0.0 END) AS fg,
   avg(CASE WHEN v >= 0.75 THEN 1.0 ELSE 0.0 END) FILTER (x IN (0, 7)) >= 0.02 AS en FROM ema GROUP BY 1, 2),
  feats AS (SELECT video_id, (shot_id - 1) // 2 + 1 AS shot_id, motion_score, CASE WHEN ((shot_id - 1) // 2 + 1) % 2 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS speech_ratio, sp AS depth_spread, fg AS foreground_ratio,
   CASE WHEN hi - lo <= greatest(abs(hi), 1.0) * 1e-7 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS depth_reliability, en AS edge_near, CASE WHEN (shot_id - 1) // 2 + 1 = 3 THEN 'fade' ELSE 'cut' END AS transition, '' AS status, 0 AS price
   FROM dd JOIN mo USING (video_id, shot_id) JOIN st USING (video_id, shot_id)),
  {SQL_PRESETS}, sel AS (SELECT *, {SEL_P} AS preset, {SEL_C} AS confidence FROM feats), req AS (SELECT sel.*, presets.* EXCLUDE (preset) FROM sel JOIN presets USING (preset))""" + sql_guard("req", "script")
   + "SELECT video_id, shot_id, preset, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("confidence", "depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm")) + ", false AS manual_override FROM script")
def direct(spark, sf):
    frames, shots, spans, planes, stats = _parts(spark, sf)
    return _rounded(P.direct(P.extract_features(frames, planes, stats, shots, spans), D.edge_near_shots(planes), shots), SHOW)


def _script(shots):
    return X.with_preset(shots.select("video_id", "shot_id", F.get(F.array(*[F.lit(p) for p in R.PRESETS]), (C("shot_id") % 5).cast("int")).alias("preset")))


@q("render_frames")
def render_frames(spark, sf):
    frames, shots, _, planes, _ = _parts(spark, sf)
    r = P.render(frames, planes, shots, _script(shots), ref_width=F.lit(REF * 8))
    return r.select("video_id", "shot_id", "frame_index", F.posexplode_outer("mix").alias("i", "p")).select(
        "video_id", "shot_id", "frame_index", C("i").cast("bigint").alias("i"), "p.b", "p.g", "p.r")


@q("preview_frame")
def preview_frame(spark, sf):
    frames, shots, _, planes, _ = _parts(spark, sf)
    r = P.preview_frames(frames, planes, shots, _script(shots), 9, "basic", F.lit(REF * 8))
    return r.select("video_id", "shot_id", "frame_index", F.posexplode_outer("mix").alias("i", "p")).select(
        "video_id", "shot_id", "frame_index", C("i").cast("bigint").alias("i"), "p.b", "p.g", "p.r")


def _run(spark, sf):
    return P.run(*reel(spark, sf), ref_width=F.lit(REF * 8))


@q("final_with_qc")
def final_with_qc(spark, sf):
    s = _run(spark, sf)["shots"]
    return _rounded(s, ["video_id", "shot_id", "frame_count", "max_popout_disparity_norm", "max_background_disparity_norm", "edge_violation_pixels", "hole_pixels", "largest_hole_pixels", "depth_temporal_change"])


@q("run")
def run(spark, sf):
    r = _run(spark, sf)["report"].withColumn("warnings", F.array_join("warnings", "|"))
    return _rounded(r, [c for c, t in r.dtypes])


@q("incremental_run", """WITH v AS (SELECT DISTINCT CAST(label % 2 AS BIGINT) AS video_id FROM embeddings), s(stage) AS (VALUES ('shots'), ('depth'), ('features'), ('direct'))
   SELECT 1 AS round, video_id, stage, 'never_run' AS reason FROM v, s
   UNION ALL SELECT 3, 0, stage, 'input_changed' FROM s WHERE stage IN ('features', 'direct') AND EXISTS (FROM v WHERE video_id = 0)
   UNION ALL SELECT 4, video_id, 'direct', 'forced' FROM v""")
def incremental_run(spark, sf):
    """Four rounds over the same frames: all new, nothing changed, other speech in one video, one stage forced."""
    frames, _, spans = reel(spark, sf)
    frames, spans = A.materialize(frames), A.materialize(spans)
    project = PJ.Project(spark, f"{A.shared_folder(spark)}/project-{uuid.uuid4().hex}")
    more = spans.withColumn("end_s", C("end_s") + F.when(C("video_id") == 0, 0.5).otherwise(0.0))
    rounds = [(spans, ()), (spans, ()), (more, ()), (more, ("direct",))]
    out = None
    for n, (speech, force) in enumerate(rounds, 1):
        ran = project.update(frames, speech, "direct", force, threshold=9.0, min_gap=5).withColumn("round", F.lit(n))
        out = ran if out is None else out.unionByName(ran)
    return out.select("round", "video_id", "stage", "reason")
