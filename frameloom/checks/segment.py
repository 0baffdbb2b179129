"""Registered queries and their SQL: segmentation, sampling, interval joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import MIN_GAP, PLANE_GAP, PLANE_THRESHOLD, SQL_FRAMES, SQL_GRAY, THRESHOLD, frame_counts, frame_series, gray_series
from ..operators import segment as seg
from ..operators.ordered import r6


def _bounds(f):
    return seg.shot_boundaries(seg.frame_diff(f), THRESHOLD, MIN_GAP)


def shots_of(spark, sf, f=None):
    f = frame_series(spark, sf) if f is None else f
    return seg.detect_shots(f, frame_counts(spark, sf), THRESHOLD, MIN_GAP, 24.0,
                            F.col("event_type") == "signup")


SQL_SHOTS = f"""{SQL_FRAMES},
scored AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY frame_index)) AS score FROM frames),
cand AS (SELECT video_id, frame_index FROM scored WHERE score >= {THRESHOLD}),
cuts(video_id, frame_index) AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) FROM frames
  UNION ALL
  SELECT c.video_id, min(c.frame_index) FROM cuts b JOIN cand c ON c.video_id = b.video_id
    AND c.frame_index >= b.frame_index + {MIN_GAP} GROUP BY c.video_id, b.frame_index),
n AS (SELECT video_id, count(*) AS frame_count FROM frames GROUP BY 1),
gradual AS (SELECT video_id, frame_index FROM frames WHERE event_type = 'signup'),
shots AS (SELECT video_id, frame_count,
  row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS shot_id, frame_index AS start_frame,
  coalesce(lead(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index), frame_count) - 1 AS end_frame,
  CASE WHEN frame_index = 0 THEN 'start' WHEN EXISTS (SELECT 1 FROM gradual g WHERE g.video_id = cuts.video_id
    AND g.frame_index = cuts.frame_index) THEN 'fade' ELSE 'cut' END AS transition
  FROM cuts JOIN n USING (video_id)),
owned AS (SELECT f.*, s.shot_id, s.transition, f.frame_index - s.start_frame AS pos FROM frames f JOIN shots s
  ON s.video_id = f.video_id AND f.frame_index BETWEEN s.start_frame AND s.end_frame)"""
W = "WITH RECURSIVE " + SQL_SHOTS
W += """,
plan AS (SELECT video_id, shot_id, start_frame, unnest(CASE WHEN end_frame - start_frame + 1 <= 12
   THEN range(start_frame, end_frame + 1)
   ELSE list_concat([start_frame + (k * (end_frame - start_frame - 1) + 2) // 5 for k in range(6)],
                    [start_frame + (k * (end_frame - start_frame - 1) + 2) // 5 + 1 for k in range(6)]) END) AS frame_index FROM shots)
"""

Q, S = {}, {}


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


@q("frame_diff", W + "SELECT video_id, frame_index, round(score, 6) + 0.0 AS score FROM scored")
def frame_diff(spark, sf):
    return seg.frame_diff(frame_series(spark, sf)).select("video_id", "frame_index", r6("score").alias("score"))


@q("shot_boundaries", W + "SELECT video_id, frame_index FROM cuts WHERE frame_index > 0")
def shot_boundaries(spark, sf):
    return _bounds(frame_series(spark, sf)).select("video_id", "frame_index")


P = f"""WITH RECURSIVE {SQL_GRAY},
cand AS (SELECT video_id, frame_index FROM changed WHERE score >= {PLANE_THRESHOLD}),
cuts(video_id, frame_index) AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) FROM changed
  UNION ALL SELECT c.video_id, min(c.frame_index) FROM cuts b JOIN cand c ON c.video_id = b.video_id
    AND c.frame_index >= b.frame_index + {PLANE_GAP} GROUP BY c.video_id, b.frame_index),
n AS (SELECT video_id, count(*) AS frame_count FROM changed GROUP BY 1)
"""


@q("plane_diff", P + "SELECT video_id, frame_index, round(score, 9) + 0.0 AS score FROM changed")
def plane_diff(spark, sf):
    """Mean absolute gray change of every frame's cells from the frame before."""
    return seg.frame_diff(gray_series(spark, sf), value="gray").select("video_id", "frame_index", (F.round("score", 9) + F.lit(0.0)).alias("score"))


@q("plane_shots", P + """SELECT video_id, row_number() OVER w AS shot_id, frame_index AS start_frame, coalesce(lead(frame_index) OVER w, frame_count) - 1 AS end_frame,
   CASE WHEN frame_index = 0 THEN 'start' ELSE 'cut' END AS transition FROM cuts JOIN n USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)""")
def plane_shots(spark, sf):
    """Shots found in the pictures themselves."""
    g = gray_series(spark, sf)
    counts = g.groupBy("video_id").agg(F.count(F.lit(1)).alias("frame_count"))
    return seg.detect_shots(g, counts, PLANE_THRESHOLD, PLANE_GAP, value="gray").select("video_id", "shot_id", "start_frame", "end_frame", "transition")


@q("shot_manifest", W + """SELECT video_id, shot_id, start_frame, end_frame, round(start_frame / 24.0, 6) AS start_time,
   round((end_frame + 1) / 24.0, 6) AS end_time, transition FROM shots""")
def shot_manifest(spark, sf):
    return shots_of(spark, sf).select(
        "video_id", "shot_id", "start_frame", "end_frame", r6("start_time").alias("start_time"),
        r6("end_time").alias("end_time"), "transition")


@q("assign_shots", W + "SELECT video_id, frame_index, shot_id FROM owned")
def assign_shots(spark, sf):
    f = frame_series(spark, sf)
    return seg.assign_shots(f, _bounds(f)).select("video_id", "frame_index", "shot_id")


@q("frame_to_shot", W + "SELECT video_id, frame_index, shot_id, transition FROM owned")
def frame_to_shot(spark, sf):
    f = frame_series(spark, sf)
    return seg.frame_to_shot(f, shots_of(spark, sf, f)).select("video_id", "frame_index", "shot_id", "transition")


@q("scan_frames", W + """SELECT video_id, shot_id, count(*) AS frames_read, max(end_frame - start_frame + 1) AS frames_expected,
   count(*) = max(end_frame - start_frame + 1) AS complete FROM owned JOIN shots USING (video_id, shot_id) GROUP BY 1, 2""")
def scan_frames(spark, sf):
    f = frame_series(spark, sf)
    return seg.scan_frames(f, shots_of(spark, sf, f))


@q("representative_frames", W + "SELECT DISTINCT video_id, shot_id, frame_index FROM plan")
def representative_frames(spark, sf):
    return seg.sample_plan(shots_of(spark, sf))


@q("scan_sampled", W + """SELECT DISTINCT p.video_id, p.shot_id, p.frame_index, f.value FROM plan p
   JOIN frames f USING (video_id, frame_index)""")
def scan_sampled(spark, sf):
    f = frame_series(spark, sf)
    return (seg.scan_sampled(f, seg.sample_plan(shots_of(spark, sf, f)))
            .select("video_id", "shot_id", "frame_index", "value"))


@q("sample_plan_problems", W + """, broken AS (SELECT DISTINCT video_id, shot_id, frame_index + CASE WHEN shot_id = 3 THEN 1000 ELSE 0 END AS frame_index
   FROM plan WHERE shot_id <> 2)
   SELECT video_id, shot_id, CASE WHEN lo IS NULL THEN 'missing' ELSE 'outside' END AS problem
   FROM shots LEFT JOIN (SELECT video_id, shot_id, min(frame_index) AS lo, max(frame_index) AS hi FROM broken GROUP BY 1, 2)
   USING (video_id, shot_id) WHERE lo IS NULL OR lo < start_frame OR hi > end_frame""")
def sample_plan_problems(spark, sf):
    s = shots_of(spark, sf)
    plan = seg.sample_plan(s).where("shot_id <> 2").withColumn(
        "frame_index", F.col("frame_index") + F.when(F.col("shot_id") == 3, 1000).otherwise(0))
    return seg.plan_problems(plan, s)


@q("frame_at", W + """SELECT s.video_id, s.shot_id, f.frame_index, f.value, round((f.frame_index + 0.5) / 24.0, 6) AS seek_seconds
   FROM shots s JOIN frames f ON f.video_id = s.video_id AND f.frame_index = least(s.start_frame + 7, s.end_frame)""")
def frame_at(spark, sf):
    from ..sources.frames import frame_at as at
    f = frame_series(spark, sf)
    return at(f, shots_of(spark, sf, f).withColumn("offset", F.lit(7)), 24.0).select(
        "video_id", "shot_id", "frame_index", "value", r6("seek_seconds").alias("seek_seconds"))


@q("even_sample", W + """, m AS (SELECT video_id, shot_id, end_frame - start_frame + 1 AS n, least(end_frame - start_frame + 1, 8) AS k,
   unnest(range(least(end_frame - start_frame + 1, 8))) AS i FROM shots)
   SELECT video_id, shot_id, CAST(CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN n - 1
     ELSE floor(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / greatest(k - 1, 1))) END AS BIGINT) AS pos FROM m""")
def even_sample(spark, sf):
    s = shots_of(spark, sf)
    return s.select("video_id", "shot_id", F.explode(seg.even_positions(
        F.col("end_frame") - F.col("start_frame") + 1, 8)).alias("pos"))


@q("collapse_ranges", W + """, c AS (SELECT video_id, frame_index, frame_index - row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS g
   FROM (SELECT DISTINCT video_id, frame_index FROM plan))
   SELECT video_id, min(frame_index) AS range_start, max(frame_index) AS range_end FROM c GROUP BY video_id, g""")
def collapse_ranges(spark, sf):
    plan = seg.sample_plan(shots_of(spark, sf))
    return seg.collapse_ranges(plan, ["video_id"], "frame_index")


@q("adjacent_pairs", W + """, d AS (SELECT DISTINCT p.video_id, p.shot_id, p.frame_index, f.value FROM plan p JOIN frames f USING (video_id, frame_index))
   SELECT a.video_id, a.shot_id, a.frame_index, round(abs(a.value - b.value), 6) + 0.0 AS change FROM d a JOIN d b ON a.video_id = b.video_id
   AND a.shot_id = b.shot_id AND a.frame_index = b.frame_index + 1""")
def adjacent_pairs(spark, sf):
    f = frame_series(spark, sf)
    s = seg.scan_sampled(f, seg.sample_plan(shots_of(spark, sf, f)))
    return seg.adjacent_pairs(s, ["video_id", "shot_id"], ["value"]).select(
        "video_id", "shot_id", "frame_index", r6(F.abs(F.col("value") - F.col("prev.value"))).alias("change"))


@q("previous_shot", W + """SELECT video_id, shot_id, lag(shot_id) OVER w AS previous_id, lag(end_frame) OVER w AS previous_end
   FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY shot_id)""")
def previous_shot(spark, sf):
    s = seg.previous_shot(shots_of(spark, sf), ["shot_id", "end_frame"])
    return s.select("video_id", "shot_id", F.col("prev.shot_id").alias("previous_id"),
                    F.col("prev.end_frame").alias("previous_end"))


@q("previous_shot_sparse", W + """SELECT video_id, shot_id * 700 AS shot_id, lag(shot_id) OVER w * 700 AS previous_id, lag(end_frame) OVER w AS previous_end
   FROM shots WHERE shot_id % 4 <> 2 WINDOW w AS (PARTITION BY video_id ORDER BY shot_id)""")
def previous_shot_sparse(spark, sf):
    """Shot numbers with gaps longer than a block."""
    s = shots_of(spark, sf).where("shot_id % 4 <> 2").withColumn("shot_id", F.col("shot_id") * 700)
    return seg.previous_shot(s, ["shot_id", "end_frame"]).select(
        "video_id", "shot_id", F.col("prev.shot_id").alias("previous_id"), F.col("prev.end_frame").alias("previous_end"))


@q("hard_cut_runs", W + """SELECT video_id, shot_id, CAST(sum(CASE WHEN transition <> 'fade' THEN 1 ELSE 0 END)
   OVER (PARTITION BY video_id ORDER BY shot_id) AS BIGINT) AS run_id FROM shots""")
def hard_cut_runs(spark, sf):
    return seg.hard_cut_runs(shots_of(spark, sf)).select("video_id", "shot_id", "run_id")


@q("draft_coverage", W + """SELECT video_id, shot_id, count(DISTINCT p.frame_index) AS sampled_frames,
   max(end_frame - s.start_frame + 1) AS total_frames FROM plan p JOIN shots s USING (video_id, shot_id) GROUP BY 1, 2""")
def draft_coverage(spark, sf):
    s = shots_of(spark, sf)
    return seg.draft_coverage(seg.sample_plan(s), s)


def _seconds(c):
    return (F.datediff(c, F.lit("2000-01-01")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            + F.extract(F.lit("SECOND"), F.col(c)).cast("double"))


SQL_SEC = """(date_diff('day', DATE '2000-01-01', CAST({0} AS DATE)) * 86400 + hour({0}) * 3600 + minute({0}) * 60 + microsecond({0}) / 1000000.0)"""


def timed_shots(spark, sf):
    """Shots whose times are the clock times of their first and last frame."""
    f = frame_series(spark, sf)
    t = seg.frame_to_shot(f, shots_of(spark, sf, f)).withColumn("t", _seconds("ts"))
    shots = t.groupBy("video_id", "shot_id").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"))
    spans = (f.where("event_type = 'click'").withColumn("start_s", _seconds("ts"))
             .select("video_id", "start_s", (F.col("start_s") + 60).alias("end_s")))
    return shots, spans


@q("speech_ratio", W + f""", t AS (SELECT *, {SQL_SEC.format('ts')} AS t FROM owned),
   sh AS (SELECT video_id, shot_id, min(t) AS a, max(t) AS b FROM t GROUP BY 1, 2),
   sp AS (SELECT video_id, t AS s, t + 60 AS e FROM t WHERE event_type = 'click')
   SELECT sh.video_id, sh.shot_id, round(least(1.0, greatest(0.0, coalesce(sum(CASE WHEN s IS NULL THEN 0.0 ELSE greatest(0.0, least(b, e) - greatest(a, s)) END), 0)
     / greatest(any_value(b - a), 1e-9))), 4) + 0.0 AS speech_ratio
   FROM sh LEFT JOIN sp ON sp.video_id = sh.video_id AND sp.s <= sh.b AND sp.e >= sh.a GROUP BY 1, 2""")
def speech_ratio(spark, sf):
    shots, spans = timed_shots(spark, sf)
    return seg.speech_ratio(shots, spans).select("video_id", "shot_id", (F.round("speech_ratio", 4) + F.lit(0.0)).alias("speech_ratio"))


@q("shot_at_time", W + """, h AS (SELECT f.video_id, f.event_id AS head_id, least(n.frame_count / 24.0, greatest(0.0, f.value / 40.0)) AS t
     FROM frames f JOIN n USING (video_id) WHERE event_type = 'view')
   SELECT h.video_id, h.head_id, s.shot_id, round(t, 6) + 0.0 AS t FROM h LEFT JOIN shots s ON s.video_id = h.video_id
     AND s.start_frame / 24.0 <= t AND t < (s.end_frame + 1) / 24.0""")
def shot_at_time(spark, sf):
    f = frame_series(spark, sf)
    heads = f.where("event_type = 'view'").select(
        "video_id", F.col("event_id").alias("head_id"), (F.col("value") / 40.0).alias("t"))
    return seg.shot_at_time(heads, shots_of(spark, sf, f)).select("video_id", "head_id", "shot_id", r6("t").alias("t"))
