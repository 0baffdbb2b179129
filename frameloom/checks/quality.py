"""Registered queries and their SQL: quality checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pixels import narrowed
from ..operators import quality as K
from ..operators import render as V
from ..operators.ordered import r6
from .render import C, REF, SQL_VIEWS, rendered, staged

Q, S = {}, {}
KEYS = "video_id, shot_id, frame_index"


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


def sql_components(src, name, b=1):
    """Largest 4-connected region per frame, by reachability."""
    return f""", {name}_g AS (SELECT DISTINCT {KEYS}, y // {b} AS y, x // {b} AS x FROM {src}),
 {name}_r AS (SELECT {KEYS}, y * 8 + x AS s, y, x FROM {name}_g UNION SELECT r.video_id, r.shot_id, r.frame_index, r.s, g.y, g.x FROM {name}_r r
   JOIN {name}_g g ON (g.video_id, g.shot_id, g.frame_index) = (r.video_id, r.shot_id, r.frame_index) AND abs(g.y - r.y) + abs(g.x - r.x) = 1),
 {name} AS (SELECT {KEYS}, max(n) AS largest FROM (SELECT {KEYS}, s, count(*) AS n FROM {name}_r GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


HOLES = f", hl AS (SELECT {KEYS}, y, x FROM fl GROUP BY ALL HAVING bool_or(bare OR hole))"


def _holes(spark, sf):
    return V.hole_union(V.fill_gaps(V.splat(V.with_disparity(staged(spark, sf), F.lit(REF)))))


@q("largest_component", C + SQL_VIEWS + HOLES + sql_components("hl", "lc") + f"SELECT {KEYS}, coalesce(largest, 0) AS largest FROM planes LEFT JOIN lc USING ({KEYS})")
def largest_component(spark, sf):
    return narrowed(K.largest_component(_holes(spark, sf), "holes"), ["video_id", "shot_id", "frame_index", "largest"])


@q("largest_component_bound", C + SQL_VIEWS + HOLES + sql_components("hl", "lc", 2) + f""", hc AS (SELECT {KEYS}, count(*) AS n FROM hl GROUP BY ALL)
   SELECT {KEYS}, coalesce(least(n, largest * 4), 0) AS largest FROM planes LEFT JOIN lc USING ({KEYS}) LEFT JOIN hc USING ({KEYS})""")
def largest_component_bound(spark, sf):
    return narrowed(K.largest_component(_holes(spark, sf), "holes", max_cells=16), ["video_id", "shot_id", "frame_index", "largest"])


SQL_QC = SQL_VIEWS + HOLES + sql_components("hl", "lc") + f""", hc AS (SELECT {KEYS}, count(*) AS n FROM hl GROUP BY ALL),
 tc AS (SELECT {KEYS}, avg(c) AS c FROM (SELECT {KEYS}, abs(zz - lag(zz) OVER (PARTITION BY video_id, shot_id, i ORDER BY frame_index)) AS c FROM dp) GROUP BY ALL),
 fq AS (SELECT {KEYS}, greatest(0.0, max(d)) AS max_popout_disparity_norm, greatest(0.0, -min(d)) AS max_background_disparity_norm, count(*) FILTER ((x < 1 OR x >= 7) AND d > 0.002) AS edge_violation_pixels,
   any_value(coalesce(n, 0)) AS hole_pixels, any_value(coalesce(largest, 0)) AS largest_hole_pixels, any_value(c) AS change FROM dp LEFT JOIN hc USING ({KEYS}) LEFT JOIN lc USING ({KEYS}) LEFT JOIN tc USING ({KEYS}) GROUP BY ALL),
 sq AS (SELECT video_id, shot_id, count(*) AS frame_count, max(max_popout_disparity_norm) AS max_popout_disparity_norm, max(max_background_disparity_norm) AS max_background_disparity_norm, CAST(sum(edge_violation_pixels) AS BIGINT) AS edge_violation_pixels,
   CAST(sum(hole_pixels) AS BIGINT) AS hole_pixels, max(largest_hole_pixels) AS largest_hole_pixels, coalesce(avg(change), 0.0) AS change FROM fq GROUP BY 1, 2)"""


@q("frame_qc", C + SQL_QC + f"""SELECT {KEYS}, round(max_popout_disparity_norm, 6) + 0.0 AS max_popout_disparity_norm, round(max_background_disparity_norm, 6) + 0.0 AS max_background_disparity_norm, edge_violation_pixels, hole_pixels,
  largest_hole_pixels, round(coalesce(change, 0.0), 6) + 0.0 AS depth_temporal_change FROM fq""")
def frame_qc(spark, sf):
    f = K.frame_qc(rendered(spark, sf))
    return f.withColumns({"max_popout_disparity_norm": r6("max_popout_disparity_norm"), "max_background_disparity_norm": r6("max_background_disparity_norm"),
                          "depth_temporal_change": r6(F.coalesce("depth_temporal_change", F.lit(0.0)))})


@q("shot_qc", C + SQL_QC + """SELECT video_id, shot_id, frame_count, round(max_popout_disparity_norm, 6) + 0.0 AS max_popout_disparity_norm, round(max_background_disparity_norm, 6) + 0.0 AS max_background_disparity_norm, edge_violation_pixels, hole_pixels,
  largest_hole_pixels, round(change, 6) + 0.0 AS depth_temporal_change, CASE WHEN shot_id % 3 = 0 THEN 'popout_clamped' ELSE '' END AS comfort_overrides, shot_id % 4 = 0 AS fallback_used FROM sq""")
def shot_qc(spark, sf):
    s = _shot_rows(spark, sf)
    return s.select("video_id", "shot_id", "frame_count", r6("max_popout_disparity_norm").alias("max_popout_disparity_norm"), r6("max_background_disparity_norm").alias("max_background_disparity_norm"),
                    "edge_violation_pixels", "hole_pixels", "largest_hole_pixels", r6("depth_temporal_change").alias("depth_temporal_change"),
                    F.array_join("comfort_overrides", ",").alias("comfort_overrides"), "fallback_used")


def _shot_rows(spark, sf):
    f = rendered(spark, sf)
    shots = f.select("video_id", "shot_id").distinct()
    none = F.array().cast("array<struct<code:string>>")
    script = shots.withColumn("guard_actions", F.when(F.col("shot_id") % 3 == 0, F.array(F.struct(F.lit("popout_clamped").alias("code")))).otherwise(none))
    meta = shots.withColumns({"fallback_used": F.col("shot_id") % 4 == 0, "error_code": F.when(F.col("shot_id") % 5 == 0, "depth_failed")})
    return K.with_actions(K.shot_qc(K.frame_qc(f)), script, meta)


@q("disparity_histogram", C + SQL_VIEWS + """, bn AS (SELECT k, CAST(-0.05 AS DOUBLE) + k * (CAST(0.1 AS DOUBLE) / 40) AS lo, CASE WHEN k = 39 THEN CAST(0.05 AS DOUBLE) ELSE CAST(-0.05 AS DOUBLE) + (k + 1) * (CAST(0.1 AS DOUBLE) / 40) END AS hi FROM (SELECT unnest(range(40)) AS k))
   SELECT v.video_id, k AS bin, count(d) AS n FROM (SELECT DISTINCT video_id FROM planes) v CROSS JOIN bn LEFT JOIN dp ON dp.video_id = v.video_id AND d >= lo AND (d < hi OR (k = 39 AND d <= hi)) GROUP BY 1, 2""")
def disparity_histogram(spark, sf):
    return K.disparity_histogram(V.with_disparity(staged(spark, sf), F.lit(REF)))


def _media(spark, sf):
    from ..fixtures import depth_planes
    v = F.col("video_id")
    return depth_planes(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("rendered_frames")).select(
        "video_id", "rendered_frames", (F.col("rendered_frames") + v * 3).alias("expected_frames"), v.alias("duplicated_frames"),
        (F.col("rendered_frames") / 24.0 + v * 0.06).alias("audio_seconds"), (F.col("rendered_frames") / 24.0).alias("video_seconds"), (v == 1).alias("synthetic"))


SQL_REPORT = SQL_QC + """, md AS (SELECT video_id, count(*) AS rendered, count(*) + video_id * 3 AS expected FROM planes GROUP BY video_id),
 tt AS (SELECT video_id, max(max_popout_disparity_norm) AS max_popout_disparity_norm, max(max_background_disparity_norm) AS max_background_disparity_norm, CAST(sum(edge_violation_pixels) AS BIGINT) AS edge_violations, CAST(sum(hole_pixels) AS BIGINT) AS hole_pixels, max(largest_hole_pixels) AS largest_hole_pixels,
  sum(change * frame_count) / sum(frame_count) AS change, count(*) FILTER (shot_id % 3 = 0) AS ov, count(*) FILTER (shot_id % 4 = 0) AS fb, count(*) FILTER (shot_id % 5 = 0) AS fa FROM sq GROUP BY 1),
 rp AS (SELECT tt.*, rendered, expected, [x for x in [CASE WHEN expected > rendered THEN (expected - rendered) || ' expected frames were not rendered' END, CASE WHEN video_id > 0 THEN video_id || ' duplicated frames were detected' END,
   CASE WHEN video_id * 0.06 > 0.05 THEN 'Audio/video duration differs by more than 50 ms' END, CASE WHEN edge_violations > 0 THEN 'Potential stereo window-edge violations were detected' END,
   CASE WHEN largest_hole_pixels > 256 THEN 'Large disocclusion holes remain in one or more shots' END, CASE WHEN video_id = 1 THEN 'Render used synthetic demo depth and is not a production deliverable' END] if x IS NOT NULL] AS warnings FROM tt JOIN md USING (video_id))"""


@q("qc_report", C + SQL_REPORT + """SELECT video_id, rendered AS frame_count, expected AS expected_frames, expected - rendered AS dropped_frames, video_id AS duplicated_frames, round(CAST(video_id * 0.06 AS DOUBLE), 6) + 0.0 AS audio_video_difference,
  round(max_popout_disparity_norm, 6) + 0.0 AS max_popout_disparity_norm, round(max_background_disparity_norm, 6) + 0.0 AS max_background_disparity_norm, edge_violations, hole_pixels, largest_hole_pixels, round(change, 6) + 0.0 AS depth_temporal_change,
  ov AS shots_with_overrides, fb AS shots_using_fallback, fa AS depth_failures, array_to_string(warnings, '|') AS warnings FROM rp""")
def qc_report(spark, sf):
    r = K.qc_report(_shot_rows(spark, sf), _media(spark, sf))
    return r.withColumns({c: r6(c) for c in ("audio_video_difference", "max_popout_disparity_norm", "max_background_disparity_norm", "depth_temporal_change")}).withColumn(
        "warnings", F.array_join("warnings", "|"))


@q("qc_html", C + SQL_REPORT + """, ln AS (SELECT video_id, shot_id, '<tr><td>' || shot_id || '</td><td>' || frame_count || '</td><td>' || printf('%.4f', round_even(max_popout_disparity_norm, 4)) || '</td><td>' || printf('%.4f', round_even(max_background_disparity_norm, 4))
   || '</td><td>' || edge_violation_pixels || '</td><td>' || hole_pixels || '</td></tr>' AS line FROM sq)
  SELECT video_id, 0 AS part, '<h1>Quality-control report</h1><p>Rendered ' || rendered || ' of ' || expected || ' expected frames.</p><ul class="warning">' ||
    coalesce(array_to_string([('<li>' || replace(replace(w, '&', '&amp;'), '<', '&lt;') || '</li>') for w in warnings], ''), '') ||
    '</ul><table><tr><th>Shot</th><th>Frames</th><th>Max pop-out</th><th>Max background</th><th>Edge pixels</th><th>Hole pixels</th></tr>' AS html FROM rp
  UNION ALL SELECT video_id, 1 + shot_id // 1024, string_agg(line, '' ORDER BY shot_id) FROM ln GROUP BY 1, 2 UNION ALL SELECT video_id, 4611686018427387904, '</table>' FROM rp""")
def qc_html(spark, sf):
    s = _shot_rows(spark, sf)
    return K.qc_html(s, K.qc_report(s, _media(spark, sf)))


