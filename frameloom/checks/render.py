"""Registered queries and their SQL: frame features, rendering."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SQL_COLOUR, colour_frames, frame_series
from ..functions import grid as G
from ..functions import rules as R
from ..functions import stereo as T
from ..functions.pixels import narrowed
from ..operators import direct as X
from ..operators import features as FE
from ..operators import render as V
from ..operators.ordered import r6
from . import segment as SEG
from .depth import long_form
from .direct import SQL_PRESETS

Q, S = {}, {}
C = "WITH RECURSIVE " + SQL_COLOUR
REF = 128.0
KEYS = ["video_id", "shot_id", "frame_index"]


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


SQL_LUMA = """, lm AS (SELECT video_id, shot_id, frame_index, y, x, (0.114 * b + 0.587 * g + 0.299 * r) / 255.0 AS l FROM cx),
 sc AS (SELECT a.video_id, a.shot_id, a.frame_index, avg(abs(a.l - p.l)) AS score FROM lm a JOIN lm p ON (a.video_id, a.shot_id, a.y, a.x) = (p.video_id, p.shot_id, p.y, p.x)
   AND p.frame_index = a.frame_index - 1 GROUP BY 1, 2, 3),
 mo AS (SELECT video_id, shot_id, least(1.0, greatest(0.0, quantile_cont(score, 0.75) / 0.18)) AS motion_score FROM sc GROUP BY 1, 2),
 cnt AS (SELECT video_id, shot_id, max(frame_index) + 1 AS n FROM planes GROUP BY 1, 2)"""
SQL_EVEN = """CAST(CASE WHEN k = 1 THEN 0 WHEN i = k - 1 THEN m - 1 ELSE floor(CAST(i AS DOUBLE) * (CAST(m - 1 AS DOUBLE) / greatest(k - 1, 1))) END AS BIGINT)"""
SQL_MATCH = f""", pk AS (SELECT video_id, shot_id, {SQL_EVEN} AS f FROM (SELECT video_id, shot_id, n - 1 AS m, least(n - 1, 8) AS k, unnest(range(least(n - 1, 8))) AS i FROM cnt)),
 er AS (SELECT a.video_id, a.shot_id, a.frame_index, dy, dx, round(avg(abs(a.l - c.l)), 9) AS e FROM pk JOIN lm a ON (a.video_id, a.shot_id, a.frame_index) = (pk.video_id, pk.shot_id, pk.f)
   CROSS JOIN (SELECT unnest(range(-3, 4)) AS dy) CROSS JOIN (SELECT unnest(range(-3, 4)) AS dx)
   JOIN lm c ON (c.video_id, c.shot_id) = (a.video_id, a.shot_id) AND c.frame_index = a.frame_index + 1 AND c.y = a.y - dy AND c.x = a.x - dx GROUP BY 1, 2, 3, 4, 5),
 tr AS (SELECT video_id, shot_id, frame_index, dx, dy FROM (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id, frame_index ORDER BY e, dy, dx) AS rn FROM er) WHERE rn = 1)"""


@q("motion_score", C + SQL_LUMA + "SELECT video_id, shot_id, round(motion_score, 6) + 0.0 AS motion_score FROM mo")
def motion_score(spark, sf):
    return FE.motion_score(colour_frames(spark, sf)).withColumn("motion_score", r6("motion_score"))


@q("block_match", C + SQL_LUMA + SQL_MATCH + "SELECT video_id, shot_id, frame_index, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM tr")
def block_match(spark, sf):
    return FE.sampled_translations(colour_frames(spark, sf))


@q("camera_movement", C + SQL_LUMA + SQL_MATCH + """, av AS (SELECT video_id, shot_id, avg(dx) AS mx, avg(dy) AS my FROM tr GROUP BY 1, 2),
  dv AS (SELECT video_id, shot_id, any_value(mx) AS mx, any_value(my) AS my, round(avg(sqrt(pow(dx - mx, 2) + pow(dy - my, 2))), 9) AS d, round(any_value(sqrt(mx * mx + my * my)), 9) AS g FROM tr JOIN av USING (video_id, shot_id) GROUP BY 1, 2)
  SELECT video_id, shot_id, CASE WHEN motion_score < 0.08 THEN 'static' WHEN d > greatest(1.5, g * 1.2) OR motion_score > 0.82 THEN 'unstable' WHEN g < 0.6 THEN 'unstable'
   WHEN abs(mx) > abs(my) * 1.4 THEN 'lateral' WHEN abs(my) > abs(mx) * 1.4 THEN 'vertical' ELSE 'unstable' END AS camera_movement FROM mo LEFT JOIN dv USING (video_id, shot_id)""")
def camera_movement(spark, sf):
    f = colour_frames(spark, sf)
    return FE.camera_movement(FE.sampled_translations(f), FE.motion_score(f)).select("video_id", "shot_id", "camera_movement")


@q("brightness", C + SQL_LUMA + f""", pk AS (SELECT video_id, shot_id, {SQL_EVEN} AS f FROM (SELECT video_id, shot_id, n AS m, least(n, 12) AS k, unnest(range(least(n, 12))) AS i FROM cnt))
  SELECT video_id, shot_id, round(avg(m) / 255.0, 6) + 0.0 AS brightness FROM (SELECT c.video_id, c.shot_id, c.frame_index, avg((b + g + r) / 3.0) AS m
   FROM cx c JOIN pk ON (c.video_id, c.shot_id, c.frame_index) = (pk.video_id, pk.shot_id, pk.f) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def brightness(spark, sf):
    return FE.brightness(colour_frames(spark, sf)).withColumn("brightness", r6("brightness"))


def staged(spark, sf):
    """Colour frames with unit depth and strong parameters that differ per shot."""
    s = F.col("shot_id")
    f = colour_frames(spark, sf)
    return f.withColumn("z", F.transform("z", lambda v: G.clamp(v.cast("double") * 1.5 + 0.5, 0, 1))).withColumns({
        "depth_strength": s * 0.1 + 0.5, "convergence_depth_percentile": s * 0.05 + 0.3, "max_background_disparity_norm": F.lit(0.05),
        "max_popout_disparity_norm": F.lit(0.03), "edge_protection": s % 2 == 0})


SQL_STAGE = """, u AS (SELECT *, least(1.0, greatest(0.0, z * 1.5 + 0.5)) AS zz, shot_id * CAST(0.1 AS DOUBLE) + 0.5 AS st, shot_id * CAST(0.05 AS DOUBLE) + 0.3 AS lv FROM cx),
 srt AS (SELECT video_id, shot_id, frame_index, list_sort(list(zz)) AS l, any_value(lv) * 63 AS pos FROM u GROUP BY 1, 2, 3),
 cv AS (SELECT video_id, shot_id, frame_index, l[CAST(floor(pos) AS BIGINT) + 1] + (l[CAST(ceil(pos) AS BIGINT) + 1] - l[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos)) AS conv FROM srt),
 d0 AS (SELECT u.*, conv, least(0.03, greatest(-0.05, st * (least(1.0, greatest(0.0, (zz - conv) / greatest(1 - conv, 1e-6))) * 0.03
    + least(0.0, greatest(-1.0, (zz - conv) / greatest(conv, 1e-6))) * 0.05))) AS raw FROM u JOIN cv USING (video_id, shot_id, frame_index)),
 dp AS (SELECT *, CASE WHEN raw > 0 AND shot_id % 2 = 0 AND x IN (0, 7) THEN 0.0 ELSE raw END AS d FROM d0)"""
SQL_SPLAT = """, tg AS (SELECT *, side, round_even(x + d * 128.0 * side * 0.5, 0) AS tx FROM dp, (VALUES (1), (-1)) v(side)),
 wn AS (SELECT video_id, shot_id, frame_index, side, y, CAST(tx AS BIGINT) AS x, i AS src, b, g, r FROM (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id, frame_index, side, y, tx ORDER BY zz DESC, i) AS rn
   FROM tg WHERE tx >= 0 AND tx < 8) WHERE rn = 1),
 gr AS (SELECT p.video_id, p.shot_id, p.frame_index, v.side, p.y, p.x, src, w.b, w.g, w.r FROM px p CROSS JOIN (VALUES (1), (-1)) v(side)
   LEFT JOIN wn w ON (w.video_id, w.shot_id, w.frame_index, w.side, w.y, w.x) = (p.video_id, p.shot_id, p.frame_index, v.side, p.y, p.x))"""


def sql_fill(widest):
    ch = lambda c: f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN (lx IS NULL AND rx IS NULL) OR run > {widest} THEN 0.0 WHEN lx IS NULL THEN r{c} WHEN rx IS NULL THEN l{c}
      ELSE floor(least(CAST(255 AS FLOAT), greatest(CAST(0 AS FLOAT), CAST(l{c} AS FLOAT) * CAST(1.0 - t AS FLOAT) + CAST(r{c} AS FLOAT) * CAST(t AS FLOAT)))) END AS {c}"""  # noqa: E731
    return f""", nbr AS (SELECT *, last_value(CASE WHEN src IS NOT NULL THEN x END IGNORE NULLS) OVER l AS lx, first_value(CASE WHEN src IS NOT NULL THEN x END IGNORE NULLS) OVER r AS rx,
   {", ".join(f"last_value({c} IGNORE NULLS) OVER l AS l{c}, first_value({c} IGNORE NULLS) OVER r AS r{c}" for c in "bgr")} FROM gr
   WINDOW l AS (PARTITION BY video_id, shot_id, frame_index, side, y ORDER BY x ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY video_id, shot_id, frame_index, side, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 wt AS (SELECT *, coalesce(rx, 8) - coalesce(lx, -1) - 1 AS run, CAST(x - coalesce(lx, -1) AS DOUBLE) / (coalesce(rx, 8) - coalesce(lx, -1)) AS t FROM nbr),
 fl AS (SELECT video_id, shot_id, frame_index, side, y, x, src IS NULL AS bare, src IS NULL AND ((lx IS NULL AND rx IS NULL) OR run > {widest}) AS hole, {ch('b')}, {ch('g')}, {ch('r')} FROM wt)"""


@q("frame_percentile", C + SQL_STAGE + "SELECT video_id, shot_id, frame_index, round(conv, 6) + 0.0 AS conv FROM cv")
def frame_percentile(spark, sf):
    return V.with_disparity(staged(spark, sf), F.lit(REF)).select("video_id", "shot_id", "frame_index", r6("conv").alias("conv"))


@q("disparity", C + SQL_STAGE + "SELECT video_id, shot_id, frame_index, i, round(d, 6) + 0.0 AS d FROM dp")
def disparity(spark, sf):
    return long_form(V.with_disparity(staged(spark, sf), F.lit(REF)), "disparity", "d")


@q("edge_violation_mask", C + SQL_STAGE + "SELECT video_id, shot_id, frame_index, i FROM dp WHERE (x < 2 OR x >= 6) AND d > 0.002")
def edge_violation_mask(spark, sf):
    f = V.edge_violation_mask(V.with_disparity(staged(spark, sf), F.lit(REF)), 0.25, 0.002)
    return f.select("video_id", "shot_id", "frame_index", F.posexplode_outer("edge_mask").alias("i", "_m")).where("_m").select(
        "video_id", "shot_id", "frame_index", F.col("i").cast("bigint").alias("i"))


@q("splat", C + SQL_STAGE + SQL_SPLAT + """SELECT video_id, shot_id, frame_index, y * 8 + x AS i, max(coalesce(src, -1)) FILTER (side = 1) AS left_src,
   max(coalesce(src, -1)) FILTER (side = -1) AS right_src FROM gr GROUP BY 1, 2, 3, 4""")
def splat(spark, sf):
    f = narrowed(V.splat(V.with_disparity(staged(spark, sf), F.lit(REF))), [*KEYS, "left_src", "right_src"])
    return f.select("video_id", "shot_id", "frame_index", F.posexplode_outer(F.arrays_zip("left_src", "right_src")).alias("i", "_s")).select(
        "video_id", "shot_id", "frame_index", F.col("i").cast("bigint").alias("i"), "_s.left_src", "_s.right_src")


@q("fill_gaps", C + SQL_STAGE + SQL_SPLAT + sql_fill(2) + "SELECT video_id, shot_id, frame_index, y * 8 + x AS i, b, g, r, hole FROM fl WHERE side = 1")
def fill_gaps(spark, sf):
    f = narrowed(V.fill_gaps(V.splat(V.with_disparity(staged(spark, sf), F.lit(REF))), 2), [*KEYS, "left_b", "left_g", "left_r", "left_hole"])
    z = F.arrays_zip("left_b", "left_g", "left_r", "left_hole")
    return f.select("video_id", "shot_id", "frame_index", F.posexplode_outer(z).alias("i", "_s")).select(
        "video_id", "shot_id", "frame_index", F.col("i").cast("bigint").alias("i"), F.col("_s.left_b").alias("b"),
        F.col("_s.left_g").alias("g"), F.col("_s.left_r").alias("r"), F.col("_s.left_hole").alias("hole"))


SQL_VIEWS = SQL_STAGE + SQL_SPLAT + sql_fill(16)


def rendered(spark, sf, mode="calibrated"):
    return V.render_frames(staged(spark, sf), F.lit(REF), mode)


@q("hole_union", C + SQL_VIEWS + "SELECT video_id, shot_id, frame_index, y * 8 + x AS i FROM fl GROUP BY 1, 2, 3, 4 HAVING bool_or(bare OR hole)")
def hole_union(spark, sf):
    f = narrowed(V.hole_union(V.fill_gaps(V.splat(V.with_disparity(staged(spark, sf), F.lit(REF))))), [*KEYS, "holes"])
    return f.select("video_id", "shot_id", "frame_index", F.posexplode_outer("holes").alias("i", "_m")).where("_m").select(
        "video_id", "shot_id", "frame_index", F.col("i").cast("bigint").alias("i"))


def _mix_rows(df):
    return df.select("video_id", "shot_id", "frame_index", F.posexplode_outer("mix").alias("i", "_p")).select(
        "video_id", "shot_id", "frame_index", F.col("i").cast("bigint").alias("i"), "_p.b", "_p.g", "_p.r")


SQL_PAIR = """, pr AS (SELECT video_id, shot_id, frame_index, y, x, max(b) FILTER (side = 1) AS lb, max(g) FILTER (side = 1) AS lg, max(r) FILTER (side = 1) AS lr,
   max(b) FILTER (side = -1) AS rb, max(g) FILTER (side = -1) AS rg, max(r) FILTER (side = -1) AS rr FROM fl GROUP BY 1, 2, 3, 4, 5)"""


@q("anaglyph_basic", C + SQL_VIEWS + SQL_PAIR + "SELECT video_id, shot_id, frame_index, y * 8 + x AS i, rb AS b, rg AS g, lr AS r FROM pr")
def anaglyph_basic(spark, sf):
    return _mix_rows(narrowed(rendered(spark, sf, "basic"), [*KEYS, "mix"]))


def _sql_mix():
    lin = ", ".join(f"pow({s}{c} / 255.0, 2.2) * {(1 - T.LEAKAGE) if (s, c) in (('l', 'g'), ('l', 'b'), ('r', 'r')) else 1.0} AS {s}{c}" for s in "lr" for c in "rgb")
    soft = []
    for s in "lr":
        lum = "(" + " + ".join(f"{s}{c} * {k}" for c, k in zip("rgb", T.LUMINANCE)) + ")"
        soft += [f"({s}{c} - {lum}) * 0.9 + {lum} AS {s}{c}" for c in "rgb"]
    out = []
    for k, c in enumerate("rgb"):
        v = " + ".join([f"l{x} * ({m})" for x, m in zip("rgb", T.LEFT_MATRIX[k])] + [f"r{x} * ({m})" for x, m in zip("rgb", T.RIGHT_MATRIX[k])])
        out.append(f"round_even(pow(least(1.0, greatest(0.0, {v})), 1.0 / 2.2) * 255.0, 0) + 0.0 AS {c}")
    return f""", li AS (SELECT video_id, shot_id, frame_index, y, x, {lin} FROM pr), so AS (SELECT video_id, shot_id, frame_index, y, x, {", ".join(soft)} FROM li),
      mx AS (SELECT video_id, shot_id, frame_index, y * 8 + x AS i, {", ".join(out)} FROM so)"""


@q("anaglyph_calibrated", C + SQL_VIEWS + SQL_PAIR + _sql_mix() + "SELECT * FROM mx")
def anaglyph_calibrated(spark, sf):
    return _mix_rows(narrowed(rendered(spark, sf), [*KEYS, "mix"])).withColumns({c: F.col(c) + F.lit(0.0) for c in "bgr"})


@q("select_output", C + SQL_VIEWS + "SELECT video_id, shot_id, frame_index, y, CASE WHEN side = 1 THEN x ELSE x + 8 END AS x, b, g, r FROM fl")
def select_output(spark, sf):
    return V.select_output(rendered(spark, sf, "basic"), "side-by-side")


@q("ordered_output", "WITH " + SQL_COLOUR + """SELECT video_id, shot_id, frame_index, row_number() OVER (ORDER BY video_id, shot_id, frame_index) - 1 AS place FROM planes""")
def ordered_output(spark, sf):
    """Frames leave in order; the place is worked out from partition sizes, not in one task."""
    from ..operators.ordered import number_rows
    f = V.ordered_output(colour_frames(spark, sf)).select("video_id", "shot_id", "frame_index")
    return number_rows(f.withColumn("_k", F.lit(0)), ["_k"], ["video_id", "shot_id", "frame_index"],
                       [F.col("video_id"), F.col("shot_id"), F.floor(F.col("frame_index") / 1024)], "place").drop("_k")


NAMES = list(R.PRESETS)


@q("ease_parameters", "WITH RECURSIVE " + SEG.SQL_SHOTS + ", " + SQL_PRESETS + f""", nm(k, preset) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES))}),
  sp AS (SELECT s.video_id, s.shot_id, s.start_frame, s.end_frame, s.transition, p.*, lag(p.depth_strength) OVER w AS ps, lag(p.convergence_depth_percentile) OVER w AS pc, lag(p.max_background_disparity_norm) OVER w AS pb, lag(p.max_popout_disparity_norm) OVER w AS pp
    FROM shots s JOIN nm ON nm.k = s.shot_id % 5 JOIN presets p ON p.preset = nm.preset WINDOW w AS (PARTITION BY s.video_id ORDER BY s.shot_id)),
  fr AS (SELECT f.video_id, f.frame_index, sp.*, least(1.0, greatest(0.0, (1 - pow(temporal_smoothing, greatest(1, f.frame_index - start_frame + 1))) / greatest(1 - pow(temporal_smoothing, transition_frames), 1e-9))) AS bl,
     f.frame_index - start_frame < transition_frames AND transition = 'fade' AND ps IS NOT NULL AS fading FROM frames f JOIN sp ON sp.video_id = f.video_id AND f.frame_index BETWEEN start_frame AND end_frame)
  SELECT video_id, frame_index, shot_id, {", ".join(f"round(CASE WHEN fading THEN {p} + ({n} - {p}) * bl ELSE {n} END, 6) + 0.0 AS {n}" for n, p in (("depth_strength", "ps"), ("convergence_depth_percentile", "pc"), ("max_background_disparity_norm", "pb"), ("max_popout_disparity_norm", "pp")))} FROM fr""")
def ease_parameters(spark, sf):
    f = frame_series(spark, sf)
    shots = SEG.shots_of(spark, sf, f)
    names = F.array(*[F.lit(n) for n in NAMES])
    script = X.with_preset(shots.select("video_id", "shot_id", F.get(names, (F.col("shot_id") % 5).cast("int")).alias("preset")))
    return V.ease_parameters(f, shots, script).select("video_id", "frame_index", "shot_id", *[r6(c).alias(c) for c in V.EASED])
