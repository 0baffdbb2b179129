"""Registered queries and their SQL: depth grids."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SQL_COLOUR, SQL_PLANES, colour_frames, depth_planes
from ..functions import grid as G
from ..operators import depth as D
from ..operators.ordered import r6

Q, S = {}, {}
P = "WITH RECURSIVE " + SQL_PLANES
C = "WITH RECURSIVE " + SQL_COLOUR


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


def raw_planes(spark, sf):
    """Planes with holes: cells above 0.3 count as invalid."""
    return depth_planes(spark, sf).withColumn("z", F.transform("z", lambda v: F.when(
        v.cast("double") > 0.3, float("nan")).otherwise(v.cast("double"))))


def unit_planes(spark, sf):
    return depth_planes(spark, sf).withColumn(
        "z", F.transform("z", lambda v: G.clamp(v.cast("double") * 1.5 + 0.5, 0, 1)))


SQL_UNIT = """, u AS (SELECT video_id, shot_id, frame_index, y, x, i, least(1.0, greatest(0.0, z * 1.5 + 0.5)) AS z FROM px)"""
SQL_NORM = """,
raw AS (SELECT video_id, shot_id, frame_index, y, x, CASE WHEN z > 0.3 THEN NULL ELSE z END AS z FROM px),
st AS (SELECT video_id, shot_id, quantile_cont(z, 0.5) AS median, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi,
  min(z) AS raw_min, max(z) AS raw_max, 1 - count(z) / count(*) AS invalid FROM raw GROUP BY 1, 2),
nz AS (SELECT video_id, shot_id, frame_index, y, x, CASE WHEN hi - lo <= greatest(abs(hi), 1.0) * 1e-7 THEN 0.5
  ELSE least(1.0, greatest(0.0, (coalesce(z, median) - lo) / (hi - lo))) END AS v FROM raw JOIN st USING (video_id, shot_id)),
nb AS (SELECT *, coalesce(lag(v) OVER r, v) AS l, coalesce(lead(v) OVER r, v) AS rr, coalesce(lag(v) OVER c, v) AS t, coalesce(lead(v) OVER c, v) AS bb
  FROM nz WINDOW r AS (PARTITION BY video_id, shot_id, frame_index, y ORDER BY x), c AS (PARTITION BY video_id, shot_id, frame_index, x ORDER BY y)),
sm AS (SELECT video_id, shot_id, frame_index, y, x, v * 0.85 + 0.15 * (v + l * exp(-abs(l - v) / 0.08) + rr * exp(-abs(rr - v) / 0.08)
   + t * exp(-abs(t - v) / 0.08) + bb * exp(-abs(bb - v) / 0.08)) / (1 + exp(-abs(l - v) / 0.08) + exp(-abs(rr - v) / 0.08)
   + exp(-abs(t - v) / 0.08) + exp(-abs(bb - v) / 0.08)) AS v FROM nb)"""
SQL_EMA = """,
ema(video_id, shot_id, frame_index, y, x, v) AS (SELECT video_id, shot_id, frame_index, y, x, v FROM sm WHERE frame_index = 0
  UNION ALL SELECT s.video_id, s.shot_id, s.frame_index, s.y, s.x, 0.82 * e.v + (1 - 0.82) * s.v FROM ema e JOIN sm s
  ON s.video_id = e.video_id AND s.shot_id = e.shot_id AND s.y = e.y AND s.x = e.x AND s.frame_index = e.frame_index + 1)"""


def long_form(df, z="z", name="z"):
    return df.select("video_id", "shot_id", "frame_index", F.posexplode_outer(z).alias("i", "_v")).select(
        "video_id", "shot_id", "frame_index", F.col("i").cast("bigint").alias("i"), r6(F.col("_v").cast("double")).alias(name))


@q("depth_norm_stats", P + SQL_NORM + """SELECT video_id, shot_id, round(median, 6) + 0.0 AS median, round(lo, 6) + 0.0 AS clip_lower,
  round(hi, 6) + 0.0 AS clip_upper, round(raw_min, 6) + 0.0 AS raw_min, round(raw_max, 6) + 0.0 AS raw_max, round(invalid, 6) + 0.0 AS invalid_fraction,
  round(CASE WHEN hi - lo <= greatest(abs(hi), 1.0) * 1e-7 THEN 0.0 ELSE least(1.0, greatest(0.0, 1 - 2 * invalid)) END, 6) + 0.0 AS reliability FROM st""")
def depth_norm_stats(spark, sf):
    s = D.norm_stats(raw_planes(spark, sf))
    return s.select("video_id", "shot_id", *[r6(c).alias(c) for c in (
        "median", "clip_lower", "clip_upper", "raw_min", "raw_max", "invalid_fraction", "reliability")])


@q("normalize_depth", P + SQL_NORM + "SELECT video_id, shot_id, frame_index, y * 8 + x AS i, round(v, 6) + 0.0 AS z FROM nz")
def normalize_depth(spark, sf):
    p = raw_planes(spark, sf)
    return long_form(D.normalize(p, D.norm_stats(p)))


@q("edge_aware_smooth", P + SQL_UNIT + ", nz AS (SELECT video_id, shot_id, frame_index, y, x, z AS v FROM u)" + SQL_NORM[SQL_NORM.index(",\nnb AS"):]
   + "SELECT video_id, shot_id, frame_index, y * 8 + x AS i, round(v, 6) + 0.0 AS z FROM sm")
def edge_aware_smooth(spark, sf):
    return long_form(D.smooth_space(unit_planes(spark, sf)))


@q("temporal_ema", P + SQL_UNIT + ", sm AS (SELECT video_id, shot_id, frame_index, y, x, z AS v FROM u WHERE frame_index >= shot_id % 3)"
   + SQL_EMA.replace("frame_index = 0", "frame_index = shot_id % 3") + "SELECT video_id, shot_id, frame_index, y * 8 + x AS i, round(v, 6) + 0.0 AS z FROM ema")
def temporal_ema(spark, sf):
    """The first planes of some shots are absent; smoothing starts at the first present one."""
    return long_form(D.smooth_time(unit_planes(spark, sf).where("frame_index >= shot_id % 3"), block=16, fan=4))


@q("estimate_depth", P + SQL_NORM + SQL_EMA + "SELECT video_id, shot_id, frame_index, y * 8 + x AS i, round(v, 6) + 0.0 AS z FROM ema")
def estimate_depth(spark, sf):
    return long_form(D.estimate_depth(raw_planes(spark, sf))[0])


@q("temporal_change", P + """, d AS (SELECT video_id, shot_id, frame_index, abs(z - lag(z) OVER (PARTITION BY video_id, shot_id, i ORDER BY frame_index)) AS d FROM px)
  SELECT video_id, shot_id, frame_index, round(coalesce(avg(d), 0), 6) + 0.0 AS change FROM d GROUP BY 1, 2, 3""")
def temporal_change(spark, sf):
    return D.temporal_change(depth_planes(spark, sf)).select(
        "video_id", "shot_id", "frame_index", r6(F.coalesce("change", F.lit(0.0))).alias("change"))


@q("temporal_change_sparse", P + """, d AS (SELECT video_id, shot_id, frame_index, abs(z - lag(z) OVER (PARTITION BY video_id, shot_id, i ORDER BY frame_index)) AS d FROM px WHERE frame_index % 3 <> 0)
  SELECT video_id, shot_id, frame_index * 600 AS frame_index, round(coalesce(avg(d), 0), 6) + 0.0 AS change FROM d GROUP BY 1, 2, 3""")
def temporal_change_sparse(spark, sf):
    """Frame numbers with gaps longer than a block."""
    p = depth_planes(spark, sf).where("frame_index % 3 <> 0").withColumn("frame_index", F.col("frame_index") * 600)
    return D.temporal_change(p).select("video_id", "shot_id", "frame_index", r6(F.coalesce("change", F.lit(0.0))).alias("change"))


@q("depth_stats", P + SQL_UNIT + """, d AS (SELECT video_id, shot_id, avg(d) AS c FROM (SELECT video_id, shot_id,
    abs(z - lag(z) OVER (PARTITION BY video_id, shot_id, i ORDER BY frame_index)) AS d FROM u) GROUP BY 1, 2)
  SELECT video_id, shot_id, round(least(1.0, greatest(0.0, quantile_cont(z, 0.9) - quantile_cont(z, 0.1))), 6) + 0.0 AS depth_spread,
  round(avg(CASE WHEN z >= 0.75 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS foreground_ratio, round(any_value(c), 6) + 0.0 AS temporal_change
  FROM u JOIN d USING (video_id, shot_id) GROUP BY 1, 2""")
def depth_stats(spark, sf):
    s = D.depth_stats(unit_planes(spark, sf))
    return s.select("video_id", "shot_id", *[r6(c).alias(c) for c in ("depth_spread", "foreground_ratio", "temporal_change")])


@q("edge_near_shots", P + SQL_UNIT + """SELECT video_id, shot_id, round(avg(CASE WHEN z >= 0.75 THEN 1.0 ELSE 0.0 END), 6) AS near_share,
  avg(CASE WHEN z >= 0.75 THEN 1.0 ELSE 0.0 END) >= 0.02 AS edge_near FROM u WHERE x < 1 OR x >= 7 GROUP BY 1, 2""")
def edge_near_shots(spark, sf):
    return D.edge_near_shots(unit_planes(spark, sf)).withColumn("near_share", r6("near_share"))


@q("union_bands", P + SQL_UNIT + """SELECT video_id, shot_id, frame_index, count(*) AS band_cells, count(*) FILTER (z >= 0.75) AS near_cells FROM (
  SELECT * FROM u WHERE x < 2 UNION ALL SELECT * FROM u WHERE x >= 6) GROUP BY 1, 2, 3""")
def union_bands(spark, sf):
    return D.edge_bands(unit_planes(spark, sf), 0.25).select(
        "video_id", "shot_id", "frame_index", F.col("band_cells").cast("bigint").alias("band_cells"),
        F.col("near_cells").cast("bigint").alias("near_cells"))


@q("resize_nearest", P + """, t AS (SELECT a.i AS ty, b.i AS tx FROM (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(11)) AS i) b)
  SELECT video_id, shot_id, frame_index, ty * 11 + tx AS i, round(z, 6) + 0.0 AS z FROM px JOIN t
  ON y = round_even(CASE WHEN ty = 4 THEN 7.0 ELSE CAST(ty AS DOUBLE) * (CAST(7 AS DOUBLE) / 4) END, 0)
  AND x = round_even(CASE WHEN tx = 10 THEN 7.0 ELSE CAST(tx AS DOUBLE) * (CAST(7 AS DOUBLE) / 10) END, 0)""")
def resize_nearest(spark, sf):
    return long_form(D.resize(depth_planes(spark, sf), 5, 11, "nearest"))


@q("resize_area", P + """, e AS (SELECT i, CAST(floor(i * (8.0 / 3)) AS BIGINT) AS a, CAST(floor((i + 1) * (8.0 / 3)) AS BIGINT) AS b FROM (SELECT unnest(range(3)) AS i)),
  f AS (SELECT i, CAST(floor(i * (8.0 / 5)) AS BIGINT) AS a, CAST(floor((i + 1) * (8.0 / 5)) AS BIGINT) AS b FROM (SELECT unnest(range(5)) AS i))
  SELECT video_id, shot_id, frame_index, e.i * 5 + f.i AS i, round(avg(z), 6) + 0.0 AS z FROM px JOIN e ON y >= e.a AND y < e.b JOIN f ON x >= f.a AND x < f.b
  GROUP BY 1, 2, 3, 4""")
def resize_area(spark, sf):
    return long_form(D.resize(depth_planes(spark, sf), 3, 5, "area"))


@q("resize_bilinear", P + """, t AS (SELECT a.i AS ty, b.i AS tx, a.i * (7.0 / 4) AS fy, b.i * (7.0 / 12) AS fx FROM (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(13)) AS i) b),
  g AS (SELECT *, CAST(floor(fy) AS BIGINT) AS y0, CAST(floor(fx) AS BIGINT) AS x0, CAST(least(floor(fy) + 1, 7) AS BIGINT) AS y1, CAST(least(floor(fx) + 1, 7) AS BIGINT) AS x1 FROM t)
  SELECT video_id, shot_id, frame_index, ty * 13 + tx AS i, round((CAST(z[y0 * 8 + x0 + 1] AS DOUBLE) * (1 - (fx - x0)) + CAST(z[y0 * 8 + x1 + 1] AS DOUBLE) * (fx - x0)) * (1 - (fy - y0))
    + (CAST(z[y1 * 8 + x0 + 1] AS DOUBLE) * (1 - (fx - x0)) + CAST(z[y1 * 8 + x1 + 1] AS DOUBLE) * (fx - x0)) * (fy - y0), 6) + 0.0 AS z FROM planes, g""")
def resize_bilinear(spark, sf):
    return long_form(D.resize(depth_planes(spark, sf), 5, 13, "bilinear"))


@q("luma", C + """SELECT video_id, shot_id, frame_index, (y // 2) * 4 + x // 2 AS i, round((0.114 * b + 0.587 * g + 0.299 * r) / 255.0, 6) + 0.0 AS luma
  FROM cx WHERE y % 2 = 0 AND x % 2 = 0""")
def luma(spark, sf):
    f = colour_frames(spark, sf)
    f = f.withColumn("l", G.luma(F.col("b"), F.col("g"), F.col("r"), F.col("h"), F.col("w"), 4))
    return long_form(f, "l", "luma")


def sql_blur(src, col, r, name):
    """Blur by listing the clamped neighbours of every cell."""
    return f""", {name} AS (SELECT p.video_id, p.shot_id, p.frame_index, t.y, t.x, sum(p.{col} * t.k) / {(2 * r + 1) ** 2}.0 AS v
      FROM {src} p JOIN (SELECT y, x, least(7, greatest(0, y + dy)) AS yy, least(7, greatest(0, x + dx)) AS xx, count(*) AS k
        FROM (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x), (SELECT unnest(range(-{r}, {r + 1})) AS dy), (SELECT unnest(range(-{r}, {r + 1})) AS dx)
        GROUP BY 1, 2, 3, 4) t ON p.y = t.yy AND p.x = t.xx GROUP BY 1, 2, 3, 4, 5)"""


OUT = "SELECT video_id, shot_id, frame_index, y * 8 + x AS i, round(v, 6) + 0.0 AS z FROM "


@q("box_blur", P + sql_blur("px", "z", 2, "bl") + OUT + "bl")
def box_blur(spark, sf):
    p = depth_planes(spark, sf)
    return long_form(G.box_blur(p, 2, z="z"))


def sql_contrast(src, col, r, name):
    return (f", {name}q AS (SELECT *, {col} * {col} AS sq FROM {src})" + sql_blur(src, col, r, name + "m") + sql_blur(name + "q", "sq", r, name + "s")
            + f""", {name} AS (SELECT m.video_id, m.shot_id, m.frame_index, m.y, m.x, sqrt(greatest(0.0, s.v - m.v * m.v)) AS v
              FROM {name}m m JOIN {name}s s USING (video_id, shot_id, frame_index, y, x))""")


@q("local_contrast", P + sql_contrast("px", "z", 2, "lc") + OUT + "lc")
def local_contrast(spark, sf):
    p = depth_planes(spark, sf).withColumn("z", F.transform("z", lambda v: v.cast("double")))
    return long_form(D.local_contrast(p, "z", 2, "z"))


@q("monocular_depth", C + """, lu AS (SELECT video_id, shot_id, frame_index, y, x, (0.114 * b + 0.587 * g + 0.299 * r) / 255.0 AS l,
    (greatest(b, g, r) - least(b, g, r)) / 255.0 / greatest(greatest(b, g, r) / 255.0, 1e-4) AS s FROM cx)"""
   + sql_contrast("lu", "l", 2, "fi") + sql_contrast("lu", "l", 6, "co")
   + """, de AS (SELECT f.video_id, f.shot_id, f.frame_index, f.y, f.x, (0.68 * ln(1 + f.v * 900) + 0.32 * ln(1 + c.v * 260)) / ln(901.0) AS d
     FROM fi f JOIN co c USING (video_id, shot_id, frame_index, y, x))""" + sql_blur("de", "d", 6, "db") + sql_blur("lu", "s", 6, "sb")
   + """, ne AS (SELECT d.video_id, d.shot_id, d.frame_index, d.y, d.x, 0.58 * d.v + 0.15 * s.v
     + 0.27 * pow(least(1.0, greatest(0.0, (d.y / 7.0 - 0.32) / 0.68)), 1.35) AS n FROM db d JOIN sb s USING (video_id, shot_id, frame_index, y, x))"""
   + sql_blur("ne", "n", 3, "mo") + OUT + "mo")
def monocular_depth(spark, sf):
    return long_form(D.image_cue_depth(colour_frames(spark, sf)))


def _grid_shots(spark, sf):
    return depth_planes(spark, sf).groupBy("video_id", "shot_id").agg(
        F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"))


@q("synthetic_depth", P + """, c AS (SELECT 'ramp' AS pattern, *, least(1.0, greatest(0.0, 0.65 * (1 - y / 7.0) + 0.35 * x / 7.0 + 0.05 * sin((frame_index + 7 * shot_id) * 0.12))) AS v FROM px
  UNION ALL SELECT 'radial', *, least(1.0, greatest(0.0, 1 - 1.6 * sqrt(pow(x / 7.0 - (0.5 + 0.15 * sin((frame_index + shot_id) * 0.15)), 2) + pow(y / 7.0 - 0.5, 2)))) FROM px
  UNION ALL SELECT 'flat', *, 0.5 FROM px)
  SELECT pattern, video_id, shot_id, frame_index, y * 8 + x AS i, round(v, 6) + 0.0 AS z FROM c""")
def synthetic_depth(spark, sf):
    s = _grid_shots(spark, sf)
    out = [long_form(D.synthetic_depth(s, 8, 8, p)).withColumn("pattern", F.lit(p if p != "moving-ramp" else "ramp"))
           for p in ("moving-ramp", "radial", "flat")]
    return out[0].unionByName(out[1]).unionByName(out[2])
