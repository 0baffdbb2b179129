"""How the driver's tables stand in for video tables (one place, mirrored in SQL).

events      -> frame series:   video = user, frame order = (ts, event_id)
embeddings  -> 8x8 depth grids: shot = label + 1, frame order = vec_id
orders      -> shots of a customer's reel, with features from lineitem
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import number_rows

GRID = 8
THRESHOLD, MIN_GAP = 112.0, 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame_series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), "event_id", "ts", "event_type", "value")
    second = (F.datediff("ts", F.lit("2000-01-01")).cast("bigint") * 86400
              + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))
    return number_rows(e, ["video_id"], ["ts", "event_id"], [second], "frame_index")


def frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("video_id")).agg(
        F.count(F.lit(1)).alias("frame_count"))


SQL_FRAMES = """frames AS (SELECT user_id AS video_id, event_id, ts, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)"""


def depth_planes(spark: SparkSession, sf: str) -> DataFrame:
    """video_id, shot_id, frame_index, h, w, z ARRAY<DOUBLE> (row-major)."""
    e = table(spark, sf, "embeddings").select(
        (F.col("label") % 2).cast("bigint").alias("video_id"),
        (F.col("label") + 1).cast("bigint").alias("shot_id"), "vec_id", F.col("embedding").alias("z"))
    e = number_rows(e, ["video_id", "shot_id"], ["vec_id"],
                    [F.floor(F.col("vec_id") / 65_536)], "frame_index")
    # The table is one small file; pixel work is spread over the cluster by frame.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = e.repartition(parts, "video_id", "shot_id", "frame_index")
    return e.select("video_id", "shot_id", "frame_index", F.lit(GRID).alias("h"), F.lit(GRID).alias("w"), "z")


SQL_PLANES = """planes AS (SELECT CAST(label % 2 AS BIGINT) AS video_id, CAST(label + 1 AS BIGINT) AS shot_id,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, embedding AS z FROM embeddings),
px AS (SELECT video_id, shot_id, frame_index, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x, i,
  CAST(z[i + 1] AS DOUBLE) AS z FROM planes, (SELECT unnest(range(64)) AS i))"""


def colour_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Like depth_planes, with b, g, r code arrays made from the same grid."""
    n = GRID * GRID

    def code(k: int):
        return F.transform("z", lambda v, i: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(
            (F.get(F.col("z"), (i + k) % n).cast("double") + 1) * 127.5).cast("double"))))

    return depth_planes(spark, sf).withColumns({"b": code(0), "g": code(1), "r": code(2)})


SQL_COLOUR = SQL_PLANES + """,
cx AS (SELECT video_id, shot_id, frame_index, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x, i,
  CAST(z[i + 1] AS DOUBLE) AS z,
  least(255.0, greatest(0.0, floor((CAST(z[i + 1] AS DOUBLE) + 1) * 127.5))) AS b,
  least(255.0, greatest(0.0, floor((CAST(z[(i + 1) % 64 + 1] AS DOUBLE) + 1) * 127.5))) AS g,
  least(255.0, greatest(0.0, floor((CAST(z[(i + 2) % 64 + 1] AS DOUBLE) + 1) * 127.5))) AS r
  FROM planes, (SELECT unnest(range(64)) AS i))"""


#: The changes have nine digits, so none is just the threshold.
PLANE_THRESHOLD, PLANE_GAP, PLANE_WIDTH = 9.0000000005, 5, 4


def gray_series(spark: SparkSession, sf: str) -> DataFrame:
    """Gray planes of two videos, shrunk to PLANE_WIDTH cells, their frames numbered through all shots."""
    from .functions.pixels import narrowed
    from .operators.segment import gray_planes
    g = narrowed(gray_planes(colour_frames(spark, sf), PLANE_WIDTH), ["video_id", "shot_id", "frame_index", "gray"])
    cell = [F.col("shot_id"), F.floor(F.col("_i") / 65_536)]
    return number_rows(g.withColumnRenamed("frame_index", "_i"), ["video_id"], ["shot_id", "_i"], cell, "frame_index").select("video_id", "frame_index", "gray")


SQL_GRAY = SQL_COLOUR + """,
fx AS (SELECT video_id, row_number() OVER (PARTITION BY video_id, y, x ORDER BY shot_id, frame_index) - 1 AS frame_index, y, x,
  0.114 * b + 0.587 * g + 0.299 * r AS v FROM cx),
small AS (SELECT video_id, frame_index, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM fx GROUP BY ALL),
moved AS (SELECT video_id, frame_index, abs(v - lag(v) OVER (PARTITION BY video_id, y, x ORDER BY frame_index)) AS d FROM small),
changed AS (SELECT video_id, frame_index, avg(d) AS score FROM moved GROUP BY 1, 2)"""


def shot_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with lines: a customer's orders are the shots of a reel."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg("l_discount") * 10, 6).alias("motion_score"),
        F.round(F.avg("l_tax") * 12.5, 6).alias("speech_ratio"),
        F.round((F.max("l_quantity") - F.min("l_quantity")) / 50, 6).alias("depth_spread"),
        F.round(F.min("l_quantity") / 50, 6).alias("foreground_ratio"),
        F.round(F.max("l_quantity") / 50, 6).alias("depth_reliability"),
        F.count(F.lit(1)).alias("lines"))
    o = table(spark, sf, "orders")
    o = o.join(li, o.o_orderkey == li.l_orderkey)
    o = number_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                    [F.datediff("o_orderdate", F.lit("1970-01-01")), F.floor(F.col("o_orderkey") / 1_048_576)], "_p")
    return o.select(
        F.col("o_custkey").alias("video_id"), (F.col("_p") + 1).alias("shot_id"),
        F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("price"), "lines",
        "motion_score", "speech_ratio", "depth_spread", "foreground_ratio", "depth_reliability",
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "fade").otherwise("cut").alias("transition"),
        (F.col("o_orderkey") % 2 == 0).alias("edge_near"))


SQL_FEATURES = """li AS (SELECT l_orderkey, round(avg(l_discount) * 10, 6) + 0.0 AS motion_score,
  round(avg(l_tax) * 12.5, 6) + 0.0 AS speech_ratio, round((max(l_quantity) - min(l_quantity)) / 50, 6) AS depth_spread,
  round(min(l_quantity) / 50, 6) AS foreground_ratio, round(max(l_quantity) / 50, 6) AS depth_reliability,
  count(*) AS lines FROM lineitem GROUP BY 1),
feats AS (SELECT o_custkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS shot_id,
  o_orderkey AS order_key, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS order_date,
  o_totalprice AS price, lines, motion_score, speech_ratio, depth_spread, foreground_ratio, depth_reliability,
  CASE WHEN o_orderpriority[1] = '1' THEN 'fade' ELSE 'cut' END AS transition, o_orderkey % 2 = 0 AS edge_near
  FROM orders JOIN li ON o_orderkey = l_orderkey)"""


def reel(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, shots and speech spans of two videos with five shots each, from the colour grids."""
    from .operators.ordered import join_small, running_sum

    c = colour_frames(spark, sf).drop("z").withColumn("shot_id", F.floor((F.col("shot_id") - 1) / 2) + 1)
    key = ["video_id", "shot_id"]
    n = c.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    s = running_sum(n, ["video_id"], "shot_id", F.col("_n"), "_end")
    start = F.col("_end") - F.col("_n")
    shots = s.select(*key, start.alias("start_frame"), (F.col("_end") - 1).alias("end_frame"), (start / 24.0).alias("start_time"),
                     (F.col("_end") / 24.0).alias("end_time"),
                     F.when(F.col("shot_id") == 1, "start").when(F.col("shot_id") == 3, "fade").otherwise("cut").alias("transition"))
    frames = (join_small(c, shots.select(*key, "start_frame"), key, F.col("frame_index"))
              .withColumn("frame_index", F.col("frame_index") + F.col("start_frame")).drop("start_frame", "shot_id"))
    spans = shots.where("shot_id % 2 = 0").select(
        "video_id", F.col("start_time").alias("start_s"), (F.col("start_time") + (F.col("end_time") - F.col("start_time")) * 0.6).alias("end_s"))
    return frames, shots, spans
