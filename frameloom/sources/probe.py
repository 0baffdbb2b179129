"""Probe documents (JSON text, one per file) to media rows with nested audio streams."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_fraction, parse_number

PROBE = """format struct<duration:string>, streams array<struct<codec_type:string, codec_name:string, width:string, height:string,
 avg_frame_rate:string, r_frame_rate:string, duration:string, nb_read_frames:string, nb_frames:string, pix_fmt:string, index:string,
 channels:string, sample_rate:string, tags:struct<rotate:string, language:string>, side_data_list:array<struct<rotation:string>>>>"""


def _whole(c: Column) -> Column:
    return c.try_cast("bigint")


def parse_probe(docs: DataFrame, json: str = "probe") -> DataFrame:
    """Adds the media columns, or ``error`` for documents without streams or video."""
    p = docs.withColumn("_p", F.from_json(json, PROBE))
    p = p.withColumn("_v", F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    v = F.col("_v")
    avg, nominal = parse_fraction(v["avg_frame_rate"]), parse_fraction(v["r_frame_rate"])
    p = p.withColumns({"_a": F.coalesce(avg, F.lit(0.0)), "_r": F.coalesce(nominal, F.lit(0.0)),
                       "_d": F.coalesce(parse_number(v["duration"], float("nan")), F.lit(float("nan")))})
    fmt = parse_number(F.col("_p.format.duration"), 0.0)
    p = p.withColumn("_d", F.when(F.isnan("_d"), fmt).otherwise(F.col("_d")))
    rate = F.when(F.col("_a") != 0, F.col("_a")).otherwise(F.col("_r"))
    some = lambda c: F.when(c != "", c)
    counted = F.coalesce(some(v["nb_read_frames"]), some(v["nb_frames"]))
    side = F.get(F.filter(v["side_data_list"], lambda s: s["rotation"].isNotNull()), F.lit(0))["rotation"]
    turn = F.rint(F.coalesce(side.try_cast("double"), v["tags"]["rotate"].try_cast("double"), F.lit(0.0))).cast("bigint")
    gap = F.abs(F.col("_r") - F.col("_a")) / F.greatest("_r", "_a")
    audio = F.transform(F.filter("_p.streams", lambda s: s["codec_type"] == "audio"), lambda s: F.struct(
        F.coalesce(_whole(s["index"]), F.lit(0)).alias("index"), F.coalesce(s["codec_name"], F.lit("unknown")).alias("codec"),
        F.nullif(_whole(s["channels"]), F.lit(0)).alias("channels"), F.nullif(_whole(s["sample_rate"]), F.lit(0)).alias("sample_rate"),
        F.nullif(s["tags"]["language"], F.lit("")).alias("language"),
        F.when(some(s["duration"]).isNotNull(), F.greatest(F.lit(0.0), parse_number(s["duration"]))).alias("duration_seconds")))
    err = F.when(F.col("_p.streams").isNull(), "no_streams").when(v.isNull(), "no_video")
    return p.withColumns({
        "error": err, "width": F.coalesce(_whole(v["width"]), F.lit(0)), "height": F.coalesce(_whole(v["height"]), F.lit(0)),
        "frame_rate": rate, "duration_seconds": F.greatest(F.lit(0.0), F.col("_d")),
        "frame_count": F.greatest(F.lit(0), F.coalesce(_whole(counted), F.rint(F.col("_d") * rate).cast("bigint"))),
        "video_codec": F.coalesce(v["codec_name"], F.lit("unknown")), "pixel_format": F.coalesce(v["pix_fmt"], F.lit("unknown")),
        "rotation_degrees": F.pmod(turn, F.lit(360)),
        "variable_frame_rate": (F.col("_r") != 0) & (F.col("_a") != 0) & (gap > 0.001),
        "audio_streams": audio}).drop("_p", "_v", "_a", "_r", "_d")
