"""A versioned store of depth planes: few large files in order, and a digest for every range of frames.

``folder/planes/version=n`` holds a version's planes sorted by video, shot and frame, so that readers of some
videos skip the other row groups; ``folder/manifest/version=n`` is written after it and has one row per range of
RANGE frames.  A version without a manifest was never published, so a lost writer leaves nothing half done.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import cluster_planes

C = F.col
SHOT = ["video_id", "shot_id"]
RANGE = 256  # frames that one digest covers
PLACE = [*SHOT, "_range"]


def _ranges(planes: DataFrame) -> DataFrame:
    """One row per shot and range: first and last frame, frames, largest grid and the digest of all planes in order."""
    cells = F.array_join(C("z").cast("array<float>").cast("array<string>"), ",", "null")
    one = F.sha2(F.concat_ws("|", C("frame_index").cast("string"), C("h").cast("string"), C("w").cast("string"), cells), 256)
    put = planes.select(*SHOT, F.floor(C("frame_index") / RANGE).alias("_range"), "frame_index", "h", "w", one.alias("_d"))
    return put.groupBy(*PLACE).agg(
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("frame_count"),
        F.max("h").alias("h"), F.max("w").alias("w"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "_d"))), lambda s: s["_d"]), ""), 256).alias("digest"))


def publish(planes: DataFrame, folder: str, version: int) -> None:
    """Write a version: its planes first, then the manifest that makes it one. Versions are never written twice."""
    spark = planes.sparkSession
    at = f"{folder}/planes/version={version}"
    cluster_planes(planes.select(*SHOT, "frame_index", "h", "w", C("z").cast("array<float>").alias("z"))).write.mode("overwrite").parquet(at)
    _ranges(spark.read.parquet(at)).write.mode("errorifexists").parquet(f"{folder}/manifest/version={version}")


def published(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, DataFrame]:
    """A version's number and manifest; the last published one unless another is named."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    if version is None:
        version = manifest.agg(F.max("version")).first()[0]  # one number, from folder names
    return version, manifest.where(C("version") == version).drop("version")


def load(spark: SparkSession, folder: str, version: int | None = None, shots: DataFrame | None = None) -> DataFrame:
    """Planes with ``error``: null, ``changed`` where their range's digest is not the manifest's, ``unlisted`` where it has none.

    A range that is gone is a row of its first frame without a plane, ``missing``.  ``shots`` (keys, distinct) limits
    what is read and checked.
    """
    version, manifest = published(spark, folder, version)
    planes = spark.read.parquet(f"{folder}/planes/version={version}")
    if shots is not None:
        manifest, planes = (t.join(shots.select(*SHOT), SHOT, "left_semi") for t in (manifest, planes))
    due = manifest.select(*PLACE, "first_frame", C("digest").alias("_due"))
    found = _ranges(planes).select(*PLACE, C("digest").alias("_now")).join(due, PLACE, "full_outer")
    state = found.select(*PLACE, "first_frame", F.when(C("_now").isNull(), "missing").when(C("_due").isNull(), "unlisted").when(C("_now") != C("_due"), "changed").alias("error"))
    place = planes.withColumn("_range", F.floor(C("frame_index") / RANGE))
    j = place.join(state, PLACE, "right")
    return j.select(*SHOT, F.coalesce("frame_index", "first_frame").alias("frame_index"), "h", "w", "z", "error")


def load_cached(spark: SparkSession, folder: str, shots: DataFrame, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Planes of the wanted shots that the store can give, and per shot ``outcome``: ok, missing, frame_count, grid or changed.

    ``shots``: video_id, shot_id, frame_count, h, w (the largest grid that is taken).
    """
    version, manifest = published(spark, folder, version)
    has = manifest.groupBy(*SHOT).agg(F.struct(F.sum("frame_count").alias("frame_count"), F.max("h").alias("h"), F.max("w").alias("w")).alias("_e"))
    first = shots.join(has, SHOT, "left").select(*SHOT, F.when(C("_e").isNull(), "missing").when(C("_e.frame_count") != C("frame_count"), "frame_count")
                                                 .when((C("_e.h") > C("h")) | (C("_e.w") > C("w")), "grid").alias("_first"))
    planes = load(spark, folder, version, first.where("_first is null"))
    bad = planes.where("error is not null").select(*SHOT, F.lit(True).alias("_bad")).distinct()
    outcome = first.join(bad, SHOT, "left").select(*SHOT, F.coalesce("_first", F.when(C("_bad"), "changed"), F.lit("ok")).alias("outcome"))
    return planes.join(outcome.where("outcome = 'ok'").select(*SHOT), SHOT, "left_semi").drop("error"), outcome
