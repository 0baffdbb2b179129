"""Published versions of depth planes and what is found when their files change."""
from pyspark.sql import functions as F

from frameloom.sources import depth_store as DS

PLANES = "video_id long, shot_id long, frame_index long, h int, w int, z array<float>"


def test_versions_and_changes(spark, tmp_path):
    rows = [(v, s, i, 1, 2, [float(i), None if i == 3 else 0.5]) for v in (1, 2) for s in (1, 2) for i in range(300)]
    p = spark.createDataFrame(rows, PLANES)
    path = str(tmp_path / "store")
    DS.publish(p, path, 1)
    DS.publish(p.where("shot_id = 1"), path, 2)
    assert DS.published(spark, path)[0] == 2 and DS.load(spark, path).count() == 600
    assert DS.load(spark, path, 1).where("error is null").count() == 1200
    # Files follow the partitions of the write, not the number of shots.
    assert len(list((tmp_path / "store/planes/version=1").glob("*.parquet"))) <= 4
    # A version whose manifest was never written is not there.
    DS.cluster_planes(p).write.parquet(f"{path}/planes/version=3")
    assert DS.published(spark, path)[0] == 2
    other = p.where("not (video_id = 1 and shot_id = 2 and frame_index >= 256)").withColumn(
        "z", F.when(F.expr("video_id = 2 and shot_id = 1 and frame_index = 7"), F.array(F.lit(7.0), F.lit(0.25)).cast("array<float>")).otherwise(F.col("z")))
    other = other.unionByName(spark.createDataFrame([(9, 9, 0, 1, 1, [0.0])], PLANES))
    other.write.mode("overwrite").parquet(f"{path}/planes/version=1")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in DS.load(spark, path, 1).where("error is not null").groupBy("error", "video_id", "shot_id").agg(
        F.min("frame_index").alias("a"), F.count("z").alias("n")).collect()}
    assert got == {("changed", 2, 1, 0): (256,), ("missing", 1, 2, 256): (0,), ("unlisted", 9, 9, 0): (1,)}
    want = spark.createDataFrame([(1, 1, 300, 1, 2), (1, 2, 300, 1, 2), (2, 1, 300, 1, 2), (2, 2, 299, 1, 2), (3, 1, 1, 1, 2)], "video_id long, shot_id long, frame_count long, h int, w int")
    planes, outcome = DS.load_cached(spark, path, want, 1)
    assert {(r.video_id, r.shot_id): r.outcome for r in outcome.collect()} == {(1, 1): "ok", (1, 2): "changed", (2, 1): "changed", (2, 2): "frame_count", (3, 1): "missing"}
    assert planes.count() == 300


def test_empty_version(spark, tmp_path):
    DS.publish(spark.createDataFrame([], PLANES), str(tmp_path), 1)
    assert DS.load(spark, str(tmp_path), 1).count() == 0
