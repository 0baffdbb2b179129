"""Keyed state and windowed partials of streams over several micro-batches."""
import datetime as dt

import numpy as np

from frameloom.operators import segment as SEG
from frameloom.streaming import jobs as J

DAY0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, seq long, type string, stage string, completed double, total double, event_time timestamp"


def event(key, seq, kind, hours, done=0.0):
    return key, seq, kind, "depth", done, 10.0, DAY0 + dt.timedelta(hours=hours)


def as_stream(spark, tmp_path, schema, *batches):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def outcomes(spark, path):
    return {(r.id, r.seq): r.outcome for r in spark.read.parquet(path).collect()}


def test_requests_keep_and_drop_their_state(spark, tmp_path):
    s = as_stream(spark, tmp_path, EVENTS,
                  [event(1, 1, "start", 0), event(1, 3, "progress", .2, 4.0), event(1, 2, "start", .1), event(2, 4, "cancel", .1)],
                  [event(1, 5, "result", 1), event(1, 6, "error", 1.1), event(2, 7, "start", 1), event(1, 2, "progress", 1)],
                  [event(3, 8, "start", 40)], [event(3, 9, "progress", 41)], [event(2, 10, "start", 42), event(3, 11, "cancel", 42)])
    got = outcomes(spark, J.run_to_table(J.stream_requests(s, "1 hour", keep="10 hours"), str(tmp_path / "run")))
    # Id 2 was active at hour 1; its state has ended by hour 42, so the start there is a first one.
    assert got == {(1, 1): "accepted", (1, 2): got[1, 2], (1, 3): "accepted", (2, 4): "not_active", (1, 5): "accepted", (1, 6): "repeated",
                   (2, 7): "accepted", (3, 8): "accepted", (3, 9): "accepted", (2, 10): "accepted", (3, 11): "cancel_requested"}
    assert spark.read.parquet(str(tmp_path / "run/out")).where("id = 1 and seq = 2").count() == 2  # an overlap, and a late one


def test_many_rows_of_a_key_go_through_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    kinds = ["start", "progress", "result", "error", "cancel"]
    rows = [event(1, i, kinds[rng.integers(5)], i / 1000, float(rng.integers(12))) for i in range(300)]
    rows = [rows[i] for i in rng.permutation(300)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    told = []
    for n, size in enumerate(("7", "10000")):
        spark.conf.set(name, size)
        try:
            s = as_stream(spark, tmp_path / str(n), EVENTS, rows)
            path = J.run_to_table(J.stream_requests(s), str(tmp_path / f"run{n}"))
            told.append(sorted(map(tuple, spark.read.parquet(path).collect())))
        finally:
            spark.conf.unset(name)
    assert told[0] == told[1] and len(told[0]) == 300


def test_shots_of_gray_planes(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(v, i, [float(x) for x in rng.integers(0, 200, 4)], DAY0 + dt.timedelta(minutes=i)) for v in (1, 2) for i in range(40)]
    schema = "video_id long, frame_index long, gray array<double>, event_time timestamp"
    s = as_stream(spark, tmp_path, schema, *[[r for r in rows if r[1] // 10 == k] for k in range(4)])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "3")  # so that planes pass through the map state
    try:
        path = J.run_to_table(J.stream_shots(s, 60.0, 3, value="gray"), str(tmp_path / "run"))
    finally:
        spark.conf.unset(name)
    got = {tuple(r) for r in spark.read.parquet(path).collect()}
    f = spark.createDataFrame(rows, schema)
    counts = f.groupBy("video_id").count().withColumnRenamed("count", "frame_count")
    shots = SEG.detect_shots(f.drop("event_time"), counts, 60.0, 3, value="gray").where("start_frame > 0").collect()
    assert got == {(r.video_id, r.start_frame) for r in shots} and len(got) > 4


def test_windows_merge_to_the_whole(spark, tmp_path):
    rng = np.random.default_rng(4)
    kinds = ["start", "progress", "result", "error"]
    rows = [event(int(rng.integers(4)), i, kinds[rng.integers(4)], i, float(rng.integers(12))) for i in range(120)]
    s = as_stream(spark, tmp_path, EVENTS, rows[:50], rows[50:80], rows[80:])
    batch = spark.createDataFrame(rows, EVENTS)
    state = J.merge_job_state(spark.read.parquet(J.run_to_table(J.stream_job_state(s), str(tmp_path / "a"), "update")))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, J.job_state(batch).collect()))
    ends = J.merge_single_terminal(spark.read.parquet(J.run_to_table(J.stream_single_terminal(s), str(tmp_path / "b"), "update")))
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, J.single_terminal(batch).collect()))


def test_empty_stream(spark, tmp_path):
    s = as_stream(spark, tmp_path, EVENTS, [])
    path = J.run_to_table(J.stream_requests(s), str(tmp_path / "run"))
    assert spark.read.schema(J.REQUESTS).parquet(path).count() == 0


def test_quality_of_shots_without_a_change(spark, tmp_path):
    """Of the first shot no frame has a predecessor, so its mean change is null, not 0."""
    from frameloom.checks import events as E
    rows = [(i, DAY0 + dt.timedelta(hours=i), u, "view", float(10 * i)) for i, u in ((0, 1), (3, 1), (4, 2), (6, 1), (9, 3), (10, 3))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.video_id: (r.frame_count, r.depth_temporal_change) for r in E.stream_qc(spark, str(tmp_path)).collect()}
    assert got == {1: (3, None), 2: (1, 40.0), 3: (2, 100.0)}


def test_a_timer_that_was_put_off(spark, tmp_path):
    """A key's timer stays where it was set: events after it was set keep the state, and it still ends ``keep`` after the last."""
    s = as_stream(spark, tmp_path, EVENTS, [event(1, 1, "start", 0)], [event(1, 2, "progress", 8, 5.0)], [event(2, 3, "start", 14)],
                  [event(2, 4, "progress", 15)], [event(1, 5, "cancel", 16)], [event(2, 6, "progress", 40)], [event(2, 7, "progress", 41)], [event(1, 8, "cancel", 42)])
    got = outcomes(spark, J.run_to_table(J.stream_requests(s, "1 hour", keep="10 hours"), str(tmp_path / "run")))
    assert got[1, 5] == "cancel_requested" and got[1, 8] == "not_active"


def test_stream_source_is_made_once(spark, tmp_path):
    """The files of the micro-batches come from what was written once, in order of time, a file each."""
    from frameloom.checks import events as E
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        runs.add(1)
        yield from batches
    rows = spark.createDataFrame([(i, DAY0 + dt.timedelta(hours=i)) for i in range(50)], "n long, at timestamp").coalesce(1).mapInArrow(seen, "n long, at timestamp")
    got = E.in_files(rows, "at")
    path = tmp_path / "out"
    got.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(
        lambda df, n: df.write.parquet(f"{path}/batch={n}")).start().awaitTermination()
    told = {(r.batch, r.n) for r in spark.read.parquet(str(path)).collect()}
    assert told == {(min(4, i * 5 // 49), i) for i in range(50)} and runs.value == 1
