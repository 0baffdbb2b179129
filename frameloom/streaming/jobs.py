"""Job state from progress, result and error events.

``events``: id, seq, type (start, progress, result, error, cancel), stage, completed,
total, event_time.  Functions named ``stream_*`` need a stream; the others take
either, except those that say "batch".
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import finite_scan, running_max
from ..operators.quality import BINS, SHOT

C = F.col
TERMINAL = ("result", "error")
MAXIMA = ("max_popout_disparity_norm", "max_background_disparity_norm", "largest_hole_pixels")
SUMS = ("edge_violation_pixels", "hole_pixels")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ratio(completed: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), completed / total))).otherwise(0.0)


def job_state(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Latest stage, status and progress per job; with ``jobs``, unknown ids are ignored.

    A plain aggregation, so it combines before the shuffle and runs on streams in update mode.
    """
    e = events.where(C("type").isin("progress", *TERMINAL))
    if jobs is not None:
        e = e.join(jobs.select("id"), "id", "left_semi")
    moved = C("type").isin("progress", "result")
    return e.groupBy("id").agg(
        F.max("seq").alias("last_seq"),
        F.max_by(F.when(C("type") == "progress", C("stage")).when(C("type") == "result", "Complete").otherwise("Failed"), "seq").alias("stage"),
        F.max_by(F.when(C("type") == "progress", "processing").when(C("type") == "result", "complete").otherwise("failed"), "seq").alias("status"),
        F.max_by(F.when(moved, F.when(C("type") == "result", 1.0).otherwise(ratio(C("completed"), C("total")))),
                 F.when(moved, C("seq"))).alias("progress"))


def monotonic_progress(events: DataFrame, keys: Sequence[str] = ("id", "stage")) -> DataFrame:
    """Batch: progress that never falls; counts are taken only when valid and not older."""
    e = events.where(C("type") == "progress").withColumn("_r", ratio(C("completed"), C("total")))
    e = running_max(e, keys, "seq", C("_r"), "_before", inclusive=False)
    current = C("_r") >= F.coalesce("_before", F.lit(0.0))
    valid = current & (C("completed") >= 0) & (C("total") > 0) & (C("completed") == F.floor("completed"))
    return e.withColumns({
        "progress": F.greatest("_r", F.coalesce("_before", F.lit(0.0))),
        "completed": F.when(valid, F.least("completed", "total")), "total": F.when(valid, C("total"))}).drop("_r", "_before")


def mapped_frames(done: Column, total: Column, frame_count: Column) -> Column:
    """Chunk progress in frames, rounded up."""
    d = F.least(F.greatest(F.lit(0), done), total)
    return F.when(total > 0, F.floor((d * frame_count + total - 1) / total))


def single_terminal(events: DataFrame) -> DataFrame:
    """Batch: the first result or error per id and how many more there were."""
    return events.where(C("type").isin(*TERMINAL)).groupBy("id").agg(
        F.min("seq").alias("seq"), F.min_by("type", "seq").alias("type"), (F.count(F.lit(1)) - 1).alias("repeats"))


def _active_before(events: DataFrame) -> DataFrame:
    mark = lambda *kinds: F.when(C("type").isin(*kinds), C("seq"))
    e = running_max(events, ["id"], "seq", mark("start"), "_on", inclusive=False)
    e = running_max(e, ["id"], "seq", mark(*TERMINAL), "_off", inclusive=False)
    return e.withColumn("active", F.coalesce(C("_on") > F.coalesce("_off", F.lit(-1)), F.lit(False))).drop("_on", "_off")


def overlapping_jobs(events: DataFrame) -> DataFrame:
    """Batch: starts of an id that is still active (no result or error since its last start)."""
    return _active_before(events).where((C("type") == "start") & C("active")).drop("active")


def cancelled_jobs(events: DataFrame) -> DataFrame:
    """Batch: every cancel with whether a job with that id was active."""
    return _active_before(events).where(C("type") == "cancel").withColumnRenamed("active", "cancel_requested")


def stage_machine(events: DataFrame, stages: int, keys: Sequence[str] = ("id",), block: int = 1024) -> DataFrame:
    """Batch: stages completed and whether the next one runs, after each start/complete/fail/cancel.

    ``events``: keys, seq, op, stage (0-based).  A stage starts only after the one
    before is complete and completes only while it runs; complete stages never
    change.  Completed stages therefore form a prefix, and the whole state is
    2 * completed + running.
    """
    def step(s, r):
        done, on = F.floor(s / 2).cast("int"), s % 2
        here = r["stage"] == done
        return (F.when(here & (r["op"] == "start"), done * 2 + 1).when(here & (r["op"] == "complete") & (on == 1), done * 2 + 2)
                .when(here & r["op"].isin("fail", "cancel"), done * 2).otherwise(s))

    e = events.select(*keys, "seq", "op", "stage")
    out = finite_scan(e, keys, "seq", 2 * stages + 1, 1, step, "_s", block)
    return out.withColumns({"completed_stages": F.floor(C("_s") / 2), "running": C("_s") % 2 == 1}).drop("_s")


def drop_stale_results(results: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Results whose session generation is still the current one (stream-static join on streams)."""
    now = current.select(key, C("generation").alias("_now"))
    return results.join(now, key).where(C("generation") == C("_now")).drop("_now")


# Running state of a stream ------------------------------------------------------------------
# Aggregations keep one partial row per key and time window in update mode: the watermark drops the
# state of old windows, and what was published of them merges to the whole again.

def _windows(rows: DataFrame, keys: Sequence[str], delay: str, window: str, *aggs: Column) -> DataFrame:
    timed = rows.withWatermark("event_time", delay)
    return timed.groupBy(*keys, F.window("event_time", window).alias("_w")).agg(*aggs).withColumn("_w", C("_w.start"))


def latest(published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last published row of every (key, window) of a stream written by :func:`run_to_table` in update mode."""
    rest = [c for c in published.columns if c not in (*keys, "_w", "batch")]
    return published.groupBy(*keys, "_w").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_w", "_r.*")


def stream_job_state(events: DataFrame, jobs: DataFrame | None = None, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Partials of :func:`job_state` by window; :func:`merge_job_state` makes the states of what was published."""
    e = events.where(C("type").isin("progress", *TERMINAL))
    if jobs is not None:
        e = e.join(jobs.select("id"), "id", "left_semi")
    e = e.select("id", "event_time", F.struct("seq", "type", "stage").alias("_e"), F.when(C("type") != "error", F.struct(
        "seq", F.when(C("type") == "result", 1.0).otherwise(ratio(C("completed"), C("total"))).alias("progress"))).alias("_p"))
    return _windows(e, ["id"], delay, window, F.max("_e").alias("e"), F.max("_p").alias("p"))


def merge_job_state(published: DataFrame) -> DataFrame:
    last = latest(published, ["id"]).groupBy("id").agg(F.max("e").alias("e"), F.max("p").alias("p"))
    kind = lambda p, r, f: F.when(C("e.type") == "progress", p).when(C("e.type") == "result", r).otherwise(f)
    return last.select("id", C("e.seq").alias("last_seq"), kind(C("e.stage"), "Complete", "Failed").alias("stage"),
                       kind(F.lit("processing"), "complete", "failed").alias("status"), C("p.progress").alias("progress"))


def stream_single_terminal(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Partials of :func:`single_terminal` by window, for :func:`merge_single_terminal`."""
    e = events.where(C("type").isin(*TERMINAL)).select("id", "event_time", F.struct("seq", "type").alias("_e"))
    return _windows(e, ["id"], delay, window, F.min("_e").alias("e"), F.count(F.lit(1)).alias("n"))


def merge_single_terminal(published: DataFrame) -> DataFrame:
    return latest(published, ["id"]).groupBy("id").agg(F.min("e").alias("e"), F.sum("n").alias("n")).select(
        "id", "e.seq", "e.type", (C("n") - 1).alias("repeats"))


def stream_qc(rows: DataFrame, keys: Sequence[str] = SHOT, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Partials of shot quality by window, for :func:`merge_qc`: maxima, sums, the mean's parts and 40 disparity bins.

    ``rows``: those of ``frame_qc`` with ``event_time`` and, when the histogram is wanted, ``bins``, a frame's counts.
    """
    out = [F.count(F.lit(1)).alias("frame_count"), *[F.max(c).alias(c) for c in MAXIMA], *[F.sum(c).alias(c) for c in SUMS],
           F.sum("depth_temporal_change").alias("change_sum"), F.count("depth_temporal_change").alias("change_count")]
    if "bins" in rows.columns:
        out += [F.sum(F.get("bins", F.lit(i))).alias(f"bin_{i}") for i in range(BINS)]
    return _windows(rows, keys, delay, window, *out)


def merge_qc(published: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Shot quality, as of :func:`shot_qc` and with ``bins`` where they were counted, of what a stream published.

    ``change_count`` says how many frames the mean change is of: none so far is no mean, though the mean then reads 0.
    """
    last = latest(published, keys)
    bins = [c for c in last.columns if c.startswith("bin_")]
    out = [F.sum("frame_count").alias("frame_count"), *[F.max(c).alias(c) for c in MAXIMA], *[F.sum(c).alias(c) for c in SUMS],
           F.coalesce(F.try_divide(F.sum("change_sum"), F.sum("change_count")), F.lit(0.0)).alias("depth_temporal_change"),
           F.sum("change_count").alias("change_count")]
    if bins:
        out.append(F.array(*[F.sum(f"bin_{i}") for i in range(len(bins))]).alias("bins"))
    return last.groupBy(*keys).agg(*out)


# Keyed state with timers --------------------------------------------------------------------

class _Ordered(StatefulProcessor):
    """A key's rows in order of ``order``, state that ends, and no batch of a key held whole.

    Rows of one Arrow batch are sorted and handled.  When a key has more in a micro-batch, all go to a
    map state by cells of the order column first, and cells are handled one by one.  A timer clears the
    state when the watermark passes the key's last event by ``keep`` milliseconds.
    """
    order, state, cell = "seq", "", 4096

    def __init__(self, schema: str, keep: int):
        self.schema, self.keep = schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", self.state)
        self.due = handle.getValueState("due", "at bigint")
        self.cells = handle.getMapState("cells", "cell bigint", f"rows array<struct<{self.schema}>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, spilled, names, latest_at = None, False, [], -1
        for part in rows:
            if "event_time" in part:
                latest_at = max(latest_at, int(part.event_time.max().timestamp() * 1000))
                part = part.drop(columns="event_time")
            names = list(part.columns)
            if first is None and not spilled:
                first = part
                continue
            if not spilled:
                self._spill(first)
                first, spilled = None, True
            self._spill(part)
        if spilled:
            for c in sorted(k[0] for k in self.cells.keys()):
                held = pd.DataFrame([tuple(r) for r in self.cells.getValue((c,))[0]], columns=names)
                self.cells.removeKey((c,))
                yield from self._run(held)
        elif first is not None:
            yield from self._run(first)
        if latest_at >= 0:
            self._keep_until(latest_at + self.keep)

    def _spill(self, part: pd.DataFrame) -> None:
        for c, some in part.groupby(part[self.order] // self.cell):
            c = (int(c),)
            held = self.cells.getValue(c)[0] if self.cells.containsKey(c) else []
            more = some.astype(object).itertuples(index=False)
            self.cells.updateValue(c, ([tuple(r) for r in held] + [tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in r) for r in more],))

    def _run(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # Each call to the store is a round trip, so it is asked once and answers None for a new key.
        own, out = self.along(self.own.get() or self.fresh(), rows if rows[self.order].is_monotonic_increasing else rows.sort_values(self.order))
        self.own.update(own)
        if len(out):
            yield out

    def _keep_until(self, at: int) -> None:
        """A key has one timer, left where it is as more rows come: when it rings, the key may have been put off."""
        before = self.due.get()
        if before is None:
            self.handle.registerTimer(at)
        if before is None or at > before[0]:
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0]
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.own.clear()
            self.due.clear()
        return iter(())

    def close(self) -> None:
        pass


REQUESTS = "id bigint, seq bigint, type string, outcome string, progress double"


class _Requests(_Ordered):
    state = "active boolean, top double, last bigint"

    def fresh(self):
        return False, 0.0, -1

    def along(self, own, rows):
        active, top, last = own
        out = []
        for r in rows.itertuples(index=False):
            if r.seq <= last:
                out.append((r.id, r.seq, r.type, "late", top))
                continue
            last, what = int(r.seq), "accepted"
            if r.type == "start":
                what = "overlap" if active else "accepted"
                active, top = True, (top if active else 0.0)
            elif r.type == "progress":
                top = max(top, min(1.0, max(0.0, r.completed / r.total)) if r.total > 0 else 0.0)
            elif r.type == "cancel":
                what = "cancel_requested" if active else "not_active"
            elif r.type in TERMINAL:
                what = "accepted" if active else "repeated"
                active = False
            out.append((r.id, r.seq, r.type, what, top))
        return (bool(active), float(top), last), pd.DataFrame(out, columns=["id", "seq", "type", "outcome", "progress"])


def _time(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "event_time"]


def _stateful(rows: DataFrame, key: str, made: type[_Ordered], schema: str, delay: str, keep: str) -> DataFrame:
    plain = rows.drop("event_time")
    processor = made(", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in plain.schema.fields), int(pd.Timedelta(keep).total_seconds() * 1000))
    timed = "event_time" in rows.columns
    keyed = (rows.withWatermark("event_time", delay) if timed else rows).groupBy(key)
    return keyed.transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if timed else "None")


def stream_requests(events: DataFrame, delay: str = "1 hour", keep: str = "7 days") -> DataFrame:
    """Keyed state per id: refuses overlapping starts and repeated endings, answers cancels, keeps progress rising.

    Events later than ``delay`` are dropped by the watermark; ``keep`` after an id's last event its state
    is dropped, so an id that comes again starts anew.  Events without ``event_time`` keep it for good.
    """
    rows = events.select("id", "seq", "type", "completed", "total", *_time(events))
    return _stateful(rows, "id", _Requests, REQUESTS, delay, keep)


class _Shots(_Ordered):
    order = "frame_index"

    def __init__(self, schema, keep, threshold, min_gap):
        super().__init__(schema, keep)
        self.threshold, self.min_gap = threshold, min_gap
        self.cell = 64
        self.state = "last bigint, value array<double>, bound bigint"

    def fresh(self):
        return -1, [], 0

    def along(self, own, rows):
        last, value, bound = own
        value = np.asarray(value, dtype=np.float64)
        found, video = [], None
        for r in rows.itertuples(index=False):
            if r.frame_index <= last:
                continue
            now = np.atleast_1d(np.asarray(r.value, dtype=np.float64))
            if len(value) == len(now) and r.frame_index - bound >= self.min_gap and np.abs(now - value).mean() >= self.threshold:
                bound = int(r.frame_index)
                found.append((r.video_id, bound))
            last, value = int(r.frame_index), now
        return (last, value.tolist(), bound), pd.DataFrame(found, columns=["video_id", "frame_index"])


def stream_shots(frames: DataFrame, threshold: float, min_gap: int, value: str = "value", delay: str = "1 hour",
                 keep: str = "7 days") -> DataFrame:
    """Boundaries on an unbounded frame series: state is the last frame, its value and the last boundary.

    ``value`` is a number, or a gray plane (``segment.gray_planes``), of which the mean change of cells counts.
    Frames of a video must arrive in order across batches; one at or before the last seen frame is late
    and ignored.  Delays as in :func:`stream_requests`; frames without ``event_time`` keep their state for good.
    """
    rows = frames.select("video_id", "frame_index", C(value).alias("value"), *_time(frames))
    made = lambda schema, kept: _Shots(schema, kept, threshold, min_gap)
    return _stateful(rows, "video_id", made, "video_id bigint, frame_index bigint", delay, keep)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> str:
    """Run a stream over what is there now into a table under ``folder``; returns its path.

    Update and complete results are written one batch per subfolder, so a retried batch overwrites itself.
    """
    path = f"{folder}/out"
    # Timers and map state need this store; the setting is the query's own once it has started.
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return _run_to(stream, folder, path, mode)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _run_to(stream: DataFrame, folder: str, path: str, mode: str) -> str:
    w = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", path).outputMode(mode).start().awaitTermination()
    else:
        (w.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
         .start().awaitTermination())
    return path
