"""Reading frames: one frame per shot offset, and raw BGR dumps."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def frame_at(frames: DataFrame, wanted: DataFrame, rate: float, keys=("video_id",)) -> DataFrame:
    """The frame at ``offset`` into each wanted shot; the offset is clamped to the shot."""
    at = F.least(F.col("start_frame") + F.greatest(F.col("offset"), F.lit(0)), F.col("end_frame"))
    w = wanted.withColumn("frame_index", at).select(*keys, "shot_id", "frame_index")
    return (frames.join(w, [*keys, "frame_index"])
            .withColumn("seek_seconds", (F.col("frame_index") + 0.5) / rate))


def split_raw_frames(files: DataFrame, width: int, height: int) -> DataFrame:
    """Fixed-size BGR24 records of raw dumps (path, content), one row per frame; a partial record is an error row."""
    size = width * height * 3
    n = F.floor(F.octet_length("content") / size)
    torn = F.octet_length("content") % size != 0
    count = n + F.when(torn, 1).otherwise(0)
    f = files.select("path", "content", n.alias("_n"), F.explode(F.when(count > 0, F.sequence(
        F.lit(0).cast("bigint"), count - 1))).alias("frame_index"))
    error = F.when(F.col("frame_index") == F.col("_n"), "partial_record")
    return f.select("path", "frame_index", F.when(error.isNull(), F.substring(
        "content", (F.col("frame_index") * size + 1).cast("int"), F.lit(size).cast("int"))).alias("bgr"), error.alias("error"))


RAW = "path string, frame_index bigint, bgr binary, error string"
SPLIT_BYTES, BATCH_BYTES = 128 * 1024 * 1024, 8 * 1024 * 1024


class _Span(InputPartition):
    """Records ``first`` to ``last`` - 1 of a file of ``size`` bytes."""

    def __init__(self, path: str, first: int, last: int, size: int):
        self.path, self.first, self.last, self.size = path, first, last, size


class RawFrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.record = int(options["width"]) * int(options["height"]) * 3
        if self.record <= 0:
            raise ValueError("width and height must be positive")

    def partitions(self):
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file]
        per, spans = max(1, self.split // self.record), []
        for f in sorted(files, key=lambda i: i.path):
            if not f.base_name.startswith(("_", ".")):
                # The torn rest of a file belongs to its last span.
                n = -(-f.size // self.record)
                spans += [_Span(f.path, k, min(k + per, n), f.size) for k in range(0, n, per)]
        return spans

    def read(self, span) -> Iterator[pa.RecordBatch]:
        if span is None:  # no file has a record
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        kinds = pa.schema([("path", pa.string()), ("frame_index", pa.int64()), ("bgr", pa.binary()), ("error", pa.string())])
        step = max(1, BATCH_BYTES // self.record)
        with store.open_input_file(span.path) as f:
            for k in range(span.first, span.last, step):
                index = list(range(k, min(k + step, span.last)))
                raw = f.read_at(min(len(index) * self.record, span.size - k * self.record), k * self.record)
                parts = [raw[i * self.record:(i + 1) * self.record] for i in range(len(index))]
                whole = [len(x) == self.record for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([span.path] * len(index), pa.string()), pa.array(index, pa.int64()),
                                                  pa.array([x if ok else None for x, ok in zip(parts, whole)], pa.binary()),
                                                  pa.array([None if ok else "partial_record" for ok in whole], pa.string())], schema=kinds)


class RawFrames(DataSource):
    """Raw BGR24 dumps of any size: read in spans of whole records, never a file as one value.

    Options: path (a file or a folder, local or of any store that Arrow knows), width, height, split_bytes.
    """

    @classmethod
    def name(cls):
        return "raw_bgr"

    def schema(self):
        return RAW

    def reader(self, schema):
        return RawFrameReader(self.options)


def read_raw_frames(spark: SparkSession, path: str, width: int, height: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, frame_index, bgr and error: one row per record of the dumps under ``path``, a torn tail as one error row."""
    spark.dataSource.register(RawFrames)
    return spark.read.format("raw_bgr").options(width=width, height=height, split_bytes=split_bytes).load(path)


def write_raw_frames(frames: DataFrame, folder: str, by: str = "name") -> None:
    """Dumps ``folder/<by>.bgr`` of the frames' ``bgr`` bytes in order of frame_index.

    A task writes its files one after another as their sorted rows stream by, under names of its own, and moves a
    file to its place when it is whole; a task that is run again moves the same bytes there.
    """
    rows = frames.select(F.col(by).cast("string").alias("name"), "frame_index", "bgr").repartition("name").sortWithinPartitions("name", "frame_index")

    def write(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = out = at = None

        def close():
            out.close()
            store.move(at, f"{path}/{name}.bgr")
        for t in batches:
            for one, raw in zip(t["name"].to_pylist(), t["bgr"]):
                if one != name:
                    if out is not None:
                        close()
                        yield pa.RecordBatch.from_pydict({"name": [name]})
                    name, at = one, f"{path}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(at)
                out.write(raw.as_buffer())
        if out is not None:
            close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    rows.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
