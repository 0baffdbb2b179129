"""Reading and writing JSON documents and depth tables."""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import grid as G

MAX_DOCUMENT_BYTES = 16 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names for intermediate tables; one of its own where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame used more than once to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_artifacts(spark: SparkSession, path: str, schema: StructType | str, max_bytes: int = MAX_DOCUMENT_BYTES,
                   optional: Sequence[str] = ()) -> DataFrame:
    """One JSON document per file under ``path``, at any depth, against a strict schema.

    ``error`` is set for files over ``max_bytes`` and for documents that do not parse,
    lack a field that is not ``optional``, have a value of the wrong type, or carry an unknown field.
    """
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = [f.name for f in schema.fields]
    # Looked up as plain files: as partitions, each of their folders would be a root path of its own.
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    f = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value"))
    f = f.withColumns({"doc": F.from_json("value", schema), "_keys": F.json_object_keys("value")})
    extra = F.array_except("_keys", F.array(*[F.lit(n) for n in names]))
    null = F.lit(False)
    for n in names:
        # An optional field may be absent or null, but what is there must fit its type.
        absent = F.get_json_object("value", f"$.{n}").isNull() if n in optional else F.lit(False)
        null = null | (F.col(f"doc.{n}").isNull() & ~absent)
    err = (F.when(F.col("size") > max_bytes, "too_large").when(F.col("_keys").isNull(), "not_an_object")
           .when(F.size(extra) > 0, "unknown_field").when(null, "bad_field"))
    return f.withColumn("error", err).drop("_keys", "value")


def write_documents(docs: DataFrame, folder: str) -> None:
    """One file per document, ``name`` with the text ``value``, in 256 folders by a hash of the name.

    Tasks write their files side by side; one that is run again writes the same bytes again.  Spark's own
    partitioned writer makes a folder a document, which its committer and the listing then take one by one.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for t in batches:
            for name, value in zip(t["name"].to_pylist(), t["value"].to_pylist(), strict=True):
                at = f"{path}/{zlib.crc32(name.encode()) % 256:02x}"
                if at not in made:
                    store.create_dir(at, recursive=True)
                    made.add(at)
                with store.open_output_stream(f"{at}/{name}") as out:
                    out.write(value.encode())
        yield from ()

    docs.select("name", "value").repartition(parts, "name").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def write_artifacts(df: DataFrame, path: str, version: int) -> str:
    """Write a whole version or nothing: a new folder per version, published by Spark's committer."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").json(target)
    return target


def cluster_planes(planes: DataFrame) -> DataFrame:
    """Planes in order of video, shot and frame over ranges of these, so files do not grow in number with the shots."""
    order = ["video_id", "shot_id", "frame_index"]
    return planes.repartitionByRange(*order).sortWithinPartitions(*order)


def write_depth(planes: DataFrame, path: str) -> None:
    """Depth planes in order of video, shot and frame; ``z`` normalised, ``raw`` optional."""
    out = planes if "raw" in planes.columns else planes.withColumn("raw", F.lit(None).cast("array<float>"))
    as_float = lambda c: F.transform(c, lambda v: v.cast("float")).alias(c)
    (cluster_planes(out.select("video_id", "shot_id", "frame_index", "h", "w", as_float("z"), as_float("raw")))
     .write.mode("overwrite").parquet(path))


def read_depth(spark: SparkSession, path: str, prefer_raw: bool = False) -> DataFrame:
    """Depth planes with ``error`` where a plane is empty, misshapen, not finite or outside [0, 1]."""
    d = spark.read.parquet(path)
    use = F.coalesce("raw", "z") if prefer_raw else F.col("z")
    normal = F.col("raw").isNull() if prefer_raw else F.lit(True)
    d = d.withColumns({"_use": use, "_normal": normal})
    err = (F.when(F.col("_use").isNull() | (F.size("_use") == 0), "empty")
           .when(F.size("_use") != F.col("h") * F.col("w"), "shape")
           .when(F.exists("_use", lambda v: ~G.finite(v)), "not_finite")
           .when(F.col("_normal") & F.exists("_use", lambda v: (v < 0) | (v > 1)), "range"))
    return d.select(F.col("video_id").cast("bigint").alias("video_id"), F.col("shot_id").cast("bigint").alias("shot_id"),
                    "frame_index", "h", "w", F.col("_use").alias("z"), err.alias("error"))


def import_cached(manifest: DataFrame, external: DataFrame) -> DataFrame:
    """Per shot: ok, or why an outside depth table cannot be used.

    Both: video_id, shot_id, frame_count, h, w, content_hash.
    """
    key = ["video_id", "shot_id"]
    e = external.select(*key, F.struct("frame_count", "h", "w", "content_hash").alias("_e"))
    why = (F.when(F.col("_e").isNull(), "missing").when(F.col("_e.frame_count") != F.col("frame_count"), "frame_count")
           .when((F.col("_e.h") > F.col("h")) | (F.col("_e.w") > F.col("w")), "grid")
           .when(F.col("_e.content_hash") != F.col("content_hash"), "changed").otherwise("ok"))
    return manifest.join(e, key, "left").select(*key, why.alias("outcome"))
