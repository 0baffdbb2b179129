"""Depth from outside estimators: registered backends, fallback, and chunk alignment."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import materialize
from .depth import SHOT, image_cue_depth
from .ordered import block_of, carry_in, exact_quantiles, join_small, running_sum, with_previous

C = F.col
FALLBACK_RELIABILITY = 0.62  # fixed value: most a fallback shot may claim
Estimator = Callable[[np.ndarray], np.ndarray]
BACKENDS: dict[str, Estimator] = {}


def register_backend(name: str, fn: Estimator) -> None:
    """``fn`` takes colour frames [n, h, w, 3] and returns planes [n, h, w]."""
    BACKENDS[name] = fn


def run_backend(frames: DataFrame, name: str, chunk_frames: int = 32) -> tuple[DataFrame, DataFrame]:
    """Planes from a registered backend, and per shot how they came about.

    Frames go to the backend in chunks of a shot.  A wrong shape, a value that is not
    finite or an error in any chunk sends the whole shot to image analysis instead.
    """
    fn = BACKENDS[name]

    def estimate(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        keep = pdf[["video_id", "shot_id", "frame_index", "h", "w"]].reset_index(drop=True)
        h, w = int(pdf.h.iloc[0]), int(pdf.w.iloc[0])
        try:
            bgr = np.stack([np.stack([np.asarray(r[c], dtype=np.float64).reshape(h, w) for c in "bgr"], -1)
                            for r in pdf[["b", "g", "r"]].to_dict("records")])
            z = np.asarray(fn(bgr), dtype=np.float64)
            if z.shape != (len(pdf), h, w):
                raise ValueError("invalid_shape")
            if not np.isfinite(z).all():
                raise ValueError("not_finite")
            return keep.assign(z=list(z.reshape(len(pdf), -1)), error=None)
        except Exception as ex:  # noqa: BLE001 - any failure of outside code is data here
            return keep.assign(z=None, error=str(ex)[:1000])

    chunked = frames.select("video_id", "shot_id", "frame_index", "h", "w", "b", "g", "r", F.floor(C("frame_index") / chunk_frames).alias("chunk"))
    out = chunked.groupBy("video_id", "shot_id", "chunk").applyInPandas(
        estimate, "video_id long, shot_id long, frame_index long, h int, w int, z array<double>, error string")
    # Outside estimators are the costly step: their result is written once and read for both uses.
    out = materialize(out)
    how = out.groupBy(*SHOT).agg(F.max("error").alias("error_code")).withColumn("fallback_used", C("error_code").isNotNull())
    how = how.withColumn("backend", F.when(C("fallback_used"), "monocular-cues").otherwise(name))
    good = out.join(how.where("not fallback_used").select(*SHOT), SHOT, "left_semi").drop("error")
    again = frames.join(how.where("fallback_used").select(*SHOT), SHOT, "left_semi")
    planes = good.unionByName(image_cue_depth(again).select(*good.columns))
    return planes, how


def capped_reliability(stats: DataFrame, how: DataFrame) -> DataFrame:
    return stats.join(how, SHOT, "left").withColumn("reliability", F.when(
        C("fallback_used"), F.least(C("reliability"), F.lit(FALLBACK_RELIABILITY))).otherwise(C("reliability")))


def align_chunks(chunks: DataFrame, chunk_frames: int, overlap: int, keys: Sequence[str] = SHOT, block: int = 1024) -> DataFrame:
    """Bring overlapping chunks of relative depth to one scale and average where they overlap.

    ``chunks``: keys, chunk, frame_index, h, w, z, chunk k starting at k * (chunk_frames - overlap).
    Each chunk takes scale = ratio of interquartile ranges over the overlap (held to 0.1..10, 1 when
    its own range vanishes) and the offset that matches medians.  With at most half a chunk
    of overlap every overlap has one earlier chunk, so scales chain as y -> clip(c * y, lo, hi), which
    composes, and offsets are running sums.  With more, an overlap is the mean of several aligned
    chunks, whose quantiles depend on all their fits: see :func:`_streamed_fits`.
    """
    if not 0 <= overlap < chunk_frames:
        raise ValueError("overlap must be less than a chunk")
    if overlap > chunk_frames // 2:
        return _aligned(chunks, _streamed_fits(chunks, keys), keys)
    stride = chunk_frames - overlap
    local = C("frame_index") - C("chunk") * stride
    head = chunks.where((local < overlap) & (C("chunk") > 0)).select(*keys, "chunk", "frame_index", C("z").alias("cur"))
    tail = chunks.where(local >= stride).select(*keys, (C("chunk") + 1).alias("chunk"), "frame_index", C("z").alias("before"))
    cell = (head.join(tail, [*keys, "chunk", "frame_index"])
            .select(*keys, "chunk", F.explode_outer(F.arrays_zip("before", "cur")).alias("_c"))
            .select(*keys, "chunk", C("_c.before").cast("double").alias("before"), C("_c.cur").cast("double").alias("cur"))
            .where(~F.isnan("before") & ~F.isnan("cur") & (F.abs("before") < float("inf")) & (F.abs("cur") < float("inf"))))
    both = cell.select(*keys, "chunk", F.explode(F.array(F.struct(F.lit("p").alias("side"), C("before").alias("v")),
                                                         F.struct(F.lit("c").alias("side"), C("cur").alias("v")))).alias("_s")).select(*keys, "chunk", "_s.*")
    qs = exact_quantiles(both, [*keys, "chunk", "side"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75})
    pick = lambda side, e, n: F.max(F.when(C("side") == side, e)).alias(n)
    st = qs.groupBy(*keys, "chunk").agg(pick("p", C("m"), "mp"), pick("c", C("m"), "mc"),
                                        pick("p", C("q3") - C("q1"), "ip"), pick("c", C("q3") - C("q1"), "ic"))
    k = chunks.select(*keys, "chunk").distinct().join(st, [*keys, "chunk"], "left")
    flat = F.coalesce(C("ic") <= 1e-6, F.lit(False))
    first = C("mp").isNull()
    # y -> clip(c * y, lo, hi); a chunk without overlap keeps its own scale 1.
    c = F.when(first | flat, 0.0).otherwise(C("ip") / C("ic"))
    k = k.withColumn("_g", F.struct(c.alias("c"), F.when(first | flat, 1.0).otherwise(0.1).alias("lo"), F.when(first | flat, 1.0).otherwise(10.0).alias("hi")))
    rows = k.withColumn("_blk", block_of("chunk", block)).groupBy(*keys, "_blk").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "_g"))).alias("_r"))
    clip = lambda v, g: F.least(g["hi"], F.greatest(g["lo"], v))
    then = lambda f, g: F.struct((f["c"] * g["c"]).alias("c"), clip(f["lo"] * g["c"], g).alias("lo"), clip(f["hi"] * g["c"], g).alias("hi"))
    fns = rows.select(*keys, "_blk", F.aggregate(F.slice("_r", 2, block), C("_r")[0]["_g"], lambda f, r: then(f, r["_g"])).alias("_f"))
    enter = carry_in(fns, keys, "_f", then, lambda f, y: clip(f["c"] * y, f), F.lit(1.0), "_y")
    none = F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("chunk"), F.lit(0.0).alias("a"))), 1, 0)
    walked = F.aggregate("_r", F.struct(C("_y").alias("y"), none.alias("o")), lambda s, r: F.struct(
        clip(r["_g"]["c"] * s["y"], r["_g"]).alias("y"), F.concat(s["o"], F.array(F.struct(
            r["chunk"].cast("bigint").alias("chunk"), clip(r["_g"]["c"] * s["y"], r["_g"]).alias("a")))).alias("o")), lambda s: s["o"])
    scale = rows.join(enter, [*keys, "_blk"]).select(*keys, F.explode_outer(walked).alias("_o")).select(*keys, "_o.chunk", "_o.a")
    fit = with_previous(k.drop("_g").join(scale, [*keys, "chunk"]), keys, "chunk", ["a"], "_p")
    move = F.when(C("mp").isNull(), 0.0).otherwise(C("_p.a") * C("mp") - C("a") * C("mc"))
    fit = running_sum(fit, keys, "chunk", move, "offset").select(*keys, "chunk", "a", "offset")
    return _aligned(chunks, fit, keys)


def _aligned(chunks: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every frame's mean over its chunks (at most chunk / stride of them), each brought to its fit, in order of chunks."""
    one = join_small(chunks, fit, [*keys, "chunk"], C("frame_index")).select(*keys, "chunk", "frame_index", "h", "w", F.transform(
        "z", lambda v: v.cast("double") * C("a") + C("offset")).alias("z"))
    put = one.groupBy(*keys, "frame_index").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("chunk", "z"))).alias("_l"))
    total = F.aggregate(F.slice("_l", 2, F.size("_l")), C("_l")[0]["z"], lambda p, r: F.zip_with(p, r["z"], lambda x, y: x + y))
    return put.withColumn("z", F.transform(total, lambda v: v / F.size("_l"))).drop("_l")


def _streamed_fits(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, chunk, a, offset for overlaps of any length.

    A chunk's fit needs the fits of all it overlaps, so the chunks of a shot are fitted one after another;
    shots run side by side.  A task reads its shots sorted by chunk and frame as a stream of Arrow batches
    and holds one chunk and the summed planes of frames that may still be overlapped, however long a shot is.
    """
    keys = list(keys)
    rows = (chunks.select(*keys, "chunk", "frame_index", C("z").cast("array<double>").alias("z"))
            .repartition(*keys).sortWithinPartitions(*keys, "chunk", "frame_index"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fits(batches):
        shot, chunk, frames, planes, summed = None, None, [], [], {}
        done = []

        def close():
            # The frames that earlier chunks have too, as they were aligned, against the same frames here.
            both = [i for i, f in enumerate(frames) if f in summed]
            scale, offset = 1.0, 0.0
            if both:
                before = np.concatenate([summed[frames[i]][0] / summed[frames[i]][1] for i in both])
                here = np.concatenate([planes[i] for i in both])
                ok = np.isfinite(before) & np.isfinite(here)
                if ok.any():
                    b, h = np.percentile(before[ok], [25, 50, 75]), np.percentile(here[ok], [25, 50, 75])
                    scale = float(np.clip((b[2] - b[0]) / (h[2] - h[0]), 0.1, 10.0)) if h[2] - h[0] > 1e-6 else 1.0
                    offset = float(b[1] - scale * h[1])
            for f in [f for f in summed if f < frames[0]]:
                del summed[f]  # later chunks start no earlier
            for f, z in zip(frames, planes):
                total, n = summed.get(f, (0.0, 0))
                summed[f] = (total + (z * scale + offset), n + 1)
            done.append((*shot, chunk, scale, offset))

        for t in batches:
            k = list(zip(*[t[c].to_pylist() for c in keys]))
            at, index, z = t["chunk"].to_pylist(), t["frame_index"].to_pylist(), t["z"]
            for i in range(t.num_rows):
                if (k[i], at[i]) != (shot, chunk):
                    if frames:
                        close()
                    if k[i] != shot:
                        summed = {}
                    shot, chunk, frames, planes = k[i], at[i], [], []
                frames.append(index[i])
                planes.append(z[i].values.to_numpy(zero_copy_only=False).astype(np.float64))
            if done:
                yield _fit_batch(done, keys, t.schema)
                done.clear()
        if frames:
            close()
            yield _fit_batch(done, keys, t.schema)

    made = ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "chunk"])
    return rows.mapInArrow(fits, f"{made}, a double, offset double")


def _fit_batch(done: list, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [*(schema.field(c).type for c in [*keys, "chunk"]), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), kinds)], [*keys, "chunk", "a", "offset"])


def chunk_frames_of(planes: DataFrame, chunk_frames: int, overlap: int) -> DataFrame:
    """Planes listed once per chunk that covers them; the last chunk ends at the shot's end."""
    stride = chunk_frames - overlap
    n = planes.groupBy(*SHOT).agg(F.count(F.lit(1)).alias("_n"))
    last = F.greatest(F.lit(0), F.ceil((C("_n") - chunk_frames) / stride))
    ks = F.sequence(F.greatest(F.lit(0), F.floor((C("frame_index") - chunk_frames) / stride) + 1), F.least(F.floor(C("frame_index") / stride), last))
    return join_small(planes, n, SHOT, C("frame_index")).withColumn("chunk", F.explode(ks)).drop("_n")
