"""A project that is brought up to date: each stage runs only for the videos whose inputs changed.

What a stage gives is written first, under the number of the run; only then do its ledger rows
name it.  A run that is lost in between leaves a folder that no row names, and the next run with
that number overwrites it, so there is no half entry to mistake for a whole one.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import depth as D
from ..operators import direct as X
from ..operators import ledger as L
from ..operators import quality as K
from ..sources.artifacts import materialize
from . import jobs as P

C = F.col
ENGINE, ALGORITHM = "1", "1"
KEY = ["video_id", "stage"]
LEDGER = ("run bigint, video_id bigint, stage string, status string, fingerprint string, dependency_fingerprint string, "
          "output_fingerprints map<string,string>, engine_version string, algorithm_version string, completed_at timestamp")
#: What each stage gives.
TABLES = {"shots": ["shots"], "depth": ["planes", "stats"], "features": ["features", "edge"], "direct": ["script"],
          "render": ["rendered"], "quality": ["shots_qc", "report"]}


class Project:
    """Tables and ledger of many videos under one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def ledger(self) -> DataFrame:
        """All rows ever written, oldest runs included."""
        path = f"{self.folder}/ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if self._there(path) else self.spark.createDataFrame([], LEDGER)

    def current(self) -> DataFrame:
        """The last row of each video and stage."""
        rest = [c for c in self.ledger().columns if c not in KEY]
        return self.ledger().groupBy(*KEY).agg(F.max_by(F.struct(*rest), "run").alias("_l")).select(*KEY, "_l.*")

    def table(self, stage: str, name: str) -> DataFrame | None:
        """What the ledger's current rows name; None before the first run."""
        path = f"{self.folder}/{stage}/{name}"
        if not self._there(path):
            return None
        now = self.current().where((C("stage") == stage) & (C("status") == "complete")).select("video_id", "run")
        return self.spark.read.parquet(path).join(now, ["video_id", "run"], "left_semi").drop("run")

    @staticmethod
    def fingerprints(df: DataFrame | None, name: str) -> DataFrame | None:
        """video_id and a text that its rows of a table decide, whatever their order."""
        if df is None:
            return None
        f = L.table_fingerprint(df, ["video_id"], [c for c in df.columns if c != "video_id"])
        return f.select("video_id", F.concat_ws(":", "row_count", "row_sum").alias(name))

    def _outputs(self, videos: DataFrame, stage: str) -> DataFrame:
        """video_id and the fingerprints of what is stored for it now."""
        out = videos
        for name in TABLES[stage]:
            own = self.fingerprints(self.table(stage, name), name)
            out = out.withColumn(name, F.lit(None).cast("string")) if own is None else out.join(own, "video_id", "left")
        pairs = [x for n in TABLES[stage] for x in (F.lit(n), F.coalesce(n, F.lit("0")))]
        none = reduce(lambda a, b: a & b, [C(n).isNull() for n in TABLES[stage]])
        return out.select("video_id", F.when(~none, F.create_map(*pairs)).alias("output_fingerprints"))

    def stage(self, run: int, name: str, videos: DataFrame, sources: dict[str, DataFrame], marks: dict[str, DataFrame], needs: Sequence[str], settings: str,
              make: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]], force: Sequence[str] = ()) -> DataFrame:
        """Runs a stage for the videos that need it; gives these and why.  ``marks`` are the sources' fingerprints.

        Its fingerprint is that of its settings, of its source tables and of what the stages it
        needs have given, so a stage that gives the same again starts nothing after it.
        """
        wanted, parts = videos, []
        for k in sources:
            wanted = wanted.join(marks[k].withColumnRenamed("mark", f"_{k}"), "video_id", "left")
            parts.append(f"_{k}")
        now = self.current()
        for k in needs:
            own = now.where((C("stage") == k) & (C("status") == "complete"))
            told = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("output_fingerprints"))))
            wanted = wanted.join(own.select("video_id", told.alias(f"_{k}")), "video_id", "left")
            parts.append(f"_{k}")
        wanted = wanted.join(self._outputs(videos, name), "video_id").select(
            "video_id", F.lit(name).alias("stage"), L.digest(F.lit(settings), *parts).alias("fingerprint"),
            L.digest(*parts).alias("dependency_fingerprint"), "output_fingerprints")
        wanted = materialize(wanted)
        todo = materialize(L.pending_stages(wanted, now.where(C("stage") == name), ENGINE, ALGORITHM, force))
        if todo.isEmpty():
            return todo.select(*KEY, "reason")
        only = lambda df: df if df is None else df.join(todo.select("video_id"), "video_id", "left_semi")
        tables = {t: only(self.table(k, t)) for k in needs for t in TABLES[k]}
        for t, df in make({**{k: only(df) for k, df in sources.items()}, **tables}, todo).items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{t}/run={run}")
        rows = todo.select("video_id", "fingerprint", "dependency_fingerprint")
        for t in TABLES[name]:
            rows = rows.join(self.fingerprints(self.spark.read.parquet(f"{self.folder}/{name}/{t}/run={run}"), t), "video_id", "left")
        out = F.create_map(*[x for t in TABLES[name] for x in (F.lit(t), F.coalesce(t, F.lit("0")))])
        rows.select(F.lit(run).cast("bigint").alias("run"), "video_id", F.lit(name).alias("stage"), F.lit("complete").alias("status"), "fingerprint",
                    "dependency_fingerprint", out.alias("output_fingerprints"), F.lit(ENGINE).alias("engine_version"),
                    F.lit(ALGORITHM).alias("algorithm_version"), F.current_timestamp().alias("completed_at")).write.mode("append").parquet(f"{self.folder}/ledger")
        return todo.select(*KEY, "reason")

    def update(self, frames: DataFrame, spans: DataFrame, upto: str = "quality", force: Sequence[str] = (), threshold: float = 27.0,
               min_gap: int = 12, ref_width: int | None = None, backend: str | None = None) -> DataFrame:
        """Brings all stages up to ``upto`` up to date with the frames and speech spans: video_id, stage, reason of what ran."""
        run = (self.ledger().agg(F.max("run")).first()[0] or 0) + 1
        videos = materialize(frames.select("video_id").distinct())
        marks = {k: materialize(self.fingerprints(df, "mark")) for k, df in (("frames", frames), ("spans", spans))}
        width = None if ref_width is None else F.lit(ref_width)

        def depth(t, _):
            planes, stats = P.estimate_depth(t["frames"], t["shots"], backend=backend)
            return {"planes": planes, "stats": stats}

        def features(t, _):
            return {"features": P.extract_features(t["frames"], t["planes"], t["stats"], t["shots"], t["spans"]), "edge": D.edge_near_shots(t["planes"])}

        def direct(t, _):
            return {"script": X.guard_for_render(materialize(P.direct(t["features"], t["edge"], t["shots"])), P.hard_cut())}

        def quality(t, _):
            good = materialize(K.frame_qc(t["rendered"].where("error is null")))
            shots = K.with_actions(K.shot_qc(good), t["script"], t["stats"].select(*P.SHOT, "fallback_used", "error_code"))
            return {"shots_qc": shots, "report": K.qc_report(shots, P.media_of(t["frames"], t["rendered"], t["stats"]))}

        plan = [
            ("shots", {"frames": frames}, [], f"{threshold} {min_gap}", lambda t, _: {"shots": P.find_shots(t["frames"], threshold, min_gap)}),
            ("depth", {"frames": frames}, ["shots"], f"{backend}", depth),
            ("features", {"frames": frames, "spans": spans}, ["shots", "depth"], "", features),
            ("direct", {}, ["shots", "features"], "", direct),
            ("render", {"frames": frames}, ["shots", "depth", "direct"], f"{ref_width}",
             lambda t, _: {"rendered": P.render(t["frames"], t["planes"], t["shots"], t["script"], ref_width=width)}),
            ("quality", {"frames": frames}, ["depth", "direct", "render"], "", quality),
        ]
        ran = self.spark.createDataFrame([], "video_id bigint, stage string, reason string")
        for name, sources, needs, settings, make in plan:
            ran = ran.unionByName(self.stage(run, name, videos, sources, marks, needs, settings, make, force))
            if name == upto:
                break
        return ran
