"""Questions about whole projects: selection, search, recent items, readiness, recovery."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import join_small

C = F.col
REVISION = r"^[0-9a-f]{64}$"


def select_shots(shots: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("video_id", "shot_id")) -> tuple[DataFrame, DataFrame]:
    """The wanted shots, and the videos for which nothing is left."""
    kept = shots.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    empty = wanted.select("video_id").distinct().join(kept.select("video_id").distinct(), "video_id", "left_anti")
    return kept, empty


def search_shots(shots: DataFrame, text: str = "", warnings_only: bool = False, name: str = "name",
                 id: str = "shot_id", status: str = "status") -> DataFrame:
    cond = F.lit(True)
    if text:
        cond = F.contains(F.lower(name), F.lit(text.lower())) | F.contains(C(id).cast("string"), F.lit(text))
    if warnings_only:
        cond = cond & (C(status) == "warning")
    return shots.where(cond)


def pending_renders(shots: DataFrame, rendered: DataFrame, rendering: DataFrame, keys: Sequence[str] = ("video_id", "shot_id")) -> DataFrame:
    return (shots.join(rendered.select(*keys), list(keys), "left_anti")
            .join(rendering.select(*keys), list(keys), "left_anti"))


def recent_items(items: DataFrame, group: Sequence[str], item: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """Newest ``n`` items per group after a repeated item replaces its older self.

    The replacement combines before the shuffle; the rank limit is pushed below it too.
    """
    rest = [c for c in items.columns if c not in (*group, item)]
    newest = items.groupBy(*group, item).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*group, item, "_r.*")
    w = Window.partitionBy(*group).orderBy(*[C(o).desc() for o in order])
    return newest.withColumn("place", F.row_number().over(w)).where(C("place") <= n)


def select_range(shots: DataFrame, picks: DataFrame, keys: Sequence[str] = ("video_id",), order: str = "shot_id") -> DataFrame:
    """Shots between two picked shots (``pick_a``, ``pick_b``), in either direction."""
    return join_small(shots, picks, keys, C(order)).where(
        C(order).between(F.least("pick_a", "pick_b"), F.greatest("pick_a", "pick_b")))


def toggle_selection(current: DataFrame, picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric difference: picked items leave the selection when in it and join it otherwise."""
    both = current.select(*keys).distinct().withColumn("_n", F.lit(1)).unionByName(
        picked.select(*keys).distinct().withColumn("_n", F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n = 1").drop("_n")


def project_summary(projects: DataFrame, parts: dict[str, DataFrame], key: str = "video_id") -> DataFrame:
    """Projects with every available per-project table side by side; what is missing is null."""
    out = projects
    for name, df in parts.items():
        cols = [c for c in df.columns if c != key]
        out = out.join(df.select(key, F.struct(*cols).alias(name)), key, "left")
    return out


# The reasons shown for a closed gate.
REASONS = {
    "metadata": "Inspecting source timing and streams", "shot_navigation": "Finding shot boundaries",
    "shot_metrics": "Sampling representative frames for every shot", "director_edit": "Building the quick Director draft",
    "assistant_analysis": "Shot features and direction must finish first",
    "preview_early": "Direction must finish first", "preview_late": "Full-frame analysis is required for previews",
    "export_synthetic": "Synthetic test depth carries no scene geometry and cannot be exported",
    "export_late": "Run full-frame analysis to check final export readiness", "export_early": "Measured depth and direction must finish first",
}


def workspace_gates(a: DataFrame) -> DataFrame:
    """Eight capability reasons per project; null means open.

    Input flags: project_created, media_ready, normalized_ready, shots_valid, features_cover,
    script_cover, script_revision, analysis_tier, draft_valid, depth_mode.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    media = no(C("project_created") & C("media_ready"))
    shots = media & no(C("normalized_ready")) & no(C("shots_valid"))
    script = no(C("script_revision").rlike(REVISION)) & no(C("script_cover"))
    tier = no((C("analysis_tier") == "production") | ((C("analysis_tier") == "sampled") & C("draft_valid")))
    ready = shots & no(C("features_cover")) & script & tier
    full = ready & no(C("analysis_tier") == "production")
    depth = shots & no(C("depth_mode") != "unknown")
    shut = lambda ok, why: F.when(~ok, why)
    return a.select(
        "video_id", F.lit(None).cast("string").alias("source_monitor"), shut(media, REASONS["metadata"]).alias("metadata"),
        shut(shots, REASONS["shot_navigation"]).alias("shot_navigation"), shut(ready, REASONS["shot_metrics"]).alias("shot_metrics"),
        shut(ready, REASONS["director_edit"]).alias("director_edit"),
        shut(full & depth, F.when(ready, REASONS["preview_late"]).otherwise(REASONS["preview_early"])).alias("preview_render"),
        shut(ready, REASONS["assistant_analysis"]).alias("assistant_analysis"),
        shut(full & no(C("depth_mode").isin("production", "image-analysis")),
             F.when(C("depth_mode") == "synthetic", REASONS["export_synthetic"]).when(ready, REASONS["export_late"])
             .otherwise(REASONS["export_early"])).alias("final_export"))


PRODUCTION_STAGES = ("estimate_depth", "extract_features", "direct")


def recover_tier(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """The furthest analysis tier that complete stages and valid tables prove, or null.

    ``projects``: video_id, shots_valid, features_cover, script_cover, revision, draft_valid, depth_mode.
    ``stages``: video_id, stage, status.
    """
    done = stages.groupBy("video_id").agg(
        (F.count_distinct(F.when((C("status") == "complete") & C("stage").isin(*PRODUCTION_STAGES), C("stage"))) == len(PRODUCTION_STAGES)).alias("_full"),
        F.max((C("status") == "complete") & (C("stage") == "analyze_draft")).alias("_draft"))
    no = lambda c: F.coalesce(c, F.lit(False))
    full = no(C("_full")) & no(C("features_cover")) & no(C("script_cover")) & no(C("revision").rlike(REVISION)) & no(C("depth_mode").isin("production", "synthetic"))
    return projects.join(done, "video_id", "left").select("video_id", F.when(no(C("shots_valid")), F.when(full, "production").when(
        no(C("_draft")) & no(C("draft_valid")), "sampled")).alias("tier"))
