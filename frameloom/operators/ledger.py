"""Fingerprints, revisions, constraint checks and incremental runs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*cols: Column | str) -> Column:
    """sha256 of the parts' text, parts separated by a NUL (null parts read as empty)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def number_text(c: Column | str) -> Column:
    """A number in canonical text: nine decimals, or as it is where it has too many digits before the point."""
    n = F.col(c) if isinstance(c, str) else c
    return F.coalesce(n.try_cast("decimal(18,9)").cast("string"), n.cast("string"))


def tree_digest(rows: DataFrame, keys: Sequence[str], order: str, row_digest: Column, out: str = "revision",
                fan: int = 1024) -> DataFrame:
    """One sha256 per key over its ordered rows, built as a tree of bounded groups."""
    d = rows.select(*keys, F.col(order).cast("bigint").alias("_k"), row_digest.alias("_d"))
    for level in (fan, fan, None):
        at = F.floor(F.col("_k") / level) if level else F.lit(0).cast("bigint")
        d = (d.groupBy(*keys, at.alias("_up"))
             .agg(F.array_sort(F.collect_list(F.struct("_k", "_d"))).alias("_l"))
             .select(*keys, F.col("_up").alias("_k"), F.sha2(F.array_join(F.transform("_l", lambda s: s["_d"]), ""), 256).alias("_d")))
    return d.select(*keys, F.col("_d").alias(out))


def table_fingerprint(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a table's rows per key: count and sums of all parts of the row digests.

    A digest's 64 hex digits become four numbers, so sums combine before the shuffle.
    """
    parts = [F.conv(F.substring(digest(*cols), 1 + 16 * i, 16), 16, 10).cast("decimal(28,0)") for i in range(4)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", *[F.sum(n).cast("string") for n in parts]).alias("row_sum"))


def violations(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """Names of the rules a row breaks; a rule that is null counts as broken."""
    return df.withColumn(out, F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    v = violations(df, rules)
    return v.where(F.size("violations") == 0).drop("violations"), v.where(F.size("violations") > 0)


def coverage_check(have: DataFrame, want: DataFrame, keys: Sequence[str], item: str, position: str | None = None) -> DataFrame:
    """Per key: wanted items missing, foreign items, repeats, and (with ``position``) items out of order."""
    agg = [F.count(F.lit(1)).alias("_times")]
    if position:
        agg.append(F.min(position).alias("_at"))
    h = have.groupBy(*keys, item).agg(*agg)
    w = want.select(*keys, item, F.lit(1).alias("_w"), *([F.col(position).alias("_due")] if position else []))
    j = h.join(w, [*keys, item], "full_outer")
    num = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    out = [num(F.col("_times").isNull()).alias("missing"), num(F.col("_w").isNull()).alias("foreign_items"),
           num(F.col("_times") > 1).alias("duplicates")]
    if position:
        out.append(num(F.col("_at") != F.col("_due")).alias("misplaced"))
    r = j.groupBy(*keys).agg(*out)
    bad = F.col("missing") + F.col("foreign_items") + F.col("duplicates") + (F.col("misplaced") if position else F.lit(0))
    return r.withColumn("exact", bad == 0)


def missing_refs(refs: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return refs.join(known.select(*keys), list(keys), "left_anti")


def join_shot_tables(tables: dict[str, DataFrame], keys: Sequence[str] = ("video_id", "shot_id")) -> DataFrame:
    """Shots with their row of every table, none lost: keys, a struct per table, ``missing``.

    ``missing`` lists the tables that lack the shot, in the order given; a shot that any table
    names has a row, so a missing partner is an error to read, not a row that vanishes.  Keys are
    distinct in each table.  One full join per table, all on the same keys.
    """
    out = None
    for name, df in tables.items():
        own = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
        out = own if out is None else out.join(own, list(keys), "full_outer")
    gone = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in tables]))
    return out.withColumn("missing", gone)


def sets_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Per key, whether the two sides hold the same set of items."""
    tag = lambda d, k: d.select(*keys, item).distinct().withColumn("_side", F.lit(k))
    both = tag(a, 1).unionByName(tag(b, 2)).groupBy(*keys, item).agg(F.sum("_side").alias("_s"))
    return both.groupBy(*keys).agg(F.min(F.col("_s") == 3).alias("same"))


def pending_stages(wanted: DataFrame, ledger: DataFrame, engine: str, algorithm: str,
                   force: Sequence[str] = ()) -> DataFrame:
    """Stage runs that cannot be reused, and why.

    ``wanted``: video_id, stage, fingerprint, dependency_fingerprint, output_fingerprints.
    A ledger row is reusable only when it is complete, has the same versions and
    fingerprint, and its recorded outputs still match.  What is null on either side counts as
    not matching, so lost outputs and half-written ledger rows are never reused.
    """
    key = ["video_id", "stage"]
    led = ledger.select(*key, F.struct("status", "fingerprint", "dependency_fingerprint", "output_fingerprints",
                                       "engine_version", "algorithm_version").alias("_l"))
    j = wanted.join(led, key, "left")
    out = lambda c: F.array_sort(F.map_entries(c))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))  # noqa: E731  unknown is not the same
    why = (F.when(F.col("stage").isin(*force) if force else F.lit(False), "forced")
           .when(F.col("_l").isNull(), "never_run")
           .when(~same(F.col("_l.engine_version"), F.lit(engine)) | ~same(F.col("_l.algorithm_version"), F.lit(algorithm)), "version_changed")
           .when(~same(F.col("_l.status"), F.lit("complete")), "not_complete")
           .when(~same(F.col("_l.fingerprint"), F.col("fingerprint")), "input_changed")
           .when(F.coalesce(F.size("_l.output_fingerprints") <= 0, F.lit(True)), "no_outputs")
           .when(~same(out(F.col("_l.output_fingerprints")), out(F.col("output_fingerprints"))), "output_changed"))
    deps = F.coalesce((F.col("_l.status") == "complete")
                      & (F.col("_l.dependency_fingerprint") == F.col("dependency_fingerprint")), F.lit(False))
    return (j.withColumn("reason", why).withColumn("dependencies_current", deps).where("reason is not null").drop("_l"))


def release_gate(depth_meta: DataFrame, shots: DataFrame, grid: tuple[int, int], max_shot_frames: int | None = None,
                 backends: Sequence[str] = ()) -> DataFrame:
    """Per video, the first reason its depth may not ship (null when it may); shots of any length, unless a limit is given."""
    key = ["video_id", "shot_id"]
    j = depth_meta.join(shots.select(*key, (F.col("end_frame") - F.col("start_frame") + 1).alias("_want")), key, "full_outer")
    any_ = lambda c: F.max(F.coalesce(c, F.lit(True)))
    g = j.groupBy("video_id").agg(
        any_(F.col("_want").isNull() | F.col("frame_count").isNull()).alias("cover"),
        any_(~F.col("video_backend").isin(*backends)).alias("vb"),
        any_(~F.col("backend").isin(*backends)).alias("sb"),
        any_((F.col("frame_count") != F.col("_want")) | (F.lit(False) if max_shot_frames is None else F.col("_want") > max_shot_frames)
             | (F.col("height") != grid[0]) | (F.col("width") != grid[1])).alias("dim"),
        any_(~F.col("ledger_current")).alias("stale"))
    return g.select("video_id", F.when(F.col("cover"), "coverage").when(F.col("vb"), "backend")
                    .when(F.col("sb"), "shot_backend").when(F.col("dim"), "dimensions")
                    .when(F.col("stale"), "stale_stage").alias("reason"))


def depth_limits(shots: DataFrame, h: int, w: int, configured: int | None = None,
                 budget_bytes: int | None = None, bytes_per_cell: int = 18) -> DataFrame:
    """Shots longer than the configured or the memory limit, one row each with the video's longest.

    Without either limit no shot is too long: smoothing here runs in blocks of any number.
    """
    limits = [x for x in (configured, None if budget_bytes is None else max(1, budget_bytes // (h * w * bytes_per_cell))) if x is not None]
    limit = min(limits, default=2 ** 62)
    n = F.col("end_frame") - F.col("start_frame") + 1
    s = shots.withColumn("frames", n)
    longest = s.groupBy("video_id").agg(F.max("frames").alias("longest_shot_frames"))
    return (s.where(F.col("frames") > limit).join(longest, "video_id")
            .select("video_id", "shot_id", "frames", F.lit(limit).alias("max_shot_frames"), "longest_shot_frames"))


def depth_status(depth_meta: DataFrame, ready: DataFrame, certified: str = "video-depth-anything-small") -> DataFrame:
    """How each video's depth was measured, and how many shots were synthetic, fell back or failed.

    ``ready``: video_id, reason (null = may ship), as from :func:`release_gate`.
    """
    m = depth_meta.groupBy("video_id").agg(
        F.max(F.coalesce(F.col("video_backend") == "synthetic", F.lit(False))).alias("_vs"),
        F.sum(F.when(F.col("backend") == "synthetic", 1).otherwise(0)).cast("bigint").alias("synthetic_shots"),
        F.sum(F.when(F.col("fallback_used"), 1).otherwise(0)).cast("bigint").alias("fallback_shots"),
        F.sum(F.when(F.col("error_code").isNotNull(), 1).otherwise(0)).cast("bigint").alias("failed_shots"),
        F.min(F.col("backend") == certified).alias("_cert"))
    j = m.join(ready, "video_id", "left")
    return j.select("video_id", F.col("reason").isNull().alias("production_ready"),
                    F.when((F.col("synthetic_shots") > 0) | F.col("_vs"), "synthetic")
                    .when(F.col("reason").isNotNull(), "unknown").when(F.col("_cert"), "certified")
                    .otherwise("image-analysis").alias("tier"),
                    "synthetic_shots", "fallback_shots", "failed_shots")
