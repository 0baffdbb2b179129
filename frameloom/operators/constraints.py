"""Rule tables: what every row of a table must satisfy, as data, checked in one pass.

A rule is (kind, column, *arguments); ``compile_rules`` turns a list of them into the named
conditions that ``ledger.violations`` takes.  Columns that may be null carry a trailing "?".
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import PARAMS, PRESETS
from .ledger import violations

C = F.col
SHA256 = "^[0-9a-f]{64}$"

# Limits of the documented tables (bounds are inclusive).
MAX_DIMENSION, MAX_PIXELS, MAX_FRAME_BYTES = 16_384, 36 * 1024 * 1024, 256 * 1024 * 1024
MAX_DISPARITY, MAX_TRANSITION = 0.05, 1000
ROTATIONS = (0, 90, 180, 270)
TRANSITIONS = ("cut", "fade", "start")
MOVEMENTS = ("static", "lateral", "vertical", "zoom", "unstable")
EMPHASES = ("low", "medium", "high")

ID = ("range", "shot_id", 1, None)
UNIT = lambda *names: [("range", n, 0, 1) for n in names]
PARAMETER_RULES = [
    ("range", "depth_strength", 0, 2), ("range", "convergence_depth_percentile", 0, 1),
    ("range", "max_background_disparity_norm", 0, MAX_DISPARITY), ("range", "max_popout_disparity_norm", 0, MAX_DISPARITY),
    ("range", "temporal_smoothing", 0, 1), ("range", "transition_frames", 0, MAX_TRANSITION), ("present", "edge_protection")]
TABLES: dict[str, list[tuple]] = {
    "media": [("range", "width", 1, MAX_DIMENSION), ("range", "height", 1, MAX_DIMENSION), ("above", "frame_rate", 0), ("range", "frame_rate", None, 1000),
              ("range", "duration_seconds", 0, None), ("range", "frame_count", 0, None), ("one_of_modulo", "rotation_degrees", 360, ROTATIONS),
              ("product", "pixels", ("width", "height"), 1, MAX_PIXELS), ("product", "frame_bytes", ("width", "height"), 3, MAX_FRAME_BYTES)],
    "shots": [ID, ("range", "start_frame", 0, None), ("range", "end_frame", 0, None), ("range", "start_time", 0, None), ("range", "end_time", 0, None),
              ("one_of", "transition", TRANSITIONS), ("ordered", "start_frame", "end_frame"), ("ordered", "start_time", "end_time")],
    "depth_meta": [ID, ("range", "frame_count", 1, None), ("range", "width", 1, None), ("range", "height", 1, None), ("present", "raw_min"), ("present", "raw_max"),
                   *UNIT("invalid_fraction", "reliability"), ("present", "backend"), ("matches", "backend_source_fingerprint?", SHA256)],
    "shot_features": [ID, ("range", "duration_seconds", 0, None), *UNIT("motion_score", "speech_ratio", "depth_spread", "foreground_ratio", "brightness",
                                                                      "cut_frequency_context", "depth_reliability"), ("one_of", "camera_movement", MOVEMENTS)],
    "recommendations": [("one_of", "preset", tuple(PRESETS)), *UNIT("narrative_importance", "confidence"), ("one_of", "stereo_emphasis", EMPHASES), ("length", "reason", 1, 500)],
    "script": [ID, ("one_of", "preset", tuple(PRESETS)), *UNIT("confidence"), *PARAMETER_RULES],
    "overrides": [ID, ("one_of", "preset", tuple(PRESETS)), ("matches", "expected_revision", SHA256), *PARAMETER_RULES],
    "coverage": [ID, ("range", "sampled_frames", 1, None), ("range", "total_frames", 1, None), ("ordered", "sampled_frames", "total_frames")],
}


def _holds(kind: str, name: str, args: Sequence) -> tuple[str, Column]:
    optional, name = name.endswith("?"), name.rstrip("?")
    c = C(name) if kind != "product" else None
    if kind == "range":
        low, high = args
        # Neither NaN nor an infinity is in a range, also where it has one end.
        ok = F.lit(True)
        for edge, good in ((low, lambda e: c >= e), (high, lambda e: c <= e)):
            ok = ok if edge is None else ok & good(edge)
        ok = ok & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    elif kind == "above":
        ok = (c > args[0]) & ~F.isnan(c.cast("double"))
    elif kind == "one_of":
        ok = c.isin(*args[0])
    elif kind == "one_of_modulo":
        ok = F.pmod(c, F.lit(args[0])).isin(*args[1])
    elif kind == "matches":
        ok = c.rlike(args[0])
    elif kind == "length":
        ok = F.char_length(c).between(*args)
    elif kind == "ordered":
        ok = C(args[0]) >= c
    elif kind == "present":
        ok = c.isNotNull()
    elif kind == "product":
        names, factor, high = args
        whole = F.lit(factor).cast("decimal(38,0)")
        for n in names:
            whole = whole * C(n).cast("decimal(12,0)")
        ok = whole <= high
    else:
        raise ValueError(f"unknown rule kind {kind}")
    label = {"range": f"{name}_range", "above": f"{name}_above_{args[0] if args else ''}", "one_of": f"{name}_unknown", "one_of_modulo": f"{name}_unknown",
             "matches": f"{name}_pattern", "length": f"{name}_length", "ordered": f"{name}_after_{args[0] if args else ''}", "present": f"{name}_missing",
             "product": f"{name}_limit"}[kind]
    return label, (c.isNull() | ok if optional else ok)


def compile_rules(rules: Sequence[tuple]) -> dict[str, Column]:
    """Condition by rule name, in the order given."""
    return dict(_holds(kind, name, args) for kind, name, *args in rules)


def table_violations(df: DataFrame, table: str) -> DataFrame:
    """``violations``: names of the rules of ``TABLES[table]`` that a row breaks; a null that may not be breaks them.

    Parameters may be columns or fields of a ``parameters`` struct.
    """
    inside = "parameters" in df.columns and set(PARAMS).isdisjoint(df.columns)
    flat = df.withColumns({p: C("parameters")[p] for p in PARAMS}) if inside and TABLES[table][-len(PARAMETER_RULES):] == PARAMETER_RULES else df
    out = violations(flat, compile_rules(TABLES[table]))
    return out.select(*df.columns, "violations")


def rule_counts(df: DataFrame, table: str, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Per key: rows, rows that break a rule, and how often each rule is broken (``broken``, a map of the broken ones)."""
    names = list(compile_rules(TABLES[table]))
    v = table_violations(df, table)
    hit = lambda n: F.array_contains("violations", n)
    counts = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.size("violations") > 0).alias("bad_rows"), *[F.count_if(hit(n)).alias(n) for n in names])
    told = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), C(n).alias("v")) for n in names]), lambda e: e["v"] > 0))
    return counts.select(*keys, "row_count", "bad_rows", told.alias("broken"))


def unique_problems(df: DataFrame, keys: Sequence[str], item: str = "shot_id") -> DataFrame:
    """Per key, how many items are there more than once."""
    n = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.count_if(C("_n") > 1).alias("repeated_items"))


def manifest_problems(shots: DataFrame, media: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Per video, whether its shots are one unbroken run over frames 0 to frame_count - 1, and what breaks it.

    ``shots`` with start_frame <= end_frame are steps from start to end + 1.  They are one run exactly if
    every frame number is left as often as it is entered, but for the first and last; so counts per frame
    number are enough and no video is sorted or gathered.
    """
    keys = list(keys)
    want = media.select(*keys, C("frame_count").cast("bigint").alias("_n"))
    step = lambda c, s, d: d.select(*keys, c.cast("bigint").alias("_at"), F.lit(s).alias("_s"))
    ends = [step(C("start_frame"), 1, shots), step(C("end_frame") + 1, -1, shots), step(F.lit(0), -1, want.where("_n > 0")), step(C("_n"), 1, want.where("_n > 0"))]
    points = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    net = points.groupBy(*keys, "_at").agg(F.sum("_s").alias("_s")).where("_s <> 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("breaks"))
    has = shots.groupBy(*keys).agg(F.count(F.lit(1)).alias("shots"), F.count_if(~F.coalesce(C("end_frame") >= C("start_frame"), F.lit(False))).alias("reversed"))
    j = has.join(unique_problems(shots, keys), keys, "left").join(want, keys, "full_outer").join(net, keys, "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    found = {"no_media": C("_n").isNull(), "reversed_range": none("reversed") > 0, "repeated_ids": none("repeated_items") > 0,
             "shots_of_nothing": (C("_n") == 0) & (none("shots") > 0),
             "not_contiguous": (C("_n") > 0) & (none("shots") > 0) & (none("breaks") > 0)}
    return j.select(*keys, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in found.items()])).alias("problems"))
