"""Decision rules as column expressions, and the fixed values they use."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Treatment presets, parameter limits, rule thresholds.
PARAMS = ("depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm", "temporal_smoothing",
          "transition_frames", "edge_protection")
PRESETS = {
    "dialogue_subtle": (0.55, 0.58, 0.007, 0.002, 0.90, 10, True),
    "action_controlled": (0.68, 0.54, 0.008, 0.0025, 0.72, 4, True),
    "vista_deep": (0.90, 0.70, 0.010, 0.001, 0.92, 12, True),
    "closeup_flat": (0.38, 0.72, 0.005, 0.001, 0.94, 10, True),
    "neutral": (0.45, 0.55, 0.006, 0.0, 0.92, 8, True),
}
COMFORT = {
    "max_popout_disparity_norm": 0.004, "max_background_disparity_norm": 0.010, "max_depth_strength": 1.0, "max_convergence_change": 0.18,
    "high_motion_threshold": 0.68, "high_motion_reduction": 0.72, "low_reliability_threshold": 0.55, "unreliable_depth_reduction": 0.60,
    "low_confidence_threshold": 0.55,
}
MIN_CONFIDENCE = 0.55
ACTIONS = {
    "depth_strength_clamped": "Depth strength exceeded the project limit",
    "popout_clamped": "Foreground disparity exceeded the project limit",
    "background_clamped": "Background disparity exceeded the project limit",
    "reduced_due_to_high_motion": "Rapid image motion reduced stereo magnitude",
    "popout_reduced_due_to_high_motion": "Rapid image motion reduced foreground disparity",
    "reduced_due_to_unreliable_depth": "Low depth confidence reduced stereo magnitude",
    "popout_disabled_due_to_low_confidence": "Low direction confidence disables foreground pop-out",
    "popout_disabled_due_to_edge_violation": "Foreground at the image boundary disables pop-out",
    "convergence_change_clamped": "Shot-to-shot convergence jump exceeded the comfort limit",
}
RELEASE_BACKENDS = ("video-depth-anything-small", "monocular-cues")
BACKEND_ALIASES = {
    "synthetic": "synthetic", "cached": "cached", "precomputed": "cached",
    "monocular-cues": "monocular-cues", "monocular": "monocular-cues", "image-analysis": "monocular-cues",
    "video-depth-anything-small": "video-depth-anything-small", "vda-small": "video-depth-anything-small",
    "video-depth-anything": "video-depth-anything-small",
}


def preset_table(spark: SparkSession) -> DataFrame:
    """The five presets (a fixed-size table, safe to broadcast)."""
    return spark.createDataFrame(
        [(k, *v) for k, v in PRESETS.items()],
        "preset string, depth_strength double, convergence_depth_percentile double, max_background_disparity_norm double, max_popout_disparity_norm double, "
        "temporal_smoothing double, transition_frames int, edge_protection boolean")


def select_preset(speech="speech_ratio", motion="motion_score", spread="depth_spread",
                  near="foreground_ratio") -> tuple[Column, Column]:
    """(preset, confidence): the first rule that holds decides."""
    s, m, d, f = (F.col(c) for c in (speech, motion, spread, near))
    rules = [
        ((s >= 0.48) & (m <= 0.62), "dialogue_subtle", F.least(F.lit(0.96), s * 0.25 + 0.65 - m * 0.10)),
        ((d <= 0.24) & (f >= 0.30) & (m <= 0.45), "closeup_flat", F.least(F.lit(0.94), f * 0.20 + 0.66)),
        ((m >= 0.58) & (s < 0.45), "action_controlled", F.least(F.lit(0.94), m * 0.25 + 0.60)),
        ((m <= 0.34) & (d >= 0.48) & (f <= 0.28), "vista_deep", F.least(F.lit(0.94), d * 0.25 + 0.62)),
    ]
    preset, conf = F, F
    for cond, name, c in rules:
        preset, conf = preset.when(cond, name), conf.when(cond, c)
    return preset.otherwise("neutral"), conf.otherwise(0.60)


def accept_suggestion(found: Column, preset: Column, confidence: Column, own_preset: Column,
                      own_confidence: Column, fallback: str = "rules") -> tuple[Column, Column, Column]:
    """(preset, confidence, source) from an outside suggestion with a safe fallback."""
    known = found & preset.isin(*PRESETS) & confidence.between(0.0, 1.0)
    low = confidence < MIN_CONFIDENCE
    back_p, back_c = (own_preset, own_confidence) if fallback == "rules" else (F.lit("neutral"), F.lit(0.5))
    ok = F.coalesce(known, F.lit(False))
    return (F.when(~ok, back_p).when(low, "neutral").otherwise(preset),
            F.when(~ok, back_c).otherwise(confidence),
            F.when(ok, "assistant").otherwise(f"{fallback}_fallback"))


def canonical_backend(name: Column) -> Column:
    """One spelling per backend; null when unknown."""
    table = F.create_map(*[F.lit(x) for kv in BACKEND_ALIASES.items() for x in kv])
    return F.get(F.array(F.try_element_at(table, F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-")))), F.lit(0))


def cut_context(duration: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), duration) / 8.0))
