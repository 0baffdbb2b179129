"""Choosing bounded treatments per shot: presets, comfort limits, manual edits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.grid import let
from ..sources.artifacts import materialize
from .ordered import BLOCK, FAN, block_of, carry_in, emit_states

VIDEO = ["video_id"]
BIG = 1e9


def _entry(p: Column, q: Column) -> Column:
    return F.struct((-q).alias("nq"), (-p).alias("np"))


def _prune(pairs: Column) -> Column:
    """Keep the pairs that can still be the maximum of min(p, y + q) for y in [0, 1]."""
    tidy = F.transform(F.filter(pairs, lambda e: e["nq"] <= 1), lambda e: F.when(
        e["nq"] <= e["np"], F.struct(F.lit(-BIG).alias("nq"), e["np"].alias("np"))).otherwise(e))
    return F.aggregate(F.array_sort(tidy), F.slice(tidy, 1, 0), lambda acc, e: F.when(
        (F.size(acc) == 0) | (e["np"] < F.get(acc, F.size(acc) - 1)["np"]), F.concat(acc, F.array(e))).otherwise(acc))


def carried_clamp(rows: DataFrame, value: str, limit: float, restart: Column, keys: Sequence[str] = VIDEO,
                  order: str = "shot_id", out: str = "applied", had: str = "had_previous",
                  block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """y = value held within ``limit`` of the row before's y; y = value on restart.  Values lie in [0, 1].

    One step is y -> max(min(value, y + limit), y - limit).  Such steps compose to
    max over pairs of min(p, y + q), with a handful of pairs because y spans [0, 1],
    so blocks of rows are summarised and chained instead of walking a whole key.  The blocks are
    written once: both passes read them there, and what gave the rows runs once however many limits are stacked.
    """
    rest = [c for c in rows.columns if c not in keys]
    row = F.struct(F.col(order).alias("k"), F.col(value).alias("x"), F.coalesce(restart, F.lit(False)).alias("hard"), F.struct(*rest).alias("m"))
    blocks = materialize(rows.withColumn("_blk", block_of(order, block)).groupBy(*keys, "_blk")
                         .agg(F.array_sort(F.collect_list(row)).alias("_rows")))
    step = lambda it: F.when(it["hard"], F.array(_entry(it["x"], F.lit(BIG)))).otherwise(
        F.array(_entry(it["x"], F.lit(limit)), _entry(F.lit(BIG), F.lit(-limit))))

    def then(f: Column, g: Column) -> Column:
        pairs = F.flatten(F.transform(f, lambda a: F.transform(g, lambda b: F.struct(
            (a["nq"] + b["nq"]).alias("nq"), F.greatest(b["np"], a["np"] + b["nq"]).alias("np")))))
        return let(pairs, _prune)

    run = lambda f, y: F.array_max(F.transform(f, lambda e: F.least(-e["np"], y - e["nq"])))
    def fold(f: Column, it: Column) -> Column:
        """Add one row to a block's function; after a restart it is a constant and stays cheap."""
        y = -f[0]["np"]
        constant = (F.size(f) == 1) & (f[0]["nq"] < -BIG / 2)
        held = F.greatest(F.least(it["x"], y + limit), y - limit)
        return (F.when(it["hard"], F.array(_entry(it["x"], F.lit(BIG)))).when(constant, F.array(_entry(held, F.lit(BIG))))
                .otherwise(then(f, step(it))))

    # x0 is the first value of the block: the state a key starts from when nothing came before.
    fns = blocks.select(*keys, "_blk", F.struct(F.aggregate(
        F.slice("_rows", 2, block), step(F.col("_rows")[0]), fold).alias("f"),
        F.col("_rows")[0]["x"].alias("x0")).alias("_f"))
    # A negative state means "no row before": the first row of a key takes its own value.
    first = F.lit(-1.0)
    enter = carry_in(fns, keys, "_f",
                     lambda f, g: F.struct(then(f["f"], g["f"]).alias("f"), f["x0"].alias("x0")),
                     lambda f, y: run(f["f"], F.when(y < 0, f["x0"]).otherwise(y)), first, "_y", fan)
    fresh = lambda s, it: it["hard"] | (s < 0)
    held = lambda s, it: F.when(fresh(s, it), it["x"]).otherwise(F.greatest(F.least(it["x"], s + limit), s - limit))
    done = emit_states(F.col("_rows"), F.col("_y"), held, lambda s, y, it: F.struct(y.alias("y"), (~fresh(s, it)).alias("had"), it["m"].alias("m")))
    return (blocks.join(enter, [*keys, "_blk"]).select(*keys, F.explode_outer(done).alias("_o"))
            .select(*keys, "_o.m.*", F.col("_o.y").alias(out), F.col("_o.had").alias(had)))


def comfort_guard(rows: DataFrame, hard: Column, comfort: dict = R.COMFORT,
                  keys: Sequence[str] = VIDEO, order: str = "shot_id", block: int = BLOCK) -> DataFrame:
    """Bound every requested parameter and record what changed, in a fixed order.

    Input columns: the seven parameters, confidence, motion_score,
    depth_reliability, edge_near.  Requested values are kept as ``requested``.
    """
    c = comfort
    r = rows.withColumn("requested", F.struct(*R.PARAMS))
    r = carried_clamp(r, "convergence_depth_percentile", c["max_convergence_change"], hard, keys, order, "_conv", "_had", block)
    strength0, pop0, bg0 = F.col("depth_strength"), F.col("max_popout_disparity_norm"), F.col("max_background_disparity_norm")
    moving = F.col("motion_score") >= c["high_motion_threshold"]
    shaky = F.col("depth_reliability") < c["low_reliability_threshold"]
    unsure = F.col("confidence") < c["low_confidence_threshold"]
    edge = F.coalesce(F.col("edge_near"), F.lit(False)) & F.col("edge_protection")
    r = r.withColumns({"_s1": F.least(strength0, F.lit(c["max_depth_strength"])), "_p1": F.least(pop0, F.lit(c["max_popout_disparity_norm"])),
                       "_b1": F.least(bg0, F.lit(c["max_background_disparity_norm"]))})
    r = r.withColumns({"_s2": F.when(moving, F.col("_s1") * c["high_motion_reduction"]).otherwise(F.col("_s1")),
                       "_p2": F.when(moving, F.col("_p1") * c["high_motion_reduction"]).otherwise(F.col("_p1"))})
    r = r.withColumns({"_s3": F.when(shaky, F.col("_s2") * c["unreliable_depth_reduction"]).otherwise(F.col("_s2")),
                       "_p3": F.when(unsure, 0.0).otherwise(F.col("_p2"))})
    r = r.withColumn("_p4", F.when(edge, 0.0).otherwise(F.col("_p3")))
    changes = [("depth_strength_clamped", "depth_strength", "_s1"), ("popout_clamped", "max_popout_disparity_norm", "_p1"),
               ("background_clamped", "max_background_disparity_norm", "_b1"), ("reduced_due_to_high_motion", "_s1", "_s2"),
               ("popout_reduced_due_to_high_motion", "_p1", "_p2"), ("reduced_due_to_unreliable_depth", "_s2", "_s3"),
               ("popout_disabled_due_to_low_confidence", "_p2", "_p3"), ("popout_disabled_due_to_edge_violation", "_p3", "_p4"),
               ("convergence_change_clamped", "convergence_depth_percentile", "_conv")]
    acts = F.array_compact(F.array(*[F.when(F.col(a) != F.col(b), F.struct(
        F.lit(code).alias("code"), F.lit(R.ACTIONS[code]).alias("message"), F.col(a).alias("requested"), F.col(b).alias("applied")))
        for code, a, b in changes]))
    cap = lambda v, hi: F.least(F.lit(hi), F.greatest(F.lit(0.0), F.col(v)))
    return (r.withColumn("guard_actions", acts)
            .withColumns({"depth_strength": cap("_s3", c["max_depth_strength"]), "max_popout_disparity_norm": cap("_p4", c["max_popout_disparity_norm"]),
                          "max_background_disparity_norm": cap("_b1", c["max_background_disparity_norm"]), "convergence_depth_percentile": F.col("_conv")})
            .drop("_s1", "_s2", "_s3", "_p1", "_p2", "_p3", "_p4", "_b1", "_conv", "_had"))


def with_preset(rows: DataFrame, preset: str = "preset") -> DataFrame:
    """Parameters of each row's preset: a join with the five-row preset table; nulls for a preset that isn't in it."""
    t = R.preset_table(rows.sparkSession)
    return rows.drop(*R.PARAMS).join(F.broadcast(t.withColumnRenamed("preset", preset)), preset, "left")


def create_script(features: DataFrame, hard: Column, comfort: dict = R.COMFORT, choose=R.select_preset) -> DataFrame:
    """Preset, confidence, guarded parameters and actions for every shot."""
    preset, conf = choose()
    rows = with_preset(features.withColumn("preset", preset).withColumn("confidence", conf))
    return comfort_guard(rows, hard, comfort).withColumn("manual_override", F.lit(False))


def guard_for_render(script: DataFrame, hard: Column, comfort: dict = R.COMFORT) -> DataFrame:
    """Apply the limits again from what was asked for, so repeating it changes nothing."""
    asked = F.when(F.col("manual_override") | F.col("requested").isNull(), F.struct(*R.PARAMS)).otherwise(F.col("requested"))
    s = script.withColumn("_ask", asked)
    s = s.withColumns({p: F.col(f"_ask.{p}") for p in R.PARAMS}).drop("_ask", "requested", "guard_actions")
    return comfort_guard(s, hard, comfort)


def merge_recommendations(features: DataFrame, suggestions: DataFrame, fallback: str = "rules",
                          keys: Sequence[str] = ("video_id", "shot_id")) -> DataFrame:
    """Outside suggestions (``reply`` JSON per shot) over the rules; anything unusable falls back."""
    s = suggestions.select(*keys, F.from_json("reply", "preset string, confidence double").alias("_r"), F.lit(True).alias("_found"))
    own_p, own_c = R.select_preset()
    p, c, src = R.accept_suggestion(F.coalesce("_found", F.lit(False)), F.col("_r.preset"), F.col("_r.confidence"), own_p, own_c, fallback)
    return features.join(s, list(keys), "left").withColumns({"preset": p, "confidence": c, "source": src}).drop("_r", "_found")


SCRIPT_COLS = ("preset", "confidence", *R.PARAMS, "requested", "guard_actions", "manual_override")


def carry_overrides(existing: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep manual rows of ``existing`` in a regenerated script.

    A video whose manual edits no longer fit (other shots or other width) is left
    out of the result and listed in the second frame.
    """
    key = ["video_id", "shot_id"]
    e = existing.select(*key, F.col("video_width").alias("_ew"), F.struct(*SCRIPT_COLS).alias("_e"))
    both = generated.join(e, key, "full_outer")
    clash = (both.groupBy("video_id").agg(
        F.max(F.coalesce(F.col("_e.manual_override"), F.lit(False))).alias("_m"), F.max("_ew").alias("_w"),
        F.max(F.col("_e").isNull() | F.col("preset").isNull() | (F.col("_ew") != F.col("video_width"))).alias("_bad"))
        .select("video_id", (F.col("_m") & F.col("_w").isNotNull() & F.col("_bad")).alias("rejected")))
    bad = clash.where("rejected").select("video_id")
    keep = F.coalesce(F.col("_e.manual_override"), F.lit(False))
    cols = {c: F.when(keep, F.col(f"_e.{c}")).otherwise(F.col(c)) for c in SCRIPT_COLS if c not in ("requested", "guard_actions")}
    cols["requested"] = F.when(keep, F.coalesce(F.col("_e.requested"), F.struct(*[F.col(f"_e.{p}") for p in R.PARAMS]))).otherwise(F.col("requested"))
    cols["guard_actions"] = F.when(~keep, F.col("guard_actions")).otherwise(F.slice(F.coalesce("guard_actions", F.col("_e.guard_actions")), 1, 0))
    out = generated.join(e, key, "left").join(bad, "video_id", "left_anti").withColumns(cols).drop("_e", "_ew")
    return out, bad


def apply_overrides(script: DataFrame, overrides: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert a batch of edits per video, all or nothing.

    ``overrides``: video_id, shot_id, preset, the seven parameters, expected_revision.
    A video's batch is refused on a stale revision, an unknown shot or a repeated shot.
    """
    key = ["video_id", "shot_id"]
    known = script.select(*key, F.lit(True).alias("_known"))
    per = overrides.groupBy(*key).agg(F.count(F.lit(1)).alias("_times"), F.max("expected_revision").alias("_hi"),
                                      F.min("expected_revision").alias("_lo")).join(known, key, "left")
    verdict = (per.groupBy("video_id").agg(
        F.max(F.col("_known").isNull()).alias("_unknown"), F.max(F.col("_times") > 1).alias("_twice"),
        F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
        .join(revisions.select("video_id", "revision"), "video_id", "left")
        .select("video_id", F.when(F.col("revision").isNull() | (F.col("_hi") != F.col("revision")) | (F.col("_lo") != F.col("revision")), "revision_conflict")
                .when(F.col("_unknown"), "unknown_shot").when(F.col("_twice"), "duplicate_shot").otherwise("applied").alias("outcome")))
    o = (overrides.join(verdict.where("outcome = 'applied'"), "video_id", "left_semi")
         .select(*key, F.struct("preset", *R.PARAMS).alias("_o")))
    edited = F.col("_o").isNotNull()
    cols = {c: F.when(edited, F.col(f"_o.{c}")).otherwise(F.col(c)) for c in ("preset", *R.PARAMS)}
    cols["requested"] = F.when(edited, F.struct(*[F.col(f"_o.{p}") for p in R.PARAMS])).otherwise(F.col("requested"))
    cols["manual_override"] = edited | F.col("manual_override")
    cols["guard_actions"] = F.when(edited, F.slice("guard_actions", 1, 0)).otherwise(F.col("guard_actions"))
    return script.join(o, key, "left").withColumns(cols).drop("_o"), verdict


def merge_features(shots: DataFrame, update: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace the feature columns of shots that have an update, leave the others."""
    key = ["video_id", "shot_id"]
    u = update.select(*key, F.struct(*cols).alias("_u"))
    return shots.join(u, key, "left").withColumns(
        {c: F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in cols}).drop("_u")
