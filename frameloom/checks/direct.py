"""Registered queries and their SQL: features and direction."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SQL_FEATURES, shot_features
from ..functions import rules as R
from ..operators import direct as X
from ..operators import ledger as L
from ..sources.artifacts import materialize

Q, S = {}, {}
W = "WITH RECURSIVE " + SQL_FEATURES


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


def r9(c):
    return F.round(c, 9) + F.lit(0.0)


SQL_PRESETS = "presets(preset, depth_strength, convergence_depth_percentile, max_background_disparity_norm, max_popout_disparity_norm, temporal_smoothing, transition_frames, edge_protection) AS (VALUES " + ", ".join(
    f"('{k}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in v[:5]) + f", {v[5]}, {str(v[6]).lower()})" for k, v in R.PRESETS.items()) + ")"

SEL_P = """CASE WHEN speech_ratio >= 0.48 AND motion_score <= 0.62 THEN 'dialogue_subtle'
  WHEN depth_spread <= 0.24 AND foreground_ratio >= 0.30 AND motion_score <= 0.45 THEN 'closeup_flat'
  WHEN motion_score >= 0.58 AND speech_ratio < 0.45 THEN 'action_controlled'
  WHEN motion_score <= 0.34 AND depth_spread >= 0.48 AND foreground_ratio <= 0.28 THEN 'vista_deep' ELSE 'neutral' END"""
SEL_C = """CASE WHEN speech_ratio >= 0.48 AND motion_score <= 0.62 THEN least(0.96, CAST(0.65 AS DOUBLE) + CAST(0.25 AS DOUBLE) * speech_ratio - CAST(0.10 AS DOUBLE) * motion_score)
  WHEN depth_spread <= 0.24 AND foreground_ratio >= 0.30 AND motion_score <= 0.45 THEN least(0.94, 0.66 + CAST(0.20 AS DOUBLE) * foreground_ratio)
  WHEN motion_score >= 0.58 AND speech_ratio < 0.45 THEN least(0.94, 0.60 + CAST(0.25 AS DOUBLE) * motion_score)
  WHEN motion_score <= 0.34 AND depth_spread >= 0.48 AND foreground_ratio <= 0.28 THEN least(0.94, 0.62 + CAST(0.25 AS DOUBLE) * depth_spread) ELSE CAST(0.60 AS DOUBLE) END"""
SQL_SEL = f", {SQL_PRESETS}, sel AS (SELECT *, {SEL_P} AS preset, {SEL_C} AS confidence FROM feats), req AS (SELECT sel.*, presets.* EXCLUDE (preset) FROM sel JOIN presets USING (preset))"


def sql_guard(src, out):
    """The comfort limits over a request table, with the carried convergence by recursion."""
    return f""", {out}_c(video_id, shot_id, y, had) AS (SELECT video_id, shot_id, convergence_depth_percentile, false FROM {src} WHERE shot_id = 1
  UNION ALL SELECT r.video_id, r.shot_id, CASE WHEN r.transition <> 'fade' THEN r.convergence_depth_percentile
    ELSE least(least(1.0, c.y + CAST(0.18 AS DOUBLE)), greatest(greatest(0.0, c.y - CAST(0.18 AS DOUBLE)), r.convergence_depth_percentile)) END, r.transition = 'fade'
  FROM {out}_c c JOIN {src} r ON r.video_id = c.video_id AND r.shot_id = c.shot_id + 1),
{out}_1 AS (SELECT r.*, c.y, least(depth_strength, 1.0) AS s1, least(max_popout_disparity_norm, 0.004) AS p1, least(max_background_disparity_norm, 0.010) AS b1 FROM {src} r JOIN {out}_c c USING (video_id, shot_id)),
{out}_2 AS (SELECT *, CASE WHEN motion_score >= 0.68 THEN s1 * CAST(0.72 AS DOUBLE) ELSE s1 END AS s2, CASE WHEN motion_score >= 0.68 THEN p1 * CAST(0.72 AS DOUBLE) ELSE p1 END AS p2 FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN depth_reliability < 0.55 THEN s2 * CAST(0.60 AS DOUBLE) ELSE s2 END AS s3, CASE WHEN confidence < 0.55 THEN 0.0 ELSE p2 END AS p3 FROM {out}_2),
{out}_4 AS (SELECT *, CASE WHEN edge_near AND edge_protection THEN 0.0 ELSE p3 END AS p4 FROM {out}_3),
{out} AS (SELECT video_id, shot_id, preset, confidence, least(1.0, greatest(0.0, s3)) AS depth_strength, y AS convergence_depth_percentile, least(0.010, greatest(0.0, b1)) AS max_background_disparity_norm,
  least(0.004, greatest(0.0, p4)) AS max_popout_disparity_norm, temporal_smoothing, transition_frames, edge_protection, transition, motion_score, depth_reliability, edge_near, status, price,
  depth_strength AS q_strength, convergence_depth_percentile AS q_convergence_depth_percentile, max_background_disparity_norm AS q_background, max_popout_disparity_norm AS q_popout,
  concat_ws(',', CASE WHEN depth_strength <> s1 THEN 'depth_strength_clamped' END, CASE WHEN max_popout_disparity_norm <> p1 THEN 'popout_clamped' END,
   CASE WHEN max_background_disparity_norm <> b1 THEN 'background_clamped' END, CASE WHEN s1 <> s2 THEN 'reduced_due_to_high_motion' END,
   CASE WHEN p1 <> p2 THEN 'popout_reduced_due_to_high_motion' END, CASE WHEN s2 <> s3 THEN 'reduced_due_to_unreliable_depth' END,
   CASE WHEN p2 <> p3 THEN 'popout_disabled_due_to_low_confidence' END, CASE WHEN p3 <> p4 THEN 'popout_disabled_due_to_edge_violation' END,
   CASE WHEN convergence_depth_percentile <> y THEN 'convergence_change_clamped' END) AS actions FROM {out}_4)"""


SQL_SCRIPT = SQL_SEL + sql_guard("req", "script")
SHOW = """SELECT video_id, shot_id, preset, round(confidence, 9) + 0.0 AS confidence, round(depth_strength, 9) + 0.0 AS depth_strength, round(convergence_depth_percentile, 9) + 0.0 AS convergence_depth_percentile,
  round(max_background_disparity_norm, 9) + 0.0 AS max_background_disparity_norm, round(max_popout_disparity_norm, 9) + 0.0 AS max_popout_disparity_norm, actions FROM """


def show(df):
    return df.select("video_id", "shot_id", "preset", *[r9(c).alias(c) for c in (
        "confidence", "depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm")],
        F.array_join(F.transform("guard_actions", lambda a: a["code"]), ",").alias("actions"))


HARD = F.col


def hard():
    return F.col("transition") != "fade"


def script_of(spark, sf, feats=None):
    f = shot_features(spark, sf) if feats is None else feats
    return X.create_script(f, hard())


@q("select_preset", W + f"SELECT video_id, shot_id, {SEL_P} AS preset, round({SEL_C}, 9) + 0.0 AS confidence FROM feats")
def select_preset(spark, sf):
    p, c = R.select_preset()
    return shot_features(spark, sf).select("video_id", "shot_id", p.alias("preset"), r9(c).alias("confidence"))


@q("preset_lookup", W + SQL_SEL + """SELECT video_id, shot_id, preset, depth_strength, convergence_depth_percentile, max_background_disparity_norm, max_popout_disparity_norm, temporal_smoothing,
   transition_frames, edge_protection FROM req""")
def preset_lookup(spark, sf):
    p, _ = R.select_preset()
    f = shot_features(spark, sf).select("video_id", "shot_id", p.alias("preset"))
    return X.with_preset(f).select("video_id", "shot_id", "preset", *R.PARAMS)


@q("convergence_clamp", W + SQL_SCRIPT + "SELECT video_id, shot_id, round(y, 9) + 0.0 AS applied, had AS had_previous FROM script_c")
def convergence_clamp(spark, sf):
    p, c = R.select_preset()
    f = X.with_preset(shot_features(spark, sf).withColumn("preset", p).drop("status", "price"))
    out = X.carried_clamp(f, "convergence_depth_percentile", R.COMFORT["max_convergence_change"], hard())
    return out.select("video_id", "shot_id", r9("applied").alias("applied"), "had_previous")


REQ_OVER = """, over AS (SELECT feats.* EXCLUDE (edge_near), 'action_controlled' AS preset, depth_spread AS confidence, CAST(1.8 AS DOUBLE) * motion_score AS depth_strength, foreground_ratio AS convergence_depth_percentile,
  CAST(0.03 AS DOUBLE) * speech_ratio AS max_background_disparity_norm, CAST(0.02 AS DOUBLE) * motion_score AS max_popout_disparity_norm, CAST(0.9 AS DOUBLE) AS temporal_smoothing, 8 AS transition_frames, true AS edge_protection, edge_near FROM feats)"""


@q("comfort_guard", W + REQ_OVER + sql_guard("over", "gd") + SHOW + "gd")
def comfort_guard(spark, sf):
    f = shot_features(spark, sf).withColumns({
        "preset": F.lit("action_controlled"), "confidence": F.col("depth_spread"),
        "depth_strength": F.col("motion_score") * 1.8, "convergence_depth_percentile": F.col("foreground_ratio"),
        "max_background_disparity_norm": F.col("speech_ratio") * 0.03, "max_popout_disparity_norm": F.col("motion_score") * 0.02,
        "temporal_smoothing": F.lit(0.9), "transition_frames": F.lit(8), "edge_protection": F.lit(True)})
    return show(X.comfort_guard(f, hard()))


@q("create_script", W + SQL_SCRIPT + SHOW + "script")
def create_script(spark, sf):
    return show(script_of(spark, sf))


SQL_MANUAL = """, pick(d, mp) AS (VALUES ('1', 'dialogue_subtle'), ('2', 'action_controlled'), ('3', 'vista_deep'), ('4', 'closeup_flat'), ('5', 'neutral')),
man AS (SELECT s.video_id, s.shot_id, CASE WHEN s.status = 'F' THEN mp ELSE s.preset END AS preset, s.confidence,
   CASE WHEN s.status = 'F' THEN p.depth_strength * 2 ELSE q_strength END AS depth_strength, CASE WHEN s.status = 'F' THEN p.convergence_depth_percentile ELSE q_convergence_depth_percentile END AS convergence_depth_percentile,
   CASE WHEN s.status = 'F' THEN p.max_background_disparity_norm * 2 ELSE q_background END AS max_background_disparity_norm, CASE WHEN s.status = 'F' THEN p.max_popout_disparity_norm * 2 ELSE q_popout END AS max_popout_disparity_norm,
   s.temporal_smoothing, s.transition_frames, s.edge_protection, s.transition, s.motion_score, s.depth_reliability, s.edge_near, s.status, s.price
   FROM script s JOIN feats f USING (video_id, shot_id) JOIN pick ON pick.d = f.priority[1] JOIN presets p ON p.preset = mp)"""


def with_manual_edits(script):
    """Rows of status F become manual edits with twice the magnitudes of a preset named by priority."""
    names = ["dialogue_subtle", "action_controlled", "vista_deep", "closeup_flat", "neutral"]
    mp = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (str(i + 1), n)])
    params = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*[F.lit(float(v)) for v in R.PRESETS[n][:4]]))])
    m = F.col("status") == "F"
    s = script.withColumn("_mp", F.try_element_at(mp, F.substring("priority", 1, 1)))
    s = s.withColumn("_pv", F.try_element_at(params, F.col("_mp")))
    cols = {"preset": F.when(m, F.col("_mp")).otherwise(F.col("preset")), "manual_override": m}
    for i, (p, k) in enumerate((("depth_strength", 2.0), ("convergence_depth_percentile", 1.0), ("max_background_disparity_norm", 2.0), ("max_popout_disparity_norm", 2.0))):
        cols[p] = F.when(m, F.col("_pv")[i] * k).otherwise(F.col(p))
    cols["guard_actions"] = F.when(m, F.slice("guard_actions", 1, 0)).otherwise(F.col("guard_actions"))
    return s.withColumns(cols).drop("_mp", "_pv")


@q("guard_for_render", W + SQL_SCRIPT + SQL_MANUAL + sql_guard("man", "again") + SHOW + "again")
def guard_for_render(spark, sf):
    return show(X.guard_for_render(with_manual_edits(script_of(spark, sf)), hard()))


SQL_SUGGEST = """, sug AS (SELECT video_id, shot_id, status, CASE WHEN status = 'O' THEN NULL WHEN priority[1] = '5' THEN 'mystery' WHEN priority[1] = '1' THEN 'vista_deep' ELSE 'closeup_flat' END AS sp,
   round(price / 500000, 9) AS sc FROM feats)"""


@q("merge_recommendations", W + SQL_SEL + SQL_SUGGEST + """SELECT video_id, shot_id, CASE WHEN ok THEN CASE WHEN sc < 0.55 THEN 'neutral' ELSE sp END ELSE preset END AS preset,
   round(CASE WHEN ok THEN sc ELSE confidence END, 9) + 0.0 AS confidence, CASE WHEN ok THEN 'assistant' ELSE 'rules_fallback' END AS source
   FROM (SELECT sel.*, sp, sc, coalesce(sp IN (SELECT preset FROM presets) AND sc BETWEEN 0 AND 1, false) AS ok FROM sel JOIN sug USING (video_id, shot_id))""")
def merge_recommendations(spark, sf):
    f = shot_features(spark, sf)
    digit = F.substring("priority", 1, 1)
    name = F.when(digit == "5", "mystery").when(digit == "1", "vista_deep").otherwise("closeup_flat")
    sug = f.where("status <> 'O'").select("video_id", "shot_id", F.to_json(F.struct(
        name.alias("preset"), F.round(F.col("price") / 500000, 9).alias("confidence"))).alias("reply"))
    return X.merge_recommendations(f, sug).select("video_id", "shot_id", "preset", r9("confidence").alias("confidence"), "source")


@q("carry_overrides", W + SQL_SCRIPT + SQL_MANUAL + """, bad AS (SELECT video_id FROM feats GROUP BY 1 HAVING bool_or(price > 480000) AND bool_or(status = 'F' AND price <= 480000))
  SELECT s.video_id, s.shot_id, CASE WHEN e.status = 'F' THEN e.preset ELSE s.preset END AS preset, round(CASE WHEN e.status = 'F' THEN e.confidence ELSE s.confidence END, 9) + 0.0 AS confidence,
   round(CASE WHEN e.status = 'F' THEN e.depth_strength ELSE s.depth_strength END, 9) + 0.0 AS depth_strength, coalesce(e.status = 'F', false) AS manual_override,
   CASE WHEN e.status = 'F' THEN '' ELSE s.actions END AS actions
  FROM script s LEFT JOIN (SELECT * FROM man WHERE price <= 480000) e USING (video_id, shot_id) WHERE s.video_id NOT IN (SELECT video_id FROM bad)""")
def carry_overrides(spark, sf):
    gen = script_of(spark, sf).withColumn("video_width", F.lit(1280))
    out, _ = X.carry_overrides(with_manual_edits(gen).where("price <= 480000"), gen)
    return out.select("video_id", "shot_id", "preset", r9("confidence").alias("confidence"), r9("depth_strength").alias("depth_strength"),
                      "manual_override", F.array_join(F.transform("guard_actions", lambda a: a["code"]), ",").alias("actions"))


def row_digest():
    return L.digest("shot_id", "preset", *[L.number_text(c) for c in ("confidence", "depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm")],
                    F.array_join(F.transform("guard_actions", lambda a: a["code"]), ","))


N = "CAST(CAST({0} AS DECIMAL(18,9)) AS VARCHAR)"
SQL_REV = """, dig AS (SELECT video_id, shot_id, sha256(concat_ws(chr(0), shot_id, preset, """ + ", ".join(N.format(c) for c in (
    "confidence", "depth_strength", "convergence_depth_percentile", "max_background_disparity_norm", "max_popout_disparity_norm")) + """, actions)) AS d FROM script),
 d1 AS (SELECT video_id, shot_id // 1024 AS b, sha256(string_agg(d, '' ORDER BY shot_id)) AS d FROM dig GROUP BY 1, 2),
 d2 AS (SELECT video_id, b // 1024 AS b, sha256(string_agg(d, '' ORDER BY b)) AS d FROM d1 GROUP BY 1, 2),
 rev AS (SELECT video_id, sha256(string_agg(d, '' ORDER BY b)) AS revision FROM d2 GROUP BY 1)"""


@q("revision", W + SQL_SCRIPT + SQL_REV + "SELECT * FROM rev")
def revision(spark, sf):
    return L.tree_digest(script_of(spark, sf), ["video_id"], "shot_id", row_digest())


def _edits(feats, revs):
    stale = F.col("video_id") % 10 == 0
    o = feats.where("status = 'P'").join(revs, "video_id").select(
        "video_id", F.when(F.col("price") > 480000, F.col("shot_id") + 1000).otherwise(F.col("shot_id")).alias("shot_id"),
        F.lit("neutral").alias("preset"), F.when(stale, "stale").otherwise(F.col("revision")).alias("expected_revision"))
    return X.with_preset(o)


SQL_EDITS = """, ed AS (SELECT video_id, CASE WHEN price > 480000 THEN shot_id + 1000 ELSE shot_id END AS shot_id FROM feats WHERE status = 'P'),
  verdict AS (SELECT video_id, CASE WHEN video_id % 10 = 0 THEN 'revision_conflict' WHEN bool_or(shot_id > 1000) THEN 'unknown_shot' ELSE 'applied' END AS outcome FROM ed GROUP BY 1)"""


def _revised(spark, sf):
    """Features, script and revisions, each written once: the edits and their verdicts read them several times."""
    feats = materialize(shot_features(spark, sf))
    script = materialize(script_of(spark, sf, feats))
    return feats, script, materialize(L.tree_digest(script, ["video_id"], "shot_id", row_digest()))


@q("apply_overrides", W + SQL_SCRIPT + SQL_EDITS + """SELECT s.video_id, s.shot_id, CASE WHEN o.shot_id IS NULL THEN s.preset ELSE 'neutral' END AS preset,
   round(CASE WHEN o.shot_id IS NULL THEN s.depth_strength ELSE 0.45 END, 9) + 0.0 AS depth_strength, o.shot_id IS NOT NULL AS manual_override,
   CASE WHEN o.shot_id IS NULL THEN s.actions ELSE '' END AS actions
   FROM script s LEFT JOIN (SELECT * FROM ed WHERE video_id IN (SELECT video_id FROM verdict WHERE outcome = 'applied')) o USING (video_id, shot_id)""")
def apply_overrides(spark, sf):
    feats, script, revs = _revised(spark, sf)
    out, _ = X.apply_overrides(script, _edits(feats, revs), revs)
    return out.select("video_id", "shot_id", "preset", r9("depth_strength").alias("depth_strength"), "manual_override",
                      F.array_join(F.transform("guard_actions", lambda a: a["code"]), ",").alias("actions"))


@q("override_outcomes", W + SQL_EDITS + "SELECT * FROM verdict")
def override_outcomes(spark, sf):
    feats, script, revs = _revised(spark, sf)
    return X.apply_overrides(script, _edits(feats, revs), revs)[1]


@q("merge_features", W + """SELECT video_id, shot_id, CASE WHEN status = 'F' THEN round(motion_score / 2, 9) ELSE motion_score END + 0.0 AS motion_score, speech_ratio FROM feats""")
def merge_features(spark, sf):
    f = shot_features(spark, sf)
    upd = f.where("status = 'F'").withColumn("motion_score", F.round(F.col("motion_score") / 2, 9))
    return X.merge_features(f, upd, ["motion_score"]).select(
        "video_id", "shot_id", (F.col("motion_score") + F.lit(0.0)).alias("motion_score"), "speech_ratio")


@q("cut_context", W + "SELECT video_id, shot_id, round(least(1.0, greatest(0.0, 1 - greatest(0.0, lines * 1.5) / 8.0)), 6) + 0.0 AS cut_frequency_context FROM feats")
def cut_context(spark, sf):
    return shot_features(spark, sf).select("video_id", "shot_id", (F.round(R.cut_context(F.col("lines") * 1.5), 6) + F.lit(0.0)).alias("cut_frequency_context"))
