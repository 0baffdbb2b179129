"""Registered queries and their SQL: constraints, coverage, fingerprints, incremental runs, projects."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import SQL_FEATURES, SQL_PLANES, depth_planes, shot_features, table
from ..functions import rules as R
from ..operators import constraints as K
from ..operators import ledger as L
from ..operators import workspace as W
from ..sources import artifacts as A
from ..sources import depth_store as DS
from .depth import unit_planes

Q, S = {}, {}
C = F.col
FE = "WITH RECURSIVE " + SQL_FEATURES
PL = "WITH RECURSIVE " + SQL_PLANES


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


@q("violations", """SELECT event_id, concat_ws(',', CASE WHEN NOT (value >= 0 AND value <= 150) THEN 'value_range' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'type_unknown' END,
   CASE WHEN CAST(props->>'$.k' AS INTEGER) > 89 THEN 'k_range' END) AS broken FROM events WHERE NOT (value >= 0 AND value <= 150) OR event_type NOT IN ('view', 'click', 'purchase', 'signup') OR CAST(props->>'$.k' AS INTEGER) > 89""")
def violations(spark, sf):
    _, bad = L.quarantine(table(spark, sf, "events"), {
        "value_range": C("value").between(0, 150), "type_unknown": C("event_type").isin("view", "click", "purchase", "signup"),
        "k_range": F.get_json_object("props", "$.k").try_cast("int") <= 89})
    return bad.select("event_id", F.array_join("violations", ",").alias("broken"))


RULED = {"duration_seconds": "price / 1000 - 1", "brightness": "price / 400000", "cut_frequency_context": "lines / 6.0",
         "camera_movement": "CASE WHEN status = 'P' THEN 'shaky' WHEN status = 'F' THEN NULL ELSE 'zoom' END", "motion_score": "motion_score * 1.5 - 0.2"}
UNITS = ["motion_score", "speech_ratio", "depth_spread", "foreground_ratio", "brightness", "cut_frequency_context", "depth_reliability"]
BROKEN = {"shot_id_range": "shot_id < 1", "duration_seconds_range": "duration_seconds < 0", **{f"{u}_range": f"{u} < 0 OR {u} > 1" for u in UNITS},
          "camera_movement_unknown": "coalesce(camera_movement NOT IN ('static', 'lateral', 'vertical', 'zoom', 'unstable'), true)"}


@q("table_rules", FE + f""", s AS (SELECT video_id, shot_id, {', '.join(f'{e} AS {n}' for n, e in RULED.items())}, speech_ratio, depth_spread, foreground_ratio, depth_reliability FROM feats),
  t AS (SELECT video_id, count(*) AS row_count, count(*) FILTER ({' OR '.join(f'({c})' for c in BROKEN.values())}) AS bad_rows,
   {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in BROKEN.items())} FROM s GROUP BY 1)
  SELECT video_id, row_count, bad_rows, concat_ws(',', {', '.join(f"CASE WHEN {n} > 0 THEN '{n}=' || {n} END" for n in BROKEN)}) AS broken FROM t""")
def table_rules(spark, sf):
    """The rules of the features table, counted per video."""
    f = shot_features(spark, sf).select("video_id", "shot_id", *[F.expr(e).alias(n) for n, e in RULED.items()], "speech_ratio", "depth_spread", "foreground_ratio", "depth_reliability")
    told = F.transform(F.map_entries("broken"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return K.rule_counts(f, "shot_features").withColumn("broken", F.array_join(told, ","))


@q("manifest_problems", FE + """, s AS (SELECT video_id, shot_id, 10 * (shot_id - 1) + CASE WHEN status = 'P' THEN 1 ELSE 0 END AS a, 10 * shot_id - CASE WHEN price > 400000 THEN 2 ELSE 1 END AS b FROM feats),
  w AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY video_id ORDER BY a) + 1, 0) AS due, 10 * count(*) OVER (PARTITION BY video_id) - CASE WHEN video_id % 50 = 0 THEN 1 ELSE 0 END AS n FROM s)
  SELECT video_id, CASE WHEN bool_or(a <> due) OR max(b) + 1 <> max(n) THEN 'not_contiguous' ELSE '' END AS problems FROM w GROUP BY 1""")
def manifest_problems(spark, sf):
    f = shot_features(spark, sf)
    shots = f.select("video_id", "shot_id", ((C("shot_id") - 1) * 10 + F.when(C("status") == "P", 1).otherwise(0)).alias("start_frame"),
                     (C("shot_id") * 10 - F.when(C("price") > 400000, 2).otherwise(1)).alias("end_frame"))
    media = f.groupBy("video_id").agg((F.count(F.lit(1)) * 10).alias("n")).select("video_id", (C("n") - F.when(C("video_id") % 50 == 0, 1).otherwise(0)).alias("frame_count"))
    return K.manifest_problems(shots, media).withColumn("problems", F.array_join("problems", ","))


@q("coverage_check", FE + """, have AS (SELECT video_id, CASE WHEN price > 480000 THEN shot_id + 1000 ELSE shot_id END AS shot_id, CASE WHEN status = 'F' THEN 2 ELSE 1 END AS t FROM feats WHERE status <> 'P'),
  j AS (SELECT coalesce(h.video_id, f.video_id) AS video_id, h.t, f.shot_id AS want FROM have h FULL OUTER JOIN feats f ON f.video_id = h.video_id AND f.shot_id = h.shot_id)
  SELECT video_id, CAST(count(*) FILTER (t IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (want IS NULL) AS BIGINT) AS foreign_items, CAST(count(*) FILTER (t > 1) AS BIGINT) AS duplicates,
   count(*) FILTER (t IS NULL OR want IS NULL OR t > 1) = 0 AS exact FROM j GROUP BY 1""")
def coverage_check(spark, sf):
    f = shot_features(spark, sf).select("video_id", "shot_id", "status", "price")
    have = f.where("status <> 'P'").withColumn("shot_id", F.when(C("price") > 480000, C("shot_id") + 1000).otherwise(C("shot_id")))
    have = have.withColumn("_t", F.explode(F.when(C("status") == "F", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return L.coverage_check(have, f, ["video_id"], "shot_id")


@q("missing_refs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def missing_refs(spark, sf):
    known = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(C("o_orderkey").alias("l_orderkey"))
    return L.missing_refs(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), known, ["l_orderkey"])


@q("set_equal", """WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')
  SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, bool_and(a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL) AS same FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority GROUP BY 1""")
def set_equal(spark, sf):
    o = table(spark, sf, "orders")
    return L.sets_equal(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderpriority")


@q("pending_renders", "SELECT o_custkey AS video_id, o_orderkey AS shot_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def pending_renders(spark, sf):
    o = table(spark, sf, "orders").select(C("o_custkey").alias("video_id"), C("o_orderkey").alias("shot_id"), "o_orderstatus")
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(C("l_orderkey").alias("shot_id")).distinct()
    return W.pending_renders(o, done, o.where("o_orderstatus = 'P'").select("shot_id"), ["shot_id"]).select("video_id", "shot_id")


@q("fingerprint", "SELECT doc_id, sha256(concat_ws(chr(0), doc_id, lang, source, text)) AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.digest("doc_id", "lang", "source", "text").alias("fingerprint"))


@q("table_fingerprint", """WITH d AS (SELECT source, sha256(concat_ws(chr(0), doc_id, lang, text)) AS d FROM documents)
  SELECT source, count(*) AS row_count, concat_ws('-', """ + ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 16 * i}, 16) AS UBIGINT)) AS VARCHAR)" for i in range(4)) + ") AS row_sum FROM d GROUP BY 1")
def table_fingerprint(spark, sf):
    return L.table_fingerprint(table(spark, sf, "documents"), ["source"], ["doc_id", "lang", "text"])


def _stages(spark, sf):
    o = table(spark, sf, "orders")
    g = lambda d: d.groupBy(C("o_custkey").alias("video_id"), C("o_orderpriority").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"), F.max("o_orderstatus").alias("st"), F.min("o_orderkey").alias("low"))
    fp = lambda d: d.withColumns({
        "fingerprint": L.digest("video_id", "stage", "n"), "dependency_fingerprint": L.digest("video_id", "low"),
        "output_fingerprints": F.create_map(F.lit("main"), L.digest("top"), F.lit("side"), L.digest("low"))})
    wanted = fp(g(o)).withColumn("output_fingerprints", F.when(C("top") % 19 != 0, C("output_fingerprints")))
    ledger = fp(g(o.where("o_orderstatus <> 'P'"))).withColumns({
        "status": F.when(C("low") % 5 == 0, "failed").when(C("low") % 13 != 0, "complete"), "fingerprint": F.when(C("low") % 17 != 0, C("fingerprint")), "engine_version": F.when(C("low") % 7 == 0, "0.9").otherwise("1.0"),
        "algorithm_version": F.lit("a1"), "output_fingerprints": F.when(C("low") % 11 == 0, F.create_map().cast("map<string,string>")).otherwise(C("output_fingerprints"))})
    return wanted, ledger


@q("pending_stages", """WITH w AS (SELECT o_custkey AS video_id, o_orderpriority AS stage, count(*) AS n, max(o_orderkey) AS top, min(o_orderkey) AS low FROM orders GROUP BY 1, 2),
  l AS (SELECT o_custkey AS video_id, o_orderpriority AS stage, count(*) AS n, max(o_orderkey) AS top, min(o_orderkey) AS low FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
  SELECT * FROM (SELECT w.video_id, w.stage, CASE WHEN w.stage = '1-URGENT' THEN 'forced' WHEN l.n IS NULL THEN 'never_run' WHEN l.low % 7 = 0 THEN 'version_changed' WHEN l.low % 5 = 0 OR l.low % 13 = 0 THEN 'not_complete' WHEN l.n <> w.n OR l.low % 17 = 0 THEN 'input_changed'
    WHEN l.low % 11 = 0 THEN 'no_outputs' WHEN l.top <> w.top OR l.low <> w.low OR w.top % 19 = 0 THEN 'output_changed' END AS reason,
    coalesce(l.low % 5 <> 0 AND l.low % 13 <> 0 AND l.low = w.low, false) AS dependencies_current FROM w LEFT JOIN l USING (video_id, stage)) WHERE reason IS NOT NULL""")
def pending_stages(spark, sf):
    wanted, ledger = _stages(spark, sf)
    return L.pending_stages(wanted, ledger, "1.0", "a1", ["1-URGENT"]).select("video_id", "stage", "reason", "dependencies_current")


@q("join_shot_tables", """WITH o AS (SELECT o_custkey AS video_id, o_orderkey AS shot_id, o_orderstatus AS st, o_totalprice AS price FROM orders),
  a AS (SELECT video_id, shot_id, st FROM o WHERE shot_id % 7 <> 0), b AS (SELECT video_id, shot_id, price FROM o WHERE shot_id % 5 <> 0),
  c AS (SELECT DISTINCT l_suppkey AS video_id, l_orderkey AS shot_id FROM lineitem WHERE l_orderkey % 11 = 0 UNION SELECT video_id, shot_id FROM o WHERE st <> 'F')
  SELECT video_id, shot_id, a.st AS st, b.price AS price, concat_ws(',', CASE WHEN a.shot_id IS NULL THEN 'shots' END, CASE WHEN b.shot_id IS NULL THEN 'features' END, CASE WHEN c.shot_id IS NULL THEN 'script' END) AS missing
  FROM a FULL JOIN b USING (video_id, shot_id) FULL JOIN c USING (video_id, shot_id)""")
def join_shot_tables(spark, sf):
    """Three tables that each lack some shots; the last names shots that no other knows."""
    o = table(spark, sf, "orders").select(C("o_custkey").alias("video_id"), C("o_orderkey").alias("shot_id"), C("o_orderstatus").alias("st"), C("o_totalprice").alias("price"))
    foreign = table(spark, sf, "lineitem").where("l_orderkey % 11 = 0").select(C("l_suppkey").alias("video_id"), C("l_orderkey").alias("shot_id"))
    script = foreign.union(o.where("st <> 'F'").select("video_id", "shot_id")).distinct().withColumn("named", F.lit(True))
    j = L.join_shot_tables({"shots": o.where("shot_id % 7 <> 0").drop("price"), "features": o.where("shot_id % 5 <> 0").drop("st"), "script": script})
    return j.select("video_id", "shot_id", "shots.st", "features.price", F.array_join("missing", ",").alias("missing"))


@q("select_shots", FE + "SELECT video_id, shot_id FROM feats WHERE status = 'F' AND price > 250000")
def select_shots(spark, sf):
    f = shot_features(spark, sf)
    return W.select_shots(f, f.where("status = 'F' and price > 250000"))[0].select("video_id", "shot_id")


@q("search_shots", "SELECT o_orderkey FROM orders WHERE (o_orderpriority ILIKE '%not spec%' OR CAST(o_orderkey AS VARCHAR) LIKE '%not spec%') AND o_orderstatus = 'F'")
def search_shots(spark, sf):
    o = table(spark, sf, "orders").withColumn("status", F.when(C("o_orderstatus") == "F", "warning").otherwise("ready"))
    return W.search_shots(o, "Not Spec", True, "o_orderpriority", "o_orderkey").select("o_orderkey")


@q("recent_items", """SELECT user_id, event_type, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
   FROM events) WHERE rn = 1) WHERE place <= 3""")
def recent_items(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return W.recent_items(e, ["user_id"], "event_type", ["ts", "event_id"], 3).select("user_id", "event_type", "event_id", F.col("place").cast("bigint").alias("place"))


@q("select_range", FE + """, p AS (SELECT video_id, arg_min(shot_id, struct_pack(a := price, b := shot_id)) AS a, arg_max(shot_id, struct_pack(a := price, b := shot_id)) AS b FROM feats GROUP BY 1)
  SELECT f.video_id, f.shot_id FROM feats f JOIN p USING (video_id) WHERE f.shot_id BETWEEN least(a, b) AND greatest(a, b)""")
def select_range(spark, sf):
    f = shot_features(spark, sf).select("video_id", "shot_id", "price")
    picks = f.groupBy("video_id").agg(F.min_by("shot_id", F.struct("price", "shot_id")).alias("pick_a"), F.max_by("shot_id", F.struct("price", "shot_id")).alias("pick_b"))
    return W.select_range(f, picks).select("video_id", "shot_id")


@q("toggle_selection", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 250000)")
def toggle_selection(spark, sf):
    o = table(spark, sf, "orders")
    return W.toggle_selection(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 250000"), ["o_orderkey"])


@q("project_summary", """SELECT c_custkey AS video_id, c_name AS name, o.n AS shots, o.last_status, l.n AS rendered, e.n AS events FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_status FROM orders GROUP BY 1) o ON o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey""")
def project_summary(spark, sf):
    t = lambda n: table(spark, sf, n)
    n = F.count(F.lit(1)).alias("n")
    vid = C("o_custkey").alias("video_id")
    parts = {"o": t("orders").groupBy(vid).agg(n, F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status")),
             "l": t("lineitem").join(t("orders"), C("l_orderkey") == C("o_orderkey")).groupBy(vid).agg(n),
             "e": t("events").groupBy(C("user_id").alias("video_id")).agg(n)}
    s = W.project_summary(t("customer").select(C("c_custkey").alias("video_id"), C("c_name").alias("name")), parts)
    return s.select("video_id", "name", C("o.n").alias("shots"), C("o.last_status").alias("last_status"), C("l.n").alias("rendered"), C("e.n").alias("events"))


def _depth_meta(spark, sf):
    """Shots of orders: frame counts from lines; backends and faults by status and keys."""
    o = table(spark, sf, "orders")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = o.join(n, C("o_orderkey") == C("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    k = C("o_orderkey")
    shots = o.select(C("o_custkey").alias("video_id"), k.alias("shot_id"), F.lit(0).cast("bigint").alias("start_frame"), (F.lit(1) + C("n")).alias("end_frame"))
    meta = o.where(k % 101 != 0).select(
        C("o_custkey").alias("video_id"), k.alias("shot_id"), (C("n") + 2 + F.when(k % 97 == 0, 1).otherwise(0)).alias("frame_count"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.when(k % 89 == 0, "synthetic").when(C("o_custkey") % 2 == 0, "monocular-cues").otherwise("video-depth-anything-small").alias("backend"),
        F.when(C("o_custkey") % 19 == 0, "synthetic").otherwise("monocular-cues").alias("video_backend"),
        (C("o_orderstatus") == "F").alias("fallback_used"), F.when(k % 10 == 0, "failed").alias("error_code"), (k % 83 != 0).alias("ledger_current"))
    return shots, meta


SQL_GATE = """m AS (SELECT o_custkey AS video_id, o_orderkey AS k, o_orderstatus AS st FROM orders),
 g AS (SELECT video_id, CASE WHEN bool_or(k % 101 = 0) THEN 'coverage' WHEN video_id % 19 = 0 THEN 'backend' WHEN bool_or(k % 89 = 0) THEN 'shot_backend' WHEN bool_or(k % 97 = 0) THEN 'dimensions' WHEN bool_or(k % 83 = 0) THEN 'stale_stage' END AS reason FROM m GROUP BY 1)"""


@q("release_gate", f"WITH {SQL_GATE} SELECT * FROM g")
def release_gate(spark, sf):
    shots, meta = _depth_meta(spark, sf)
    return L.release_gate(meta, shots, (8, 8), backends=R.RELEASE_BACKENDS)


@q("depth_status", f"""WITH {SQL_GATE} SELECT video_id, any_value(reason) IS NULL AS production_ready, CASE WHEN bool_or(k % 89 = 0) OR video_id % 19 = 0 THEN 'synthetic' WHEN any_value(reason) IS NOT NULL THEN 'unknown' WHEN video_id % 2 = 1 THEN 'certified' ELSE 'image-analysis' END AS tier,
   count(*) FILTER (k % 89 = 0) AS synthetic_shots, count(*) FILTER (st = 'F') AS fallback_shots, count(*) FILTER (k % 10 = 0) AS failed_shots FROM m JOIN g USING (video_id) WHERE k % 101 <> 0 GROUP BY 1""")
def depth_status(spark, sf):
    shots, meta = _depth_meta(spark, sf)
    return L.depth_status(meta, L.release_gate(meta, shots, (8, 8), backends=R.RELEASE_BACKENDS))


@q("depth_limits", """WITH n AS (SELECT o_custkey AS video_id, o_orderkey AS shot_id, count(l_orderkey) + 2 AS frames FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT video_id, shot_id, frames, 6 AS max_shot_frames, max(frames) OVER (PARTITION BY video_id) AS longest_shot_frames FROM n QUALIFY frames > 6""")
def depth_limits(spark, sf):
    return L.depth_limits(_depth_meta(spark, sf)[0], 8, 8, 100, 6 * 64 * 18 + 5)


@q("write_read_depth", PL + """SELECT video_id, shot_id, frame_index, i, round(CAST(CAST(least(1.0, greatest(0.0, z * 1.5 + 0.5)) AS FLOAT) AS DOUBLE), 5) + 0.0 AS z, CASE WHEN shot_id = 4 THEN 'range' END AS error
  FROM px WHERE shot_id <> 4 UNION ALL SELECT video_id, shot_id, frame_index, i, round(CAST(CAST(CAST(CAST(least(1.0, greatest(0.0, z * 1.5 + 0.5)) AS FLOAT) AS DOUBLE) + 2 AS FLOAT) AS DOUBLE), 5), 'range' FROM px WHERE shot_id = 4""")
def write_read_depth(spark, sf):
    p = unit_planes(spark, sf).withColumn("z", F.transform("z", lambda v: v.cast("float").cast("double") + F.when(C("shot_id") == 4, 2.0).otherwise(0.0)))
    path = f"{A.shared_folder(spark)}/depth-{uuid.uuid4().hex}"
    A.write_depth(p, path)
    d = A.read_depth(spark, path)
    return d.select("video_id", "shot_id", "frame_index", "error", F.posexplode_outer("z").alias("i", "_v")).select(
        "video_id", "shot_id", "frame_index", C("i").cast("bigint").alias("i"), (F.round(C("_v").cast("double"), 5) + F.lit(0.0)).alias("z"), "error")


def _plane_hash(p):
    codes = F.array_join(F.transform("z", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("string")), ",")
    g = L.table_fingerprint(p.withColumn("_c", codes), ["video_id", "shot_id", "h", "w"], ["frame_index", "_c"])
    return g.select("video_id", "shot_id", "h", "w", C("row_count").alias("frame_count"), F.concat_ws(":", C("row_count").cast("string"), "row_sum").alias("content_hash"))


@q("import_cached_depth", PL + """SELECT DISTINCT video_id, shot_id, CASE shot_id WHEN 4 THEN 'missing' WHEN 6 THEN 'frame_count' WHEN 8 THEN 'changed' ELSE 'ok' END AS outcome FROM planes""")
def import_cached_depth(spark, sf):
    p = depth_planes(spark, sf)
    ext = p.where("shot_id <> 4 and not (shot_id = 6 and frame_index = 0)").withColumn(
        "z", F.when(C("shot_id") == 8, F.transform("z", lambda v: (v * 0.5).cast("float"))).otherwise(C("z")))
    return A.import_cached(_plane_hash(p), _plane_hash(ext))


def _stored(spark, sf):
    """A published store in which shot 8 was changed and shot 4 lost afterwards."""
    p, path = depth_planes(spark, sf), f"{A.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    DS.publish(p, path, 1)
    bad = p.where("shot_id <> 4").withColumn("z", F.when(C("shot_id") == 8, F.transform("z", lambda v, i: F.when(i == 5, v + 1).otherwise(v).cast("float"))).otherwise(C("z")))
    A.cluster_planes(bad).write.mode("overwrite").parquet(f"{path}/planes/version=1")
    return p, path


@q("depth_store", PL + f"""SELECT video_id, shot_id, frame_index, CASE shot_id WHEN 8 THEN 'changed' END AS error FROM planes WHERE shot_id <> 4
  UNION ALL SELECT DISTINCT video_id, shot_id, frame_index // {DS.RANGE} * {DS.RANGE}, 'missing' FROM planes WHERE shot_id = 4""")
def depth_store(spark, sf):
    return DS.load(spark, _stored(spark, sf)[1]).select("video_id", "shot_id", "frame_index", "error")


@q("load_cached_depth", PL + """, w AS (SELECT video_id, shot_id, count(*) AS n, CASE shot_id WHEN 4 THEN 'changed' WHEN 8 THEN 'changed' WHEN 6 THEN 'frame_count' WHEN 2 THEN 'grid' ELSE 'ok' END AS outcome FROM planes GROUP BY 1, 2)
  SELECT w.video_id, w.shot_id, outcome, CASE WHEN outcome = 'ok' THEN n END AS planes, round(CASE WHEN outcome = 'ok' THEN total END, 4) + 0.0 AS total FROM w
   JOIN (SELECT video_id, shot_id, sum(CAST(z AS DOUBLE)) AS total FROM px GROUP BY 1, 2) USING (video_id, shot_id)""")
def load_cached_depth(spark, sf):
    """Planes from a store with verdicts: shot 6 should have one frame more, shot 2 a smaller grid."""
    p, path = _stored(spark, sf)
    want = p.groupBy("video_id", "shot_id").agg(F.count(F.lit(1)).alias("n")).select(
        "video_id", "shot_id", (C("n") + F.when(C("shot_id") == 6, 1).otherwise(0)).alias("frame_count"), F.when(C("shot_id") == 2, 4).otherwise(8).alias("h"), F.lit(8).alias("w"))
    planes, outcome = DS.load_cached(spark, path, want)
    whole = F.aggregate("z", F.lit(0.0), lambda s, v: s + v)
    sums = planes.groupBy("video_id", "shot_id").agg(F.count(F.lit(1)).alias("planes"), (F.round(F.sum(whole), 4) + F.lit(0.0)).alias("total"))
    return outcome.join(sums, ["video_id", "shot_id"], "left")


@q("read_artifacts", """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'bad_field' WHEN 3 THEN 'not_an_object' END AS error, CASE WHEN s_suppkey % 5 = 0 THEN s_name WHEN s_suppkey % 5 = 4 THEN NULL END AS note FROM supplier""")
def read_artifacts(spark, sf):
    """One document per supplier and file: right ones with and without the optional note, and three kinds of wrong ones."""
    k = C("s_suppkey")
    doc = (F.when(k % 5 == 1, F.to_json(F.struct(k.alias("id"), C("s_name").alias("other")))).when(k % 5 == 2, F.to_json(F.struct(F.lit("x").alias("id"), C("s_name").alias("note"))))
           .when(k % 5 == 3, F.lit("[1]")).when(k % 5 == 4, F.to_json(F.struct(k.alias("id")))).otherwise(F.to_json(F.struct(k.alias("id"), C("s_name").alias("note")))))
    path = f"{A.shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    A.write_documents(table(spark, sf, "supplier").select(F.concat(k.cast("string"), F.lit(".json")).alias("name"), doc.alias("value")), path)
    got = A.read_artifacts(spark, path, "id long, note string", optional=["note"])
    return got.select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("bigint").alias("s_suppkey"), "error", F.when(C("error").isNull(), C("doc.note")).alias("note"))


def _flags(spark, sf):
    k = C("c_custkey")
    rev = F.when(k % 8 == 0, "bad").otherwise(F.sha2(k.cast("string"), 256))
    tier = F.get(F.array(F.lit("production"), F.lit("sampled"), F.lit("none")), (k % 3).cast("int"))
    mode = F.get(F.array(F.lit("production"), F.lit("image-analysis"), F.lit("synthetic"), F.lit("unknown")), (k % 4).cast("int"))
    return table(spark, sf, "customer").select(
        k.alias("video_id"), F.lit(True).alias("project_created"), (k % 23 != 0).alias("media_ready"), (k % 17 != 0).alias("normalized_ready"), (k % 13 != 0).alias("shots_valid"),
        (k % 7 != 0).alias("features_cover"), (k % 5 != 0).alias("script_cover"), rev.alias("script_revision"), rev.alias("revision"), tier.alias("analysis_tier"), (C("c_acctbal") > 0).alias("draft_valid"), mode.alias("depth_mode"))


SQL_FLAGS = """fl AS (SELECT c_custkey AS k, c_custkey % 23 <> 0 AS media, c_custkey % 23 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 13 <> 0 AS shots, c_acctbal > 0 AS dv FROM customer),
  rd AS (SELECT *, shots AND k % 7 <> 0 AND k % 5 <> 0 AND k % 8 <> 0 AND (k % 3 = 0 OR (k % 3 = 1 AND dv)) AS ready FROM fl)"""


@q("workspace_gates", f"""WITH {SQL_FLAGS} SELECT k AS video_id, CAST(NULL AS VARCHAR) AS source_monitor, CASE WHEN NOT media THEN '{W.REASONS["metadata"]}' END AS metadata, CASE WHEN NOT shots THEN '{W.REASONS["shot_navigation"]}' END AS shot_navigation,
  CASE WHEN NOT ready THEN '{W.REASONS["shot_metrics"]}' END AS shot_metrics, CASE WHEN NOT ready THEN '{W.REASONS["director_edit"]}' END AS director_edit,
  CASE WHEN NOT (ready AND k % 3 = 0 AND k % 4 <> 3) THEN CASE WHEN ready THEN '{W.REASONS["preview_late"]}' ELSE '{W.REASONS["preview_early"]}' END END AS preview_render, CASE WHEN NOT ready THEN '{W.REASONS["assistant_analysis"]}' END AS assistant_analysis,
  CASE WHEN NOT (ready AND k % 3 = 0 AND k % 4 < 2) THEN CASE WHEN k % 4 = 2 THEN '{W.REASONS["export_synthetic"]}' WHEN ready THEN '{W.REASONS["export_late"]}' ELSE '{W.REASONS["export_early"]}' END END AS final_export FROM rd""")
def workspace_gates(spark, sf):
    return W.workspace_gates(_flags(spark, sf))


STAGE_NAMES = ["estimate_depth", "extract_features", "direct", "analyze_draft", "render"]


@q("recover_tier", f"""WITH {SQL_FLAGS}, s AS (SELECT o_custkey, max(CASE WHEN o_orderpriority[1] IN ('1') THEN 1 ELSE 0 END) + max(CASE WHEN o_orderpriority[1] = '2' THEN 1 ELSE 0 END) + max(CASE WHEN o_orderpriority[1] = '3' THEN 1 ELSE 0 END) AS f,
   bool_or(o_orderpriority[1] = '4') AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT k AS video_id, CASE WHEN k % 13 <> 0 THEN CASE WHEN coalesce(f = 3, false) AND k % 7 <> 0 AND k % 5 <> 0 AND k % 8 <> 0 AND k % 4 IN (0, 2) THEN 'production' WHEN coalesce(d, false) AND dv THEN 'sampled' END END AS tier FROM fl LEFT JOIN s ON o_custkey = k""")
def recover_tier(spark, sf):
    o = table(spark, sf, "orders")
    stages = o.select(C("o_custkey").alias("video_id"), F.get(F.array(*[F.lit(n) for n in STAGE_NAMES]), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("stage"),
                      F.when(C("o_orderstatus") == "F", "complete").otherwise("running").alias("status"))
    return W.recover_tier(_flags(spark, sf), stages)


