"""Registered queries and their SQL: geometry, text, JSON, protocol."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import geometry as GE
from ..functions import rules as R
from ..functions import text as X
from ..operators.ordered import r6
from ..sources import probe as PR
from ..sources import protocol as PT

Q, S = {}, {}
C = F.col


def q(name, sql=None):
    def put(fn):
        Q[name] = fn
        if sql is not None:
            S[name] = sql
        return fn
    return put


def _media(spark, sf):
    k = C("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("video_id"), (k % 4000 + 16).alias("width"), (k * 7 % 3000 + 16).alias("height"), (k % 4 * 90).alias("rotation"))


SQL_MEDIA = "md AS (SELECT o_orderkey AS video_id, o_orderkey % 4000 + 16 AS w, o_orderkey * 7 % 3000 + 16 AS h, o_orderkey % 4 * 90 AS rotation FROM orders)"


@q("frame_geometry", f"""WITH {SQL_MEDIA}, a AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS dw, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS dh, least(320, w, 640) AS tw FROM md),
 b AS (SELECT *, (dw * 720 + dh - 1) // dh AS nw0, least(1.0, sqrt(CAST(tw * greatest(1, CAST(round_even(tw * 9 / 16, 0) AS BIGINT)) AS DOUBLE) / CAST(w * h AS DOUBLE))) AS sc FROM a),
 c AS (SELECT *, nw0 + nw0 % 2 AS nw, greatest(2, CAST(round_even(CAST(h * 640 AS DOUBLE) / w, 0) AS BIGINT)) AS sh FROM b)
 SELECT video_id, nw AS normalized_width, CASE WHEN nw > 8192 THEN 'too_wide' END AS size_error, greatest(16, CAST(round_even(w * sc, 0) AS BIGINT)) AS feature_width, greatest(16, CAST(round_even(h * sc, 0) AS BIGINT)) AS feature_height,
  CASE WHEN w <= 640 THEN w ELSE 640 END AS preview_width, CASE WHEN w <= 640 THEN h ELSE sh - sh % 2 END AS preview_height, round(greatest(CAST(w AS DOUBLE), h * (CAST(16 AS DOUBLE) / 9)), 6) AS reference_width, w * h * 3 AS frame_bytes,
  greatest(1, 3221225472 // (w * h * 18)) AS max_frames FROM c""")
def frame_geometry(spark, sf):
    g = GE.frame_geometry(_media(spark, sf))
    return g.select("video_id", "normalized_width", "size_error", "feature_width", "feature_height", "preview_width", "preview_height",
                    r6("reference_width").alias("reference_width"), "frame_bytes", "max_frames")


FR = """CASE o_orderkey % 8 WHEN 0 THEN {k} || '/1001' WHEN 1 THEN '0/0' WHEN 2 THEN 'N/A' WHEN 3 THEN {k} || '/0' WHEN 4 THEN {k} || '.5' WHEN 5 THEN 'x' || {k} WHEN 6 THEN ' ' || {k} || '/24 ' ELSE '-' || {k} || '/7' END"""


def _fraction_text():
    k = C("o_custkey").cast("string")
    forms = [F.concat(k, F.lit("/1001")), F.lit("0/0"), F.lit("N/A"), F.concat(k, F.lit("/0")), F.concat(k, F.lit(".5")),
             F.concat(F.lit("x"), k), F.concat(F.lit(" "), k, F.lit("/24 ")), F.concat(F.lit("-"), k, F.lit("/7"))]
    return F.get(F.array(*forms), (C("o_orderkey") % 8).cast("int"))


@q("parse_fraction", """SELECT o_orderkey, round(CASE o_orderkey % 8 WHEN 0 THEN o_custkey / 1001.0 WHEN 4 THEN o_custkey + 0.5 WHEN 6 THEN o_custkey / 24.0 WHEN 7 THEN -o_custkey / 7.0 ELSE 0.0 END, 6) + 0.0 AS rate FROM orders""")
def parse_fraction(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r6(X.parse_fraction(_fraction_text())).alias("rate"))


def _probe_docs(spark, sf):
    """One probe document per order, with the awkward cases spread over the keys."""
    k, c = C("o_orderkey"), C("o_custkey")
    txt = lambda e: e.cast("string")
    side = F.when(k % 3 == 0, F.array(F.struct(txt(-90 * (k % 4)).alias("rotation"))))
    video = F.struct(
        F.lit("video").alias("codec_type"), F.when(k % 5 > 0, "h264").alias("codec_name"), txt(k % 4000 + 16).alias("width"), txt(k * 7 % 3000 + 16).alias("height"),
        F.when(k % 7 == 0, "0/0").otherwise("24000/1001").alias("avg_frame_rate"), F.when(k % 2 == 0, "30/1").otherwise("24000/1001").alias("r_frame_rate"),
        F.when(k % 4 > 0, txt(c + 1)).alias("duration"), F.when(k % 6 == 0, txt(c * 2)).alias("nb_frames"), F.lit("yuv420p").alias("pix_fmt"),
        F.struct(F.when(k % 3 == 1, "180").alias("rotate")).alias("tags"), side.alias("side_data_list"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("1").alias("index"), F.when(k % 2 == 0, "2").otherwise("x").alias("channels"),
                     F.lit("48000").alias("sample_rate"), F.struct(F.lit("eng").alias("language")).alias("tags"), F.lit("1.99").alias("duration"))
    streams = F.concat(F.when(k % 11 == 0, F.lit("[")).otherwise(F.concat(F.lit("["), F.to_json(video), F.lit(","))), F.to_json(audio), F.lit("]"))
    return table(spark, sf, "orders").select(k.alias("video_id"), F.concat(
        F.lit('{"format":{"duration":"'), txt(c + 2), F.lit('"}'), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(',"streams":'), streams)), F.lit("}")).alias("probe"))


SQL_PROBE = """a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 13 = 0 AS ns, o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 AS nv FROM orders),
 b AS (SELECT *, CASE WHEN ns OR nv THEN 0.0 WHEN k % 7 = 0 THEN 0.0 ELSE 24000 / 1001.0 END AS av, CASE WHEN ns OR nv THEN 0.0 WHEN k % 2 = 0 THEN 30.0 ELSE 24000 / 1001.0 END AS nr,
   CASE WHEN ns OR nv THEN c + 2 WHEN k % 4 > 0 THEN c + 1 ELSE c + 2 END AS d FROM a),
 p AS (SELECT *, CASE WHEN av <> 0 THEN av ELSE nr END AS rate FROM b)"""


@q("parse_probe", f"""WITH {SQL_PROBE} SELECT k AS video_id, CASE WHEN ns THEN 'no_streams' WHEN nv THEN 'no_video' END AS error, CASE WHEN ns OR nv THEN 0 ELSE k % 4000 + 16 END AS width, CASE WHEN ns OR nv THEN 0 ELSE k * 7 % 3000 + 16 END AS height,
  CAST(d AS DOUBLE) AS duration_seconds, CASE WHEN ns OR nv OR k % 5 = 0 THEN 'unknown' ELSE 'h264' END AS video_codec, CASE WHEN ns THEN NULL WHEN k % 2 = 0 THEN 'aac:2:eng:1.99' ELSE 'aac:-:eng:1.99' END AS audio FROM p""")
def parse_probe(spark, sf):
    p = PR.parse_probe(_probe_docs(spark, sf))
    audio = F.array_join(F.transform("audio_streams", lambda a: F.concat_ws(
        ":", a["codec"], F.coalesce(a["channels"].cast("string"), F.lit("-")), a["language"], a["duration_seconds"].cast("string"))), ",")
    return p.select("video_id", "error", "width", "height", "duration_seconds", "video_codec", audio.alias("audio"))


@q("probe_rules", f"""WITH {SQL_PROBE} SELECT k AS video_id, round(rate, 6) + 0.0 AS frame_rate, CASE WHEN NOT (ns OR nv) AND k % 6 = 0 THEN c * 2 ELSE CAST(round_even(d * rate, 0) AS BIGINT) END AS frame_count,
  CASE WHEN ns OR nv THEN 0 WHEN k % 3 = 0 THEN ((-90 * (k % 4)) % 360 + 360) % 360 WHEN k % 3 = 1 THEN 180 ELSE 0 END AS rotation_degrees,
  av <> 0 AND nr <> 0 AND abs(nr - av) / greatest(nr, av, 1e-9) > 0.001 AS variable_frame_rate FROM p""")
def probe_rules(spark, sf):
    return PR.parse_probe(_probe_docs(spark, sf)).select("video_id", r6("frame_rate").alias("frame_rate"), "frame_count", "rotation_degrees", "variable_frame_rate")


NAMES = [" Synthetic ", "CACHED", "precomputed", "monocular_cues", "Monocular", "image-analysis", "VDA_small", "video-depth-anything", "zoe", "video_depth_anything_small"]


@q("canonical_backend", "WITH n(i, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)) + """), o(i, backend) AS (VALUES (0, 'synthetic'), (1, 'cached'), (2, 'cached'), (3, 'monocular-cues'), (4, 'monocular-cues'), (5, 'monocular-cues'),
  (6, 'video-depth-anything-small'), (7, 'video-depth-anything-small'), (8, NULL), (9, 'video-depth-anything-small')) SELECT c_custkey, backend FROM customer JOIN o ON o.i = c_custkey % 10""")
def canonical_backend(spark, sf):
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (C("c_custkey") % 10).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", R.canonical_backend(name).alias("backend"))


@q("timecode", """SELECT event_id, lpad(CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(CAST(floor(s % 3600 / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(s % 60) AS BIGINT) AS VARCHAR), 2, '0') AS clock,
  lpad(CAST(CAST(floor((s - floor(s)) * 24) AS BIGINT) AS VARCHAR), 2, '0') AS frames FROM (SELECT event_id, greatest(0.0, (value - 5) * CAST(777.25 AS DOUBLE)) AS s FROM events)""")
def timecode(spark, sf):
    s = (C("value") - 5) * F.lit(777.25)
    full = X.timecode(s, 24)
    return table(spark, sf, "events").select("event_id", X.timecode(s).alias("clock"), F.substring_index(full, ":", -1).alias("frames"))


@q("clamp_ui_parameters", """SELECT o_orderkey, least(1.0, greatest(0.0, o_totalprice / 250000)) AS depth_strength, least(0.9, greatest(0.1, o_totalprice / 500000)) AS convergence_depth_percentile, least(0.02, greatest(0.0, o_totalprice / 2e7)) AS max_background_disparity_norm,
   least(0.008, greatest(0.0, (o_totalprice - 1000) / 4e7)) AS max_popout_disparity_norm, least(24.0, greatest(0.0, CAST(o_custkey % 40 AS DOUBLE))) AS transition_frames FROM orders""")
def clamp_ui_parameters(spark, sf):
    p = C("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", X.clamp_ui("depth_strength", p / 250000).alias("depth_strength"), X.clamp_ui("convergence_depth_percentile", p / 500000).alias("convergence_depth_percentile"),
        X.clamp_ui("max_background_disparity_norm", p / 2e7).alias("max_background_disparity_norm"), X.clamp_ui("max_popout_disparity_norm", (p - 1000) / 4e7).alias("max_popout_disparity_norm"),
        X.clamp_ui("transition_frames", C("o_custkey") % 40).alias("transition_frames"))


@q("sensitive_keys", """SELECT event_id, event_type IN ('click', 'signup') OR value > 100 AS has_secret, event_type = 'view' OR event_type IN ('click', 'signup') OR value > 100 AS host_secret FROM events""")
def sensitive_keys(spark, sf):
    t = C("event_type")
    name = F.when(t == "click", "API-Key").when(t == "signup", r"refresh_\u0054oken").when(t == "view", "page_token").when(t == "error", "note").otherwise("monkey")
    doc = F.concat(F.lit('{"a":[{"'), name, F.lit('":"a \\"password\\": b"}],"b":{"'), F.when(C("value") > 100, "My-Credential").otherwise("value"), F.lit('":1},"props":'), C("props"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", X.sensitive_keys(doc).alias("has_secret"), X.sensitive_keys(doc, X.SENSITIVE_HOST, ()).alias("host_secret"))


@q("redact", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace('Auth: Bearer ' || md5(CAST(doc_id AS VARCHAR)) || '; key sk-' || doc_id || '_a.b, my-' || lang || '-pass ' || text, 'my-' || lang || '-pass', '[redacted]'),
   '(?i)(bearer )[^\s"'',;]+', '\1[redacted]', 'g'), '(?i)sk-[A-Za-z0-9\-_.]*', '[redacted]', 'g')) AS digest FROM documents""")
def redact(spark, sf):
    own = F.concat(F.lit("my-"), C("lang"), F.lit("-pass"))
    t = F.concat(F.lit("Auth: Bearer "), F.md5(C("doc_id").cast("string")), F.lit("; key sk-"), C("doc_id").cast("string"), F.lit("_a.b, "), own, F.lit(" "), C("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.redact(t, own)).alias("digest"))


@q("truncate_text", """SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN left(text, 1000) || ' …[truncated]' ELSE text END) AS head_digest, CASE WHEN strlen(text) > 2000 THEN 2000 ELSE strlen(text) END AS tail_bytes FROM documents""")
def truncate_text(spark, sf):
    raw = F.octet_length(F.substring(F.encode("text", "UTF-8"), F.greatest(F.lit(1), F.octet_length("text") - 1999), F.lit(2000)))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.truncate_chars(C("text"), 1000)).alias("head_digest"), raw.cast("bigint").alias("tail_bytes"))


@q("extract_output_text", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || '!' ELSE NULL END AS reply FROM conversations""")
def extract_output_text(spark, sf):
    t = C("text")
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    direct = F.to_json(F.struct(t.alias("output_text")))
    item = lambda kind, blocks: F.struct(F.lit(kind).alias("type"), blocks.alias("content"))
    nested = F.to_json(F.struct(F.array(item("reasoning", F.array(block("text", F.lit("no")))), item("message", F.array(
        block("image", F.lit("no")), block("output_text", F.concat(t, F.lit("!")))))).alias("output")))
    empty = F.to_json(F.struct(F.array(item("tool", F.array(block("text", t)))).alias("output")))
    reply = F.when(C("turn") % 3 == 0, direct).when(C("turn") % 3 == 1, nested).otherwise(empty)
    return table(spark, sf, "conversations").select("conv_id", "turn", X.extract_output_text(reply).alias("reply"))


@q("unknown_params", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'k' ELSE array_to_string(list_sort(['k', event_type]), ',') END AS unknown, CASE WHEN event_type = 'view' THEN '' ELSE 'view' END AS missing FROM events""")
def unknown_params(spark, sf):
    doc = F.concat(F.lit('{"'), C("event_type"), F.lit('":1,'), F.substring("props", F.lit(2), F.length("props")))
    given = F.json_object_keys(doc)
    return table(spark, sf, "events").select(
        "event_id", F.array_join(F.array_sort(X.unknown_keys(given, F.array(F.lit("click"), F.lit("view")))), ",").alias("unknown"),
        F.array_join(X.unknown_keys(F.array(F.lit("view")), given), ",").alias("missing"))


CONTRACTS = {"view": ({"k", "job_id"}, {"k"}), "click": ({"job_id"}, {"job_id"}), "purchase": ({"k", "features"}, {"features"})}


def request_lines(spark, sf):
    """Request lines from events: right ones and every way to be wrong."""
    v = C("value")
    params = F.when(v > 150, F.concat(F.lit('{"Api_Key":1,'), F.substring("props", F.lit(2), F.length("props")))).otherwise(C("props"))
    ok = F.concat(F.lit('{"id":"'), C("event_id").cast("string"), F.lit('","method":"'), C("event_type"), F.lit('","params":'), params, F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.when(v < 2, F.lit("[1, 2]")).when(v < 4, F.concat(ok, F.lit(" trailing {")))
                                             .otherwise(ok).alias("value"))


@q("read_protocol", """SELECT event_id, CASE WHEN value < 4 THEN 'not_an_object' WHEN value > 150 THEN 'secret_in_params' WHEN event_type IN ('signup', 'error') THEN 'unknown_method'
   WHEN event_type = 'click' THEN 'unknown_params' WHEN event_type = 'purchase' THEN 'missing_params' END AS error FROM events""")
def read_protocol(spark, sf):
    return PT.read_protocol(request_lines(spark, sf), CONTRACTS).select("event_id", "error")


@q("request_values", """SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 <> 0 THEN 'inspect_input' END WHEN 'click' THEN CASE WHEN value > 20 THEN 'bad_name' END
   WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'not_boolean:resume' END WHEN 'error' THEN CASE WHEN value > 20 THEN 'unknown_profile' END END AS error FROM events""")
def request_values(spark, sf):
    """Requests whose parameters have wrong values."""
    word = F.when(C("value") > 20, F.lit("long " * 40)).otherwise(F.lit("clip"))
    params = (F.when(C("event_type") == "view", F.when(C("event_id") % 3 == 0, F.lit('{"input_path":"a"}')).when(C("event_id") % 3 == 1, F.lit('{"input_path":"a","project_dir":"b"}')).otherwise(F.lit("{}")))
              .when(C("event_type") == "click", F.to_json(F.struct(word.alias("name"))))
              .when(C("event_type") == "purchase", F.when(C("event_id") % 2 == 0, F.lit('{"resume":"true"}')).otherwise(F.lit('{"resume":true}')))
              .when(C("event_type") == "error", F.when(C("value") > 20, F.lit('{"profile":"all"}')).otherwise(F.lit('{"profile":"representative_frames"}'))).otherwise(F.lit("{}")))
    method = F.when(C("event_type") == "view", "inspect").when(C("event_type") == "click", "create_project").otherwise("run")
    free = ({"input_path", "project_dir", "name", "resume", "profile"}, set())
    line = F.concat(F.lit('{"id":"1","method":"'), method, F.lit('","params":'), params, F.lit("}"))
    return PT.read_protocol(table(spark, sf, "events").select("event_id", line.alias("value")), {m: free for m in ("inspect", "create_project", "run")}).select("event_id", "error")


@q("write_protocol", """SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'invalid_worker_output' WHEN strlen(to_json({'type': 'result', 'id': CAST(doc_id AS VARCHAR), 'result': text})) > 5000 THEN 'result_too_large' ELSE 'ok' END AS outcome FROM documents""")
def write_protocol(spark, sf):
    d = table(spark, sf, "documents").withColumn("score", F.when(C("doc_id") % 50 == 0, float("nan")).otherwise(1.0)).withColumn("id", C("doc_id"))
    payload = F.struct(F.lit("result").alias("type"), C("doc_id").cast("string").alias("id"), C("text").alias("result"))
    return PT.write_protocol(d, payload, ["score"], 5000).select("doc_id", "outcome")
