"""Text, JSON and number helpers as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret key names (letters and digits only), and redaction patterns.
SENSITIVE = ("apikey", "accesstoken", "refreshtoken", "authorization", "credential", "password", "secret", "bearer", "privatekey")
SENSITIVE_HOST = ("apikey", "authorization", "accesstoken", "refreshtoken", "password", "credential", "bearer", "secret", "token")
BEARER = r"(?i)(bearer )[^\s\"',;]+"
KEY = r"(?i)sk-[A-Za-z0-9\-_.]*"
REDACTED = "[redacted]"
TRUNCATED = " …[truncated]"
UI_LIMITS = {"depth_strength": (0.0, 1.0), "convergence_depth_percentile": (0.1, 0.9), "max_background_disparity_norm": (0.0, 0.02),
             "max_popout_disparity_norm": (0.0, 0.008), "temporal_smoothing": (0.0, 1.0), "transition_frames": (0.0, 24.0)}


def _finite_or(c: Column, default: float) -> Column:
    return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c), F.lit(float(default)))


def parse_number(text: Column, default: float = 0.0) -> Column:
    return _finite_or(text.try_cast("double"), default)


def parse_fraction(text: Column) -> Column:
    """"a/b" or a plain number to a double; 0 for anything unusable."""
    t = F.trim(text)
    parts = F.split(t, "/")
    is_ratio = t.rlike(r"^[+-]?\d+/\d+$")
    ratio = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    plain = F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return _finite_or(F.when(is_ratio, ratio).otherwise(plain), 0.0)


def timecode(seconds: Column, fps: float | None = None) -> Column:
    """HH:MM:SS, with :FF when ``fps`` is given; unusable input reads as zero."""
    s = F.greatest(F.lit(0.0), _finite_or(seconds, 0.0))
    two = lambda v: F.lpad(v.cast("bigint").cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    parts = [F.when(hours >= 100, hours.cast("bigint").cast("string")).otherwise(two(hours)),
             two(F.floor((s % 3600) / 60)), two(F.floor(s % 60))]
    if fps is not None:
        parts.append(two(F.floor((s - F.floor(s)) * fps)))
    return F.concat_ws(":", *parts)


def sensitive_keys(json: Column, names=SENSITIVE, exact=("token",)) -> Column:
    """Whether any JSON key, at any depth, names a secret; escapes in a key are decoded first."""
    keys = F.filter(F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0)), lambda k: k.endswith(":"))
    name = lambda k: F.from_json(F.concat(F.lit("["), F.regexp_replace(k, r"\s*:$", ""), F.lit("]")), "array<string>")[0]
    plain = F.transform(keys, lambda k: F.regexp_replace(F.lower(F.coalesce(name(k), k)), "[^a-z0-9]", ""))
    hit = lambda k: (k.isin(*exact) if exact else F.lit(False)) | k.rlike("|".join(names))
    return F.exists(plain, hit)


def redact(text: Column, secret: Column | None = None, bearer: str = BEARER, key: str = KEY) -> Column:
    if secret is not None:
        text = F.when(F.length(secret) > 0, F.replace(text, secret, F.lit(REDACTED))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, bearer, "$1" + REDACTED), key, REDACTED)


def truncate_chars(text: Column, limit: int, marker: str = TRUNCATED) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def truncate_bytes(text: Column, limit: int, marker: str = TRUNCATED) -> Column:
    """At most ``limit`` UTF-8 bytes; a character cut in half becomes the replacement character."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) > limit, F.concat(head, F.lit(marker))).otherwise(text)


def tail_bytes(text: Column, limit: int) -> Column:
    raw = F.encode(text, "UTF-8")
    start = F.greatest(F.lit(1), F.octet_length(text) - limit + 1)
    return F.make_valid_utf8(F.substring(raw, start, F.lit(limit)).cast("string"))


REPLY = ("output_text string, output array<struct<type:string, content:array<struct<type:string, text:string>>>>")


def extract_output_text(reply: Column) -> Column:
    """The direct text of a reply, else the first text block of its message items."""
    r = F.from_json(reply, REPLY)
    items = F.filter(F.coalesce(r["output"], F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string>>>>")),
                     lambda i: i["type"] == "message")
    blocks = F.flatten(F.transform(items, lambda i: F.coalesce(i["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.filter(blocks, lambda b: b["type"].isin("output_text", "text") & b["text"].isNotNull())
    return F.coalesce(r["output_text"], F.get(texts, F.lit(0))["text"])


def clamp_ui(column: str, c: Column) -> Column:
    """Editor limits; a value that is not a finite number becomes the lower limit."""
    lo, hi = UI_LIMITS[column]
    v = c.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), lo).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), v)))


def unknown_keys(given: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(given, allowed))
