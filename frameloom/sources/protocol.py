"""Request and event lines: newline JSON in, newline JSON out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sensitive_keys

# Size limits and the parameters each method takes (allowed, required).
MAX_REQUEST_BYTES, MAX_EVENT_BYTES = 256 * 1024, 900_000
MAX_NAME = 160
BOOLEANS = ("swap_eyes", "llm_enabled", "resume", "allow_fallback")
PROFILES = ("representative_frames",)
MESSAGES = {"invalid_worker_output": "Worker output could not be serialized safely",
            "result_too_large": "Worker result exceeds the desktop IPC size limit"}


def request_value_error(method: Column, params: Column) -> Column:
    """What is wrong with a request's parameter values (null when nothing is).

    ``inspect`` takes one of input_path and project_dir, the first alone; a project's name has 1 to MAX_NAME
    characters, not all blank and none of control; BOOLEANS are true or false; the profile is one of PROFILES.
    """
    v = F.try_parse_json(F.coalesce(params, F.lit("{}")))
    at = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(at(name))  # noqa: E731  null where it is not given, VOID where it is null
    keys = F.coalesce(F.json_object_keys(params), F.array().cast("array<string>"))
    has = lambda name: F.array_contains(keys, name)
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    good_name = ((F.char_length(text("name")).between(1, MAX_NAME)) & ~text("name").rlike(r"(?U)^\s*$") & ~text("name").rlike(r"[\x00-\x1f\x7f-\x9f]"))
    wrong = lambda ok: ~F.coalesce(ok, F.lit(False))
    err = F.when((method == "inspect") & ((has("input_path") == has("project_dir")) | (has("input_path") & (F.size(keys) != 1))), "inspect_input")
    err = err.when((method == "create_project") & has("name") & wrong(good_name), "bad_name")
    for name in BOOLEANS:
        err = err.when(has(name) & wrong(kind(name) == "BOOLEAN"), f"not_boolean:{name}")
    return err.when(has("profile") & wrong(text("profile").isin(*PROFILES)), "unknown_profile")


def read_protocol(lines: DataFrame, contracts: dict[str, tuple[set[str], set[str]]], line: str = "value",
                  max_bytes: int = MAX_REQUEST_BYTES) -> DataFrame:
    """Requests with ``error`` set where a line must be refused (works on batches and streams)."""
    r = lines.withColumns({
        "_keys": F.json_object_keys(line), "id": F.get_json_object(line, "$.id"), "method": F.get_json_object(line, "$.method"),
        "params": F.get_json_object(line, "$.params")})
    given = F.coalesce(F.json_object_keys("params"), F.array().cast("array<string>"))
    lit = lambda names: F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")
    table = lambda side: F.create_map(*[x for m, c in contracts.items() for x in (F.lit(m), lit(c[side]))])
    allowed, required = F.try_element_at(table(0), F.col("method")), F.try_element_at(table(1), F.col("method"))
    # Bracketed, a line with anything after its object no longer holds exactly one value.
    one = F.json_array_length(F.concat(F.lit("["), F.col(line), F.lit("]"))) == 1
    err = (F.when(F.octet_length(line) > max_bytes, "too_large").when(F.col("_keys").isNull() | ~F.coalesce(one, F.lit(False)), "not_an_object")
           .when(sensitive_keys(F.coalesce("params", F.lit("{}"))), "secret_in_params")
           .when(F.coalesce(F.size(F.array_except("_keys", lit({"id", "method", "params"}))) > 0, F.lit(False)) | F.col("id").isNull() | F.col("method").isNull(), "bad_request")
           .when(allowed.isNull(), "unknown_method").when(F.size(F.array_except(given, allowed)) > 0, "unknown_params")
           .when(F.size(F.array_except(required, given)) > 0, "missing_params")
           .otherwise(request_value_error(F.col("method"), F.col("params"))))
    return r.withColumn("error", err).drop("_keys")


def write_protocol(events: DataFrame, payload: Column, numbers: list[str], max_bytes: int = MAX_EVENT_BYTES,
                   id: str = "id") -> DataFrame:
    """Adds ``line``; events with non-finite numbers or too many bytes become error events."""
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.isnan(n) | (F.abs(n) == float("inf"))
    fail = lambda code: F.to_json(F.struct(
        F.lit("error").alias("type"), F.coalesce(F.col(id).cast("string"), F.lit("unknown")).alias("id"),
        F.struct(F.lit(code).alias("code"), F.lit(MESSAGES[code]).alias("message"), F.lit(False).alias("retryable")).alias("error")))
    e = events.withColumn("_j", F.to_json(payload))
    bad = F.coalesce(bad, F.lit(False))
    return (e.withColumn("outcome", F.when(bad, "invalid_worker_output").when(F.octet_length("_j") > max_bytes, "result_too_large").otherwise("ok"))
            .withColumn("line", F.when(F.col("outcome") == "ok", F.col("_j")).when(bad, fail("invalid_worker_output")).otherwise(fail("result_too_large"))).drop("_j"))
