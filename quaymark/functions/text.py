"""Text clean-up, formats and JSON fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types by file suffix.
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "txt": "text/plain"}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
#: The timed stages of a request, in their order.
STAGES = ("read_ms", "decode_ms", "bbox_ms", "ocr_ms", "validation_ms", "postprocess_ms", "total_ms")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Upper case, ASCII letters and digits only; null is empty."""
    return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]+", "")


def normalise(c: Column | str) -> Column:
    """Upper case, letters and digits of any script only; null is empty."""
    return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def or_null(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def words(c: Column | str) -> Column:
    """Cleaned tokens between white space, without empty ones."""
    return F.filter(F.transform(F.split(F.trim(col(c)), r"\s+"), clean), lambda t: t != "")


def class_counts(c: Column | str) -> Column:
    """Struct of digits, letters and length."""
    s = F.coalesce(col(c), F.lit(""))
    return F.struct(F.length(F.regexp_replace(s, "[^0-9]", "")).alias("digits"), F.length(F.regexp_replace(s, r"[^\p{L}]", "")).alias("letters"), F.length(s).alias("length"))


def percent(c: Column | str) -> Column:
    return F.when(col(c).isNull(), "N/A").otherwise(F.format_string("%.2f%%", col(c) * 100.0))


def number(c: Column | str) -> Column:
    return F.when(col(c).isNull(), "N/A").otherwise(F.format_string("%.3f", col(c)))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), -1)


def parent_name(path: Column | str) -> Column:
    """Name of the folder that holds the file; empty at the top."""
    parts = F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column | str) -> Column:
    """Lower-case suffix without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1))


def mime(path: Column | str) -> Column:
    types = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(types, suffix(path)), F.lit("application/octet-stream"))


#: Fixed value: what counts as white space at the ends of a reply, as a Java regex.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def json_text(body: Column | str, path: str) -> Column:
    """A string field without white space at its ends, null where it is missing, blank or no string."""
    value = F.try_variant_get(F.try_parse_json(col(body)), path, "variant")
    return or_null(strip(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))))


def _after_result(c: Column) -> Column:
    """What follows RESULT: on the last line."""
    return or_null(strip(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?id)RESULT{SPACE}*:{SPACE}*(.+)$", 1)))


def result_text(body: Column | str, fallback: Column | str) -> Column:
    """`result`, else what follows RESULT: in `message`, else in the fallback text, else empty."""
    return F.coalesce(json_text(body, "$.result"), _after_result(F.get_json_object(col(body), "$.message")), _after_result(col(fallback)), F.lit(""))


def raw_text(body: Column | str, fallback: Column | str) -> Column:
    return F.coalesce(json_text(body, "$.raw_text"), result_text(body, fallback))


def failure_reason(body: Column | str) -> Column:
    """`failure_reason`, else the debug reason unless it is ok, else empty."""
    return F.coalesce(json_text(body, "$.failure_reason"), F.nullif(json_text(body, "$.ocr_debug.reason"), F.lit("ok")), F.lit(""))


def stage_timings(body: Column | str) -> Column:
    """Map of the known stages that hold a number, to 3 places (halves away from zero)."""
    given = F.from_json(F.get_json_object(col(body), "$.timings_ms"), "map<string,string>")
    known = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*STAGES))
    cast = F.transform_values(known, lambda k, v: F.round(v.try_cast("double"), 3))
    return F.map_filter(cast, lambda k, v: v.isNotNull())


def seal_quality(c: Column | str) -> Column:
    """0 below 5 characters; else 0.45 of length up to 10, 0.35 for a digit, 0.20 for a mix of both (0.12 else)."""
    n = class_counts(c)
    score = 0.45 * F.least(F.lit(1.0), n["length"] / 10.0) + F.when(n["digits"] > 0, 0.35).otherwise(0.0) + F.when((n["digits"] > 0) & (n["letters"] > 0), 0.2).otherwise(0.2 * 0.6)
    return F.when(n["length"] < 5, 0.0).otherwise(score)


#: Fixed value: what a request says that was not answered in time.
TIMEOUT_MESSAGE = "Read timeout after %.1fs. Increase timeout and retry."


def request_error(kind: Column | str, message: Column | str, timeout_sec: Column | str) -> Column:
    """What a failed request says: read timeouts name the limit."""
    return F.when(col(kind) == "read_timeout", F.format_string(TIMEOUT_MESSAGE, col(timeout_sec))).otherwise(col(message))
