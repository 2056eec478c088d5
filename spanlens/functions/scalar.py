"""Scalar column functions (F1-F11). All are built-in Spark expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# String format tests used by contract inference and validation.
FORMAT_PATTERNS = {
    "uuid": "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z",
    "email": "^[^\\s@]+@[^\\s@]+\\.[^\\s@]+\\z",
    "date-time": "^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?)?\\z",
    "uri": "(?i)^https?://",
}
FORMAT_ORDER = ["uuid", "email", "date-time", "uri"]

SLOW_CALL_MS = 200.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_round(x: Column | str, digits: int = 0) -> Column:
    """JavaScript ``Math.round(x * 10^d) / 10^d`` (half rounds up, also for negatives): floor(x*10^d + 0.5)/10^d."""
    scale = float(10**digits)
    return F.floor(_c(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def js_type(json_text: Column | str) -> Column:
    """JavaScript ``typeof``-style name of a JSON text value; SQL NULL (absent) is ``undefined``.

    Decided by the first non-blank character, which is exact for valid JSON and avoids parsing the document.
    """
    t = F.ltrim(_c(json_text))
    first = F.substring(t, 1, 1)
    return (
        F.when(_c(json_text).isNull(), F.lit("undefined"))
        .when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null")
        .otherwise("number")
    )


def duration_label(ms: Column | str) -> Column:
    """F2: <1 ms as rounded microseconds, <1000 ms with one decimal, else seconds with two decimals."""
    m = _c(ms)
    return (
        F.when(m < 1, F.concat(F.format_string("%d", js_round(m * 1000).cast("long")), F.lit("µs")))
        .when(m < 1000, F.concat(F.format_string("%.1f", js_round(m, 1)), F.lit("ms")))
        .otherwise(F.concat(F.format_string("%.2f", js_round(m / 1000, 2)), F.lit("s")))
    )


def service_of(function_name: Column | str) -> Column:
    """text before the first dot (dot not first), else ``Handlers`` for handleX/processX, else ``Other``."""
    fn = _c(function_name)
    return (
        F.when(F.instr(fn, ".") > 1, F.substring_index(fn, ".", 1))
        .when(fn.rlike("^(handle|process)[A-Z]"), F.lit("Handlers"))
        .otherwise(F.lit("Other"))
    )


def base_name(function_name: Column | str) -> Column:
    """the text after the first dot; names without a dot stay as they are."""
    fn = _c(function_name)
    return F.when(F.instr(fn, ".") > 0, F.regexp_replace(fn, "^[^.]*\\.", "")).otherwise(fn)


def relative_path(file: Column | str, root: str | None) -> Column:
    """backslashes to slashes, strip ``root/`` when the file starts with it."""
    f = F.translate(_c(file), "\\", "/")
    if not root:
        return _c(file)
    norm_root = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(f.startswith(norm_root), f.substr(F.lit(len(norm_root) + 1), F.length(f))).otherwise(f)


def iso_time(ms: Column | str) -> Column:
    """epoch milliseconds as ISO-8601 UTC text ``yyyy-MM-ddTHH:mm:ss.SSSZ`` (independent of session zone)."""
    ts = F.timestamp_add("MILLISECOND", F.floor(_c(ms)).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def safe_id(s: Column | str, keep_dash: bool = False) -> Column:
    """every character outside ``[a-zA-Z0-9_]`` (and ``-`` for session names) becomes ``_``."""
    return F.regexp_replace(_c(s), "[^a-zA-Z0-9_\\-]" if keep_dash else "[^a-zA-Z0-9_]", "_")


def format_hit(s: Column | str, fmt: str) -> Column:
    """F8: does the string match the named format (uuid, email, date-time, uri)."""
    return _c(s).rlike(FORMAT_PATTERNS[fmt])


def first_format(s: Column | str) -> Column:
    """F8: the first matching format name in the fixed order, else NULL."""
    out = F.lit(None).cast("string")
    for fmt in reversed(FORMAT_ORDER):
        out = F.when(format_hit(s, fmt), F.lit(fmt)).otherwise(out)
    return out


def error_flags(has_error: Column | str, has_anomaly: Column | str) -> Column:
    """``ERR,ANOMALY`` style flag text (error first), empty when neither."""
    return F.concat_ws(
        ",",
        F.when(_c(has_error), F.lit("ERR")),
        F.when(_c(has_anomaly), F.lit("ANOMALY")),
    )


def flag_kind(has_error: Column | str, has_anomaly: Column | str) -> Column:
    """single kind, error wins over anomaly, NULL when neither."""
    return F.when(_c(has_error), F.lit("ERR")).when(_c(has_anomaly), F.lit("ANOMALY"))


def camel_case(name: Column | str) -> Column:
    """``create_order`` / ``create-order`` → ``createOrder`` (a separator followed by a word char)."""
    # split on separators that precede a word character, capitalise the first letter of every later piece
    parts = F.split(_c(name), "[_-](?=\\w)")
    return F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.element_at(parts, 1),
        lambda acc, p: F.concat(acc, F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))),
    )


def snake_case(name: Column | str) -> Column:
    """``createOrder`` → ``create_order``: underscore before capitals, lower-case, drop one leading ``_``."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(name), "([A-Z])", "_$1")), "^_", "")


def is_slow_call(duration_ms: Column | str) -> Column:
    """A single call is slow above 200 ms."""
    return _c(duration_ms) > F.lit(SLOW_CALL_MS)
