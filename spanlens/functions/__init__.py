from spanlens.functions.scalar import (  # noqa: F401
    FORMAT_ORDER,
    FORMAT_PATTERNS,
    base_name,
    camel_case,
    duration_label,
    error_flags,
    first_format,
    flag_kind,
    format_hit,
    is_slow_call,
    iso_time,
    js_round,
    js_type,
    relative_path,
    safe_id,
    service_of,
    snake_case,
)
from spanlens.functions.stats import exact_rank_value, order_bucket, p95_floor, p95_rank  # noqa: F401
