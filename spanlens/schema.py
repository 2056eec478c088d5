"""The span table: column names, types and the arrival order.

A span is one function call. The flat column layout below is what every operator reads; ``conform`` adds the
optional columns a source may lack (as typed NULL/default literals, which Catalyst folds away when unused).
Payloads (``input_json``, ``output_json``) stay JSON text and are parsed to VARIANT only where an operator
needs to look inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the span format (must equal the reference's rules).
SCHEMA_VERSION = "1.0"
LANGUAGES = ["js", "python", "go", "rust", "java", "csharp", "other"]
UUID_PATTERN = "(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}\\z"

ERROR_TYPE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("stack", T.StringType()),
    ]
)

# Canonical flat span columns and their types.
SPAN_COLUMNS: dict[str, T.DataType] = {
    "schema_version": T.StringType(),
    "trace_id": T.StringType(),
    "span_id": T.StringType(),
    "parent_span_id": T.StringType(),
    "agent_id": T.StringType(),
    "language": T.StringType(),
    "file": T.StringType(),
    "line": T.LongType(),
    "function_name": T.StringType(),
    "description": T.StringType(),
    "started_at": T.DoubleType(),
    "duration_ms": T.DoubleType(),
    "input_json": T.StringType(),
    "output_json": T.StringType(),
    "has_error": T.BooleanType(),
    "error_type": T.StringType(),
    "error_message": T.StringType(),
    "error_stack": T.StringType(),
    "tags": T.MapType(T.StringType(), T.StringType()),
    "received_at": T.LongType(),
    "ingest_seq": T.LongType(),
    "anomaly": T.BooleanType(),
    "distributed": T.BooleanType(),
}

SPAN_SCHEMA = T.StructType([T.StructField(k, v) for k, v in SPAN_COLUMNS.items()])

def _defaults() -> dict[str, Column]:
    return {
        "schema_version": F.lit(SCHEMA_VERSION),
        "language": F.lit("other"),
        "file": F.lit(""),
        "tags": F.create_map().cast(T.MapType(T.StringType(), T.StringType())),
        "anomaly": F.lit(False),
        "distributed": F.lit(False),
        "ingest_seq": F.lit(0).cast("long"),
        "input_json": F.lit("[]"),
    }


def conform(df: DataFrame) -> DataFrame:
    """Add the optional span columns a source lacks, keep the ones it has (plus any extra columns)."""
    cols = set(df.columns)
    out = df
    defaults = _defaults()
    if "has_error" not in cols:
        out = out.withColumn("has_error", F.col("error_type").isNotNull() if "error_type" in cols else F.lit(False))
    for name, dtype in SPAN_COLUMNS.items():
        if name in out.columns:
            continue
        default = defaults.get(name, F.lit(None))
        out = out.withColumn(name, default.cast(dtype))
    return out


def arrival() -> list[Column]:
    """Arrival order ``ARR`` (received_at, ingest_seq): the total order every sequential rule uses."""
    return [F.col("received_at").asc_nulls_first(), F.col("ingest_seq").asc_nulls_first()]


def arrival_key(prefix: str = "") -> Column:
    """Arrival order as one orderable struct (for min_by / max_by)."""
    return F.struct(F.col(prefix + "received_at").alias("r"), F.col(prefix + "ingest_seq").alias("s"))
