"""Report tables (A13, A16, A17, J8, O3, O4, O6-O8): the data behind the exported documents.

The reference renders these as Markdown / Mermaid / HTML text; here they are DataFrames (the text renderers are
not rebuilt). Node-level reports work on the export node table; per-span reports join a per-node aggregate back
instead of a window over all spans of one node, so a hot function never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions.scalar import duration_label, error_flags, js_round, relative_path, service_of
from spanlens.schema import arrival_key, conform

NODE_KEYS = ["agent_id", "function_name"]


def performance_report(nodes: DataFrame) -> DataFrame:
    """Per node total time avg*count and its share of the sum over all nodes (percent)."""
    total = nodes.agg(F.sum(F.col("avg_duration_ms") * F.col("call_count"))).scalar()  # scalar subquery
    own = F.col("avg_duration_ms") * F.col("call_count")
    return nodes.select(
        "*",
        own.alias("total_ms"),
        F.when(total > 0, own / total * 100).otherwise(F.lit(0.0)).alias("share_pct"),
        total.alias("all_nodes_ms"),
    )


def slowest(nodes: DataFrame, k: int = 8) -> DataFrame:
    """O3: the k nodes with the highest mean (first-seen order on ties), with their time share."""
    return performance_report(nodes).orderBy(F.col("avg_duration_ms").desc(), "first_seen").limit(k)


def costliest(nodes: DataFrame, k: int = 8) -> DataFrame:
    """The k nodes with the highest avg * calls (first-seen order on ties)."""
    return performance_report(nodes).orderBy(F.col("total_ms").desc(), "first_seen").limit(k)


def recent_errors(spans: DataFrame, k: int = 5, stack_lines: int = 6) -> DataFrame:
    """The k newest error spans by received_at (missing = 0), stack cut to its first lines."""
    s = conform(spans).where(F.col("has_error"))
    return s.orderBy(F.coalesce("received_at", F.lit(0)).desc(), "received_at", "ingest_seq").limit(k).select(
        "span_id", "agent_id", "function_name", "file", "line", "duration_ms", "received_at", "error_type",
        "error_message", F.substring_index(F.col("error_stack"), "\n", stack_lines).alias("error_stack"),
    )


def function_index(nodes: DataFrame, root: str | None = None) -> DataFrame:
    """Every node sorted by agent then function, with flag text, relative location and duration labels."""
    flags = F.concat_ws(", ", F.when(F.col("has_anomaly"), F.lit("⚠ anomaly")), F.when(F.col("has_error"), F.lit("✗ error")))
    return nodes.select(
        "agent_id", "function_name",
        flags.alias("flags"),
        F.concat(relative_path("file", root), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("undefined")))
        .alias("location"),
        duration_label("avg_duration_ms").alias("avg_label"),
        duration_label("p95_duration_ms").alias("p95_label"),
        "call_count",
        error_flags("has_error", "has_anomaly").alias("kind"),
    ).orderBy("agent_id", "function_name")


def service_rollup(nodes: DataFrame) -> DataFrame:
    """A16 + O8: nodes per service, Handlers first, Other last, the rest by name."""
    g = nodes.groupBy(service_of("function_name").alias("service")).agg(F.count(F.lit(1)).alias("node_count"))
    order = F.when(F.col("service") == "Handlers", 0).when(F.col("service") == "Other", 2).otherwise(1)
    return g.withColumn("service_order", order).orderBy("service_order", "service")


def duration_bars(spans: DataFrame, height: int = 28) -> DataFrame:
    """Per span bar height max(1, round(d / max * height)) against its node's max duration (1 if max = 0)."""
    s = conform(spans)
    mx = s.groupBy(*NODE_KEYS).agg(F.max("duration_ms").alias("_max"))
    j = s.select("span_id", *NODE_KEYS, "duration_ms").join(mx, NODE_KEYS)
    bar = F.when(F.col("_max") > 0, F.greatest(F.lit(1.0), js_round(F.col("duration_ms") / F.col("_max") * height)))
    return j.select("span_id", *NODE_KEYS, "duration_ms", F.coalesce(bar, F.lit(1.0)).cast("int").alias("bar_height"))


def error_examples(spans: DataFrame) -> DataFrame:
    """The first error (arrival order) per function name: type, message, stack."""
    s = conform(spans).where(F.col("has_error"))
    first = s.groupBy("function_name").agg(
        F.min_by(F.struct("error_type", "error_message", "error_stack"), arrival_key()).alias("_e")
    )
    return first.select(
        "function_name",
        F.col("_e.error_type").alias("error_type"),
        F.col("_e.error_message").alias("error_message"),
        F.coalesce(F.col("_e.error_stack"), F.lit("")).alias("error_stack"),
    )


def nodes_with_error_examples(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Nodes left-joined to the first error example of their function name."""
    return nodes.join(error_examples(spans), "function_name", "left")
