"""Span selections, retention, top-k and store summaries.

All predicates are plain Column expressions, so Catalyst pushes them into the Parquet scan when the span table
is read from files (``PushedFilters``). Top-k uses ``orderBy().limit()`` which plans as a per-partition top-k
followed by one small merge (``TakeOrderedAndProject``), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.scalar import js_round
from spanlens.schema import conform

RING_CAPACITY = 10_000


def _newest_first() -> list[Column]:
    return [F.col("received_at").desc_nulls_last(), F.col("ingest_seq").desc_nulls_last()]


def filter_spans(spans: DataFrame, agent_id: str | None = None, function: str = "", tag: str = "") -> DataFrame:
    """Exact agent; function name trimmed case-insensitive substring; tag key or value substring."""
    s = spans
    if agent_id is not None:
        s = s.where(F.col("agent_id") == F.lit(agent_id))
    if function.strip() != "":
        s = s.where(F.lower(F.col("function_name")).contains(function.strip().lower()))
    if tag.strip() != "":
        q = tag.strip().lower()
        s = conform(s).where(
            F.exists(F.map_entries("tags"),
                     lambda e: F.lower(e["key"]).contains(q) | F.lower(e["value"]).contains(q))
        )
    return s


def as_of(spans: DataFrame, seek_ts: int | None) -> DataFrame:
    """P5: time travel, spans received at or before ``seek_ts`` (None = everything)."""
    return spans if seek_ts is None else spans.where(F.col("received_at") <= F.lit(seek_ts))


def get_span(spans: DataFrame, span_id: str) -> DataFrame:
    """The span with this id (the last one to arrive when ids repeat)."""
    return spans.where(F.col("span_id") == F.lit(span_id)).orderBy(*_newest_first()).limit(1)


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace in arrival order."""
    return spans.where(F.col("trace_id") == F.lit(trace_id)).orderBy("received_at", "ingest_seq")


def node_spans(spans: DataFrame, agent_id: str, function_name: str) -> DataFrame:
    """P10: all spans of one node, newest first."""
    return spans.where((F.col("agent_id") == agent_id) & (F.col("function_name") == function_name)).orderBy(
        *_newest_first()
    )


def anomaly_ticks(spans: DataFrame) -> DataFrame:
    """received_at of anomalous spans with their timeline position round((ts-min)/max(range,1)*100)."""
    lo = spans.agg(F.min("received_at")).scalar()  # scalar subqueries over the whole table
    hi = spans.agg(F.max("received_at")).scalar()
    a = spans.where(F.col("anomaly")).select("span_id", "received_at")
    pos = js_round((F.col("received_at") - lo) / F.greatest(hi - lo, F.lit(1)) * 100)
    return a.select("span_id", "received_at", pos.cast("long").alias("tick_pct"))


def filter_calls(calls: DataFrame, function: str = "", status: str = "all") -> DataFrame:
    """Session call filter, function substring (case-insensitive) and errors / success / all."""
    c = calls
    if function.strip() != "":
        c = c.where(F.lower(F.col("function")).contains(function.strip().lower()))
    if status == "errors":
        c = c.where(F.col("error_type").isNotNull())
    elif status == "success":
        c = c.where(F.col("error_type").isNull())
    return c


def sample_spans(spans: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Head sampling per span, rate clamped to [0, 1] (a sampling operator, so rows are dropped by design)."""
    r = min(1.0, max(0.0, rate))
    if r >= 1.0:
        return spans
    return spans.sample(withReplacement=False, fraction=r, seed=seed)


def sample_traces(spans: DataFrame, rate: float) -> DataFrame:
    """Whole-trace sampling: a trace is kept or dropped as a unit, decided by a hash of its id."""
    r = min(1.0, max(0.0, rate))
    return spans.where(F.pmod(F.xxhash64("trace_id"), F.lit(1_000_000)) < F.lit(int(r * 1_000_000)))


def recent(spans: DataFrame, k: int = 100, agent_id: str | None = None) -> DataFrame:
    """O1: newest spans first, optional agent, limit k."""
    s = spans if agent_id is None else spans.where(F.col("agent_id") == agent_id)
    return s.orderBy(*_newest_first()).limit(k)


def retain_last(spans: DataFrame, n: int = RING_CAPACITY) -> DataFrame:
    """Ring retention, the last ``n`` spans by arrival."""
    return spans.orderBy(*_newest_first()).limit(n)


def latest_traces(spans: DataFrame, k: int = 50) -> DataFrame:
    """O2: trace ids by their latest ``started_at``, newest first, first ``k``."""
    t = spans.groupBy("trace_id").agg(
        F.max("started_at").alias("latest_started_at"),
        F.min(F.struct("received_at", "ingest_seq")).alias("_first"),
    )
    return t.orderBy(F.col("latest_started_at").desc(), F.col("_first")).limit(k).drop("_first")


def store_status(spans: DataFrame) -> DataFrame:
    """Distinct agents and total spans (one row)."""
    return spans.agg(F.count_distinct("agent_id").alias("agent_count"), F.count(F.lit(1)).alias("total_spans"))


def agents(spans: DataFrame) -> DataFrame:
    """A10: distinct agent ids, sorted."""
    return spans.select("agent_id").distinct().orderBy("agent_id")


def time_range(spans: DataFrame) -> DataFrame:
    """Min / max received_at (NULLs for an empty table)."""
    return spans.agg(F.min("received_at").alias("min_received_at"), F.max("received_at").alias("max_received_at"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Per trace: span count, sorted agent list, distributed = more than one agent."""
    t = spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.array_sort(F.collect_set("agent_id")).alias("agents"),
    )
    return t.withColumn("distributed", F.size("agents") > 1)
