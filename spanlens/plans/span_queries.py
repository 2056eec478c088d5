"""Registered ingest, selection, retention and store queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.scalar import is_slow_call
from spanlens.operators import filters as FL
from spanlens.operators.ingest import flag_anomalies, flag_distributed, ingest
from spanlens.plans.registry import EV, EV_FLAGGED, events, register, with_ctes

EV_DISTRIBUTED = """
dist as (
  select *,
    coalesce(min(agent_id) over w <> agent_id or max(agent_id) over w <> agent_id, false) as distributed
  from span_events
  window w as (partition by trace_id order by received_at, ingest_seq rows between unbounded preceding and 1 preceding))
"""


@register("anomaly_flags", with_ctes(EV, EV_FLAGGED) + "\nselect span_id, agent_id, function_name, anomaly from flagged")
def q_anomaly_flags(spark, sf_dir):
    return flag_anomalies(events(spark, sf_dir)).select("span_id", "agent_id", "function_name", "anomaly")


@register("distributed_flags", with_ctes(EV, EV_DISTRIBUTED) + "\nselect span_id, trace_id, distributed from dist")
def q_distributed_flags(spark, sf_dir):
    return flag_distributed(events(spark, sf_dir)).select("span_id", "trace_id", "distributed")


def one_message(s: DataFrame) -> Column:
    """A span as a TraceEvent JSON object; its arrival stamps ride along as extra keys."""
    event = F.struct(
        F.lit("1.0").alias("schema_version"),
        "trace_id", "span_id", "parent_span_id",
        F.struct("agent_id", F.lit("js").alias("language"), "file", F.lit(1).alias("line"),
                 "function_name").alias("source"),
        F.struct(F.col("started_at").cast("double").alias("started_at"), "duration_ms").alias("timing"),
        F.parse_json(F.concat(F.lit("["), F.col("input_json"), F.lit("]"))).alias("input"),
        F.parse_json(F.col("output_json")).alias("output"),
        F.when(F.col("has_error"), F.struct(F.col("error_type").alias("type"), F.lit("failed").alias("message"),
                                            F.lit("").alias("stack"))).alias("error"),
        F.create_map().cast("map<string,string>").alias("tags"),
        "received_at", "ingest_seq",
    )
    return F.to_json(event, {"ignoreNullFields": "false"})


def span_messages(spans: DataFrame) -> DataFrame:
    """Encode spans as agent wire messages: TraceEvent JSON, batched per agent and 50 ms of arrival (a JSON
    array per batch, a bare object when the batch holds one span)."""
    s = spans
    one = s.select("agent_id", (F.col("received_at") / 50).cast("long").alias("batch"),
                   F.struct("received_at", "ingest_seq", one_message(s).alias("msg")).alias("m"))
    batched = one.groupBy("agent_id", "batch").agg(F.array_sort(F.collect_list("m")).alias("m")).select(
        F.transform("m", lambda x: x["msg"]).alias("msgs"))
    return batched.select(
        F.when(F.size("msgs") == 1, F.col("msgs")[0])
        .otherwise(F.concat(F.lit("["), F.array_join("msgs", ","), F.lit("]"))).alias("value")
    )


@register(
    "ingest_pipeline",
    with_ctes(EV, EV_FLAGGED, EV_DISTRIBUTED)
    + """
select f.span_id, f.anomaly, d.distributed, 0 as reason_count
from flagged f join dist d using (span_id)""",
)
def q_ingest_pipeline(spark, sf_dir):
    raw = span_messages(events(spark, sf_dir))
    flagged, bad = ingest(raw, "value", require_uuid=False, arrival_in_message=True)
    out = flagged.select("span_id", "anomaly", "distributed", F.lit(0).alias("reason_count"))
    rejected = bad.select("span_id", F.lit(False).alias("anomaly"), F.lit(False).alias("distributed"),
                          F.size("reasons").alias("reason_count"))
    return out.unionByName(rejected)


@register(
    "trace_summary",
    with_ctes(EV)
    + """
select trace_id, count(*) as span_count, list(distinct agent_id order by agent_id) as agents,
       count(distinct agent_id) > 1 as distributed
from span_events group by trace_id""",
)
def q_trace_summary(spark, sf_dir):
    return FL.trace_summary(events(spark, sf_dir))


@register(
    "store_status",
    with_ctes(EV) + "\nselect count(distinct agent_id) as agent_count, count(*) as total_spans from span_events",
)
def q_store_status(spark, sf_dir):
    return FL.store_status(events(spark, sf_dir))


@register("agents", with_ctes(EV) + "\nselect distinct agent_id from span_events")
def q_agents(spark, sf_dir):
    return FL.agents(events(spark, sf_dir))


@register(
    "time_range",
    with_ctes(EV) + "\nselect min(received_at) as min_received_at, max(received_at) as max_received_at from span_events",
)
def q_time_range(spark, sf_dir):
    return FL.time_range(events(spark, sf_dir))


@register(
    "recent_spans",
    with_ctes(EV)
    + "\nselect span_id, received_at from span_events order by received_at desc, ingest_seq desc limit 100",
)
def q_recent_spans(spark, sf_dir):
    return FL.recent(events(spark, sf_dir), k=100).select("span_id", "received_at")


@register(
    "recent_spans_agent",
    with_ctes(EV)
    + """
select span_id, received_at from span_events where agent_id = 'svc-1'
order by received_at desc, ingest_seq desc limit 5000""",
)
def q_recent_spans_agent(spark, sf_dir):
    return FL.recent(events(spark, sf_dir), k=5000, agent_id="svc-1").select("span_id", "received_at")


@register(
    "retain_last",
    with_ctes(EV)
    + "\nselect span_id from span_events order by received_at desc, ingest_seq desc limit 10000",
)
def q_retain_last(spark, sf_dir):
    return FL.retain_last(events(spark, sf_dir)).select("span_id")


@register(
    "latest_traces",
    with_ctes(EV)
    + """,
t as (select trace_id, max(started_at) as latest_started_at, min(received_at) as r0,
             arg_min(ingest_seq, received_at) as s0
      from span_events group by trace_id)
select trace_id, latest_started_at from t order by latest_started_at desc, r0, s0 limit 50""",
)
def q_latest_traces(spark, sf_dir):
    return FL.latest_traces(events(spark, sf_dir))


@register(
    "node_spans",
    with_ctes(EV)
    + """
select span_id, received_at from span_events where agent_id = 'svc-0' and function_name = 'raiseError'""",
)
def q_node_spans(spark, sf_dir):
    return FL.node_spans(events(spark, sf_dir), "svc-0", "raiseError").select("span_id", "received_at")


@register(
    "filter_spans_function",
    with_ctes(EV) + "\nselect span_id, function_name from span_events where contains(lower(function_name), 'service')",
)
def q_filter_spans_function(spark, sf_dir):
    return FL.filter_spans(events(spark, sf_dir), function="  Service ").select("span_id", "function_name")


@register(
    "filter_spans_agent_asof",
    with_ctes(EV)
    + "\nselect span_id from span_events where agent_id = 'svc-2' and received_at <= 1705276800000",
)
def q_filter_spans_agent_asof(spark, sf_dir):
    s = FL.as_of(events(spark, sf_dir), 1705276800000)
    return FL.filter_spans(s, agent_id="svc-2").select("span_id")


@register(
    "get_trace",
    with_ctes(EV) + "\nselect span_id, parent_span_id from span_events where trace_id = 'u8-2024-01-01'",
)
def q_get_trace(spark, sf_dir):
    return FL.get_trace(events(spark, sf_dir), "u8-2024-01-01").select("span_id", "parent_span_id")


@register(
    "anomaly_ticks",
    with_ctes(EV, EV_FLAGGED)
    + """,
r as (select min(received_at) as mn, max(received_at) as mx from span_events)
select span_id, received_at,
       cast(floor((received_at - mn) / greatest(mx - mn, 1) * 100 + 0.5) as bigint) as tick_pct
from flagged, r where anomaly""",
)
def q_anomaly_ticks(spark, sf_dir):
    return FL.anomaly_ticks(flag_anomalies(events(spark, sf_dir)))


@register(
    "slow_call_counts",
    with_ctes(EV)
    + """
select agent_id, function_name, count(*) filter (where duration_ms > 200) as slow_calls, count(*) as calls
from span_events group by all""",
)
def q_slow_call_counts(spark, sf_dir):
    s = events(spark, sf_dir)
    return s.groupBy("agent_id", "function_name").agg(
        F.count_if(is_slow_call("duration_ms")).alias("slow_calls"), F.count(F.lit(1)).alias("calls")
    )


@register("sample_traces_half")
def q_sample_traces(spark, sf_dir):
    """P15 (rows only: the hash is Spark's xxhash64): whole traces kept or dropped together."""
    return FL.sample_traces(events(spark, sf_dir), 0.5).select("trace_id", "span_id")
