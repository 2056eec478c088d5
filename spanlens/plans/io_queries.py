"""Registered source/sink round trips (S1, S2, S4-S6, S8, S9, S11) and tag / sampling filters.

Writers put their files under a fresh folder inside the shared checkpoint folder; the query returns what the
matching reader reads back, so the check covers both directions.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from spanlens.functions.scalar import service_of
from spanlens.operators import contracts as C
from spanlens.operators import filters as FL
from spanlens.operators import sessions as SS
from spanlens.plans.contract_queries import call_spans
from spanlens.plans.registry import EV, events, register, with_ctes
from spanlens.session import checkpoint_dir
from spanlens.sources import spans_io as IO


def _scratch(spark, tag: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"spanlens-{tag}-{uuid.uuid4().hex[:8]}")


@register(
    "ndjson_round_trip",
    with_ctes(EV)
    + "\nselect span_id, duration_ms from span_events order by received_at desc, ingest_seq desc",
)
def q_ndjson_round_trip(spark, sf_dir):
    root = _scratch(spark, "ndjson")
    IO.write_spans(call_spans(spark, sf_dir), root)
    return IO.read_spans(spark, root, require_uuid=False).select("span_id", "duration_ms")


@register(
    "snapshot_round_trip",
    with_ctes(EV)
    + """,
last as (select * from span_events)
select 'snap-1' as snapshot_id, count(*) as span_count, list(distinct agent_id order by agent_id) as agents,
       count(*) filter (where has_error) as error_spans
from last""",
)
def q_snapshot_round_trip(spark, sf_dir):
    root = _scratch(spark, "snap")
    IO.write_snapshot(call_spans(spark, sf_dir), root, "snap-1")
    listed = IO.list_snapshots(spark, root).select("snapshot_id", "span_count", F.array_sort("agents").alias("agents"))
    back = IO.load_snapshot(spark, root, "snap-1", require_uuid=False)
    errs = back.groupBy("snapshot_id").agg(F.count_if("has_error").alias("error_spans"))
    return listed.join(errs, "snapshot_id").select("snapshot_id", F.col("span_count").cast("long").alias("span_count"),
                                                   "agents", "error_spans")


@register(
    "sessions_round_trip",
    with_ctes(EV)
    + """
select case when received_at <= 1705276800000 then 'before' else 'after' end as session, count(*) as call_count,
       count(distinct function_name) as functions
from span_events group by all""",
)
def q_sessions_round_trip(spark, sf_dir):
    s = events(spark, sf_dir)
    b, mb = SS.record_session(s.where(F.col("received_at") <= 1705276800000), "before")
    a, ma = SS.record_session(s.where(F.col("received_at") > 1705276800000), "after")
    root = _scratch(spark, "sessions")
    IO.write_sessions(b.unionByName(a), mb.unionByName(ma), root)
    calls, meta = IO.read_sessions(spark, root)
    c = calls.groupBy("session").agg(F.count(F.lit(1)).alias("call_count"),
                                     F.count_distinct("function").alias("functions"))
    return c.join(meta.select("session"), "session")


@register(
    "contracts_round_trip",
    with_ctes(EV)
    + """
select function_name, count(*) as sample_count, count(distinct error_type) as error_schemas
from span_events group by all having count(*) >= 5""",
)
def q_contracts_round_trip(spark, sf_dir):
    root = _scratch(spark, "contracts")
    IO.write_contracts(C.infer_contracts(call_spans(spark, sf_dir)), root)
    back = IO.read_contracts(spark, root)
    return back.select("function_name", "sample_count",
                       F.when(F.col("errors").isNull(), F.lit(0)).otherwise(F.size("errors")).cast("long")
                       .alias("error_schemas"))


@register(
    "share_codes",
    with_ctes(EV)
    + """,
d as (select trace_id, '{"id":"' || trace_id || '","createdAt":' || max(received_at) || ',"spans":'
             || count(*) || '}' as doc from span_events group by trace_id)
select trace_id, replace(replace(rtrim(to_base64(encode(doc)), '='), '+', '-'), '/', '_') as code,
       true as round_trip
from d""",
)
def q_share_codes(spark, sf_dir):
    s = events(spark, sf_dir)
    d = s.groupBy("trace_id").agg(F.concat(
        F.lit('{"id":"'), F.col("trace_id"), F.lit('","createdAt":'), F.max("received_at").cast("string"),
        F.lit(',"spans":'), F.count(F.lit(1)).cast("string"), F.lit("}")).alias("doc"))
    coded = d.withColumn("code", IO.encode_snapshot(F.col("doc")))
    return coded.select("trace_id", "code", (IO.decode_snapshot(F.col("code")) == F.col("doc")).alias("round_trip"))


@register(
    "filter_spans_tag",
    with_ctes(EV)
    + """
select span_id from span_events
where contains(lower(case when strpos(function_name, '.') > 1 then split_part(function_name, '.', 1)
                          when regexp_matches(function_name, '^(handle|process)[A-Z]') then 'Handlers'
                          else 'Other' end), 'order')
   or contains(lower(agent_id), 'order')
   or contains('service', 'order') or contains('agent', 'order')""",
)
def q_filter_spans_tag(spark, sf_dir):
    s = events(spark, sf_dir).withColumn(
        "tags", F.create_map(F.lit("service"), service_of("function_name"), F.lit("agent"), F.col("agent_id")))
    return FL.filter_spans(s, tag=" ORDER ").select("span_id")


@register("sample_spans_half")
def q_sample_spans(spark, sf_dir):
    """P14 (rows only: a sampling operator; Bernoulli per span, seeded)."""
    return FL.sample_spans(events(spark, sf_dir), 0.5, seed=7).select("span_id")
