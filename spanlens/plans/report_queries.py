"""Registered report queries (A13, A16, A17, J8, O3, O4, O6, O7, O8) and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.functions import scalar as S
from spanlens.operators import graph as G
from spanlens.operators import reports as RP
from spanlens.operators.ingest import flag_anomalies
from spanlens.functions.stats import sql_rounded_mean
from spanlens.plans.registry import EV, EV_FLAGGED, events, r6, register, sql_r, sql_r6, with_ctes

_EXPORT_NODES_SQL = f"""
nd as (
  select *, row_number() over (partition by agent_id, function_name order by duration_ms) as drn,
         count(*) over (partition by agent_id, function_name) as dn
  from flagged),
xn as (
  select agent_id, function_name, count(*) as call_count, first(file order by received_at, ingest_seq) as file,
         {sql_rounded_mean('duration_ms', 2)} as avg_duration_ms,
         {sql_r('max(case when drn = greatest(ceil(0.95::double * dn) - 1, 0) + 1 then duration_ms end)', 2)}
           as p95_duration_ms,
         bool_or(anomaly) as has_anomaly, bool_or(has_error) as has_error,
         min(received_at) as fr, arg_min(ingest_seq, received_at) as fs
  from nd group by agent_id, function_name),
perf as (
  select *, avg_duration_ms * call_count as total_ms,
         sum(avg_duration_ms * call_count) over () as all_ms
  from xn)
"""


def _export_nodes(spark, sf_dir):
    return G.export_nodes(flag_anomalies(events(spark, sf_dir)))


@register(
    "performance_report",
    with_ctes(EV, EV_FLAGGED, _EXPORT_NODES_SQL)
    + f"""
select agent_id, function_name, {sql_r6('total_ms')} as total_ms,
       {sql_r6('case when all_ms > 0 then total_ms / all_ms * 100 else 0 end')} as share_pct
from perf""",
)
def q_performance_report(spark, sf_dir):
    p = RP.performance_report(_export_nodes(spark, sf_dir))
    return p.select("agent_id", "function_name", r6("total_ms").alias("total_ms"), r6("share_pct").alias("share_pct"))


@register(
    "slowest_functions",
    with_ctes(EV, EV_FLAGGED, _EXPORT_NODES_SQL)
    + f"""
select agent_id, function_name, avg_duration_ms, p95_duration_ms, call_count,
       {sql_r6('case when all_ms > 0 then total_ms / all_ms * 100 else 0 end')} as share_pct
from perf order by avg_duration_ms desc, fr, fs limit 8""",
)
def q_slowest_functions(spark, sf_dir):
    s = RP.slowest(_export_nodes(spark, sf_dir), 8)
    return s.select("agent_id", "function_name", "avg_duration_ms", "p95_duration_ms", "call_count",
                    r6("share_pct").alias("share_pct"))


@register(
    "costliest_functions",
    with_ctes(EV, EV_FLAGGED, _EXPORT_NODES_SQL)
    + f"""
select agent_id, function_name, {sql_r6('total_ms')} as total_ms, call_count
from perf order by total_ms desc, fr, fs limit 8""",
)
def q_costliest_functions(spark, sf_dir):
    c = RP.costliest(_export_nodes(spark, sf_dir), 8)
    return c.select("agent_id", "function_name", r6("total_ms").alias("total_ms"), "call_count")


@register(
    "recent_errors",
    with_ctes(EV)
    + """
select span_id, function_name, error_type, received_at from span_events where has_error
order by coalesce(received_at, 0) desc, received_at, ingest_seq limit 5""",
)
def q_recent_errors(spark, sf_dir):
    return RP.recent_errors(events(spark, sf_dir)).select("span_id", "function_name", "error_type", "received_at")


def _dl(x: str) -> str:
    return (f"case when {x} < 1 then cast(floor({x} * 1000 * 1.0 + 0.5) as bigint) || 'µs' "
            f"when {x} < 1000 then printf('%.1f', floor({x} * 10.0 + 0.5) / 10.0) || 'ms' "
            f"else printf('%.2f', floor({x} / 1000 * 100.0 + 0.5) / 100.0) || 's' end")


@register(
    "function_index",
    with_ctes(EV, EV_FLAGGED, _EXPORT_NODES_SQL)
    + f"""
select agent_id, function_name,
       concat_ws(', ', case when has_anomaly then '⚠ anomaly' end, case when has_error then '✗ error' end) as flags,
       file || ':undefined' as location, {_dl('avg_duration_ms')} as avg_label, {_dl('p95_duration_ms')} as p95_label,
       call_count
from xn""",
)
def q_function_index(spark, sf_dir):
    f = RP.function_index(_export_nodes(spark, sf_dir))
    return f.select("agent_id", "function_name", "flags", "location", "avg_label", "p95_label", "call_count")


_SERVICE = ("case when strpos(function_name, '.') > 1 then split_part(function_name, '.', 1) "
            "when regexp_matches(function_name, '^(handle|process)[A-Z]') then 'Handlers' else 'Other' end")


@register(
    "service_rollup",
    with_ctes(EV)
    + f""",
n as (select distinct agent_id, function_name from span_events)
select {_SERVICE} as service, count(*) as node_count,
       case when {_SERVICE} = 'Handlers' then 0 when {_SERVICE} = 'Other' then 2 else 1 end as service_order
from n group by all""",
)
def q_service_rollup(spark, sf_dir):
    return RP.service_rollup(_export_nodes(spark, sf_dir))


@register(
    "duration_bars",
    with_ctes(EV)
    + """
select span_id, cast(case when m > 0 then greatest(1, floor(duration_ms / m * 28 + 0.5)) else 1 end as integer)
         as bar_height
from (select *, max(duration_ms) over (partition by agent_id, function_name) as m from span_events)""",
)
def q_duration_bars(spark, sf_dir):
    return RP.duration_bars(events(spark, sf_dir)).select("span_id", "bar_height")


@register(
    "error_examples",
    with_ctes(EV)
    + """
select function_name, first(error_type order by received_at, ingest_seq) as error_type
from span_events where has_error group by function_name""",
)
def q_error_examples(spark, sf_dir):
    return RP.error_examples(events(spark, sf_dir)).select("function_name", "error_type")


@register(
    "scalar_functions",
    with_ctes(EV)
    + f"""
select span_id, {_dl('duration_ms')} as duration_label, {_SERVICE} as service,
       case when strpos(function_name, '.') > 0 then regexp_replace(function_name, '^[^.]*\\.', '') else function_name end
         as base_name,
       strftime(epoch_ms(started_at), '%Y-%m-%dT%H:%M:%S.%gZ') as iso_time,
       regexp_replace(agent_id || ':' || function_name, '[^a-zA-Z0-9_]', '_', 'g') as safe_id,
       regexp_replace(lower(regexp_replace(function_name, '([A-Z])', '_\\1', 'g')), '^_', '') as snake_name,
       case json_type(output_json) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string'
            when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as js_type,
       case when starts_with(file, 'src/') then substr(file, 5) else file end as rel_file,
       coalesce(case when has_error then 'ERR' end, '') as flags,
       {sql_r('duration_ms', 1)} as rounded_1
from span_events""",
)
def q_scalar_functions(spark, sf_dir):
    s = events(spark, sf_dir)
    return s.select(
        "span_id",
        S.duration_label("duration_ms").alias("duration_label"),
        S.service_of("function_name").alias("service"),
        S.base_name("function_name").alias("base_name"),
        S.iso_time("started_at").alias("iso_time"),
        S.safe_id(F.concat_ws(":", "agent_id", "function_name")).alias("safe_id"),
        S.snake_case("function_name").alias("snake_name"),
        S.js_type("output_json").alias("js_type"),
        S.relative_path("file", "src").alias("rel_file"),
        S.error_flags("has_error", F.lit(False)).alias("flags"),
        S.js_round("duration_ms", 1).alias("rounded_1"),
    )
