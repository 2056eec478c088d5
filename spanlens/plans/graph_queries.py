"""Registered call-graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.operators import graph as G
from spanlens.operators.ingest import flag_anomalies
from spanlens.functions.stats import sql_rounded_mean, with_rounded_mean
from spanlens.plans.registry import EV, EV_FLAGGED, ORD, events, orders, r6, register, sql_r, sql_r6, with_ctes

# ---------------------------------------------------------------- A1 + A3 live nodes

_LIVE_NODES_SQL = """
nd as (
  select *, row_number() over (partition by agent_id, function_name order by duration_ms) as drn,
         count(*) over (partition by agent_id, function_name) as dn
  from flagged),
n as (
  select agent_id, function_name, count(*) as call_count, avg(duration_ms) as avg_ms,
         {avg6} as avg6,
         max(case when drn = least(floor(0.95::double * dn), dn - 1) + 1 then duration_ms end) as p95,
         bool_or(anomaly) as has_anomaly, bool_or(has_error) as has_error,
         first(file order by received_at, ingest_seq) as file,
         first(span_id order by received_at desc, ingest_seq) as latest_span_id
  from nd group by agent_id, function_name),
ns as (
  select *, row_number() over (order by avg_ms, agent_id, function_name) as rn, count(*) over () as nn from n),
slow as (
  select *, max(case when rn = least(floor(0.95::double * nn), nn - 1) + 1 then avg_ms end) over () as thr from ns)
""".replace("{avg6}", sql_rounded_mean("duration_ms", 6))


def mean6(df: DataFrame) -> DataFrame:
    """Reported mean: the exact mean rounded half-up to 6 places (integer arithmetic, same in DuckDB)."""
    return with_rounded_mean(df, "total_duration_ms", "call_count", 6, "avg_duration_ms")


def live_nodes_out(nodes: DataFrame) -> DataFrame:
    return mean6(nodes).select(
        "agent_id", "function_name", "node_id", "file", "call_count", "avg_duration_ms", "p95_duration_ms",
        "has_anomaly", "has_error", "latest_span_id", "is_slow",
    )


@register(
    "call_graph_nodes",
    with_ctes(EV, EV_FLAGGED, _LIVE_NODES_SQL)
    + f"""
select agent_id, function_name, concat(agent_id, ':', function_name) as node_id, file, call_count,
       avg6 as avg_duration_ms, p95 as p95_duration_ms, has_anomaly, has_error, latest_span_id,
       (nn >= 5 and avg_ms >= thr) as is_slow
from slow""",
)
def q_call_graph_nodes(spark, sf_dir):
    return live_nodes_out(G.call_graph_nodes(flag_anomalies(events(spark, sf_dir))))


@register(
    "call_graph_nodes_orders",
    with_ctes(ORD)
    + """,
nd as (
  select *, row_number() over (partition by agent_id, function_name order by duration_ms) as drn,
         count(*) over (partition by agent_id, function_name) as dn
  from span_orders),
n as (
  select agent_id, function_name, count(*) as call_count, avg(duration_ms) as avg_ms,
         {avg6} as avg6,
         max(case when drn = least(floor(0.95::double * dn), dn - 1) + 1 then duration_ms end) as p95
  from nd group by agent_id, function_name),
ns as (select *, row_number() over (order by avg_ms, agent_id, function_name) as rn, count(*) over () as nn from n),
slow as (select *, max(case when rn = least(floor(0.95::double * nn), nn - 1) + 1 then avg_ms end) over () as thr
         from ns)
""".replace("{avg6}", sql_rounded_mean("duration_ms", 6))
    + f"""
select agent_id, function_name, call_count, avg6 as avg_duration_ms, p95 as p95_duration_ms,
       (nn >= 5 and avg_ms >= thr) as is_slow
from slow""",
)
def q_call_graph_nodes_orders(spark, sf_dir):
    n = mean6(G.call_graph_nodes(orders(spark, sf_dir)))
    return n.select("agent_id", "function_name", "call_count", "avg_duration_ms", "p95_duration_ms", "is_slow")


# ---------------------------------------------------------------- A2 live edges

_LIVE_EDGES_SQL = """
idx as (
  select span_id, agent_id, function_name from (
    select span_id, agent_id, function_name,
           row_number() over (partition by span_id order by received_at desc, ingest_seq desc) as k
    from span_events) where k = 1),
links as (
  select p.agent_id as src_agent_id, p.function_name as src_function_name,
         ch.agent_id as dst_agent_id, ch.function_name as dst_function_name, c.duration_ms
  from span_events c join idx p on c.parent_span_id = p.span_id join idx ch on c.span_id = ch.span_id)
"""


@register(
    "call_graph_edges",
    with_ctes(EV, _LIVE_EDGES_SQL)
    + f"""
select src_agent_id, src_function_name, dst_agent_id, dst_function_name, count(*) as call_count,
       {sql_rounded_mean('duration_ms', 6)} as avg_duration_ms
from links
where not (src_agent_id = dst_agent_id and src_function_name = dst_function_name)
group by all""",
)
def q_call_graph_edges(spark, sf_dir):
    e = mean6(G.call_graph_edges(events(spark, sf_dir)))
    return e.select(*G.SRC, *G.DST, "call_count", "avg_duration_ms")


@register(
    "call_graph_edges_orders",
    with_ctes(ORD)
    + f"""
select p.agent_id as src_agent_id, p.function_name as src_function_name,
       c.agent_id as dst_agent_id, c.function_name as dst_function_name, count(*) as call_count,
       {sql_rounded_mean('c.duration_ms', 6)} as avg_duration_ms
from span_orders c join span_orders p on c.parent_span_id = p.span_id
where not (p.agent_id = c.agent_id and p.function_name = c.function_name)
group by all""",
)
def q_call_graph_edges_orders(spark, sf_dir):
    e = mean6(G.call_graph_edges(orders(spark, sf_dir)))
    return e.select(*G.SRC, *G.DST, "call_count", "avg_duration_ms")


# ---------------------------------------------------------------- A6 / A7 / A8 export graph


@register(
    "export_nodes",
    with_ctes(EV, EV_FLAGGED)
    + """,
nd as (
  select *, row_number() over (partition by agent_id, function_name order by duration_ms) as drn,
         count(*) over (partition by agent_id, function_name) as dn
  from flagged)
"""
    + f"""
select agent_id, function_name, concat(agent_id, '::', function_name) as node_id,
       first(file order by received_at, ingest_seq) as file, count(*) as call_count,
       {sql_rounded_mean('duration_ms', 2)} as avg_duration_ms,
       {sql_r('max(case when drn = greatest(ceil(0.95::double * dn) - 1, 0) + 1 then duration_ms end)', 2)}
         as p95_duration_ms,
       bool_or(anomaly) as has_anomaly, bool_or(has_error) as has_error
from nd group by agent_id, function_name""",
)
def q_export_nodes(spark, sf_dir):
    n = G.export_nodes(flag_anomalies(events(spark, sf_dir)))
    return n.select("agent_id", "function_name", "node_id", "file", "call_count", "avg_duration_ms",
                    "p95_duration_ms", "has_anomaly", "has_error")


@register(
    "export_edges",
    with_ctes(EV)
    + f""",
idx as (
  select span_id, agent_id, function_name from (
    select span_id, agent_id, function_name,
           row_number() over (partition by span_id order by received_at desc, ingest_seq desc) as k
    from span_events) where k = 1)
select p.agent_id as src_agent_id, p.function_name as src_function_name,
       c.agent_id as dst_agent_id, c.function_name as dst_function_name, count(*) as call_count,
       {sql_rounded_mean('c.duration_ms', 2)} as avg_duration_ms
from span_events c join idx p on c.parent_span_id = p.span_id
group by all""",
)
def q_export_edges(spark, sf_dir):
    e = G.export_edges(events(spark, sf_dir))
    return e.select(*G.SRC, *G.DST, "call_count", "avg_duration_ms")


@register(
    "export_summary",
    with_ctes(EV, EV_FLAGGED)
    + """,
n as (select agent_id, function_name, bool_or(anomaly) as a, bool_or(has_error) as e
      from flagged group by agent_id, function_name)
select (select count(distinct agent_id) from span_events) as agent_count,
       (select list(distinct agent_id order by agent_id) from span_events) as agents,
       (select count(*) from span_events) as total_spans,
       (select count(*) filter (where a) from n) as anomaly_count,
       (select count(*) filter (where e) from n) as error_count""",
)
def q_export_summary(spark, sf_dir):
    s = flag_anomalies(events(spark, sf_dir))
    return G.export_summary(s)


# ---------------------------------------------------------------- A4 / A5 collapse


@register(
    "collapse_by_agent_nodes",
    with_ctes(EV, EV_FLAGGED, _LIVE_NODES_SQL)
    + f""",
g as (
  select n.*, 'group:agent:' || n.agent_id as group_id,
         row_number() over (partition by n.agent_id order by avg_ms, n.agent_id, n.function_name) as grn,
         count(*) over (partition by n.agent_id) as gk
  from slow n)
select group_id, concat(agent_id, ' (', count(*), case when count(*) <> 1 then ' fns)' else ' fn)' end)
         as function_name,
       agent_id, sum(call_count) as call_count, {sql_r6('avg(avg_ms)')} as avg_duration_ms,
       {sql_r6('max(case when grn = least(floor(0.95::double * gk), gk - 1) + 1 then avg_ms end)')}
         as p95_duration_ms,
       bool_or(has_anomaly) as has_anomaly, bool_or(has_error) as has_error,
       bool_or(nn >= 5 and avg_ms >= thr) as is_slow
from g group by group_id, agent_id""",
)
def q_collapse_by_agent_nodes(spark, sf_dir):
    s = flag_anomalies(events(spark, sf_dir))
    g = G.collapse(G.call_graph(s), "agent")
    return g.nodes.select(
        "group_id", "function_name", "agent_id", "call_count", r6("avg_duration_ms").alias("avg_duration_ms"),
        r6("p95_duration_ms").alias("p95_duration_ms"), "has_anomaly", "has_error", "is_slow",
    )


@register(
    "collapse_by_agent_edges",
    with_ctes(EV, _LIVE_EDGES_SQL)
    + f""",
ge as (select src_agent_id, src_function_name, dst_agent_id, dst_function_name, count(*) as c,
             avg(duration_ms) as m
      from links where not (src_agent_id = dst_agent_id and src_function_name = dst_function_name)
      group by all)
select 'group:agent:' || src_agent_id as src_group, 'group:agent:' || dst_agent_id as dst_group,
       sum(c) as call_count, {sql_r6('avg(m)')} as avg_duration_ms
from ge where src_agent_id <> dst_agent_id group by all""",
)
def q_collapse_by_agent_edges(spark, sf_dir):
    s = events(spark, sf_dir)
    g = G.collapse(G.Graph(G.call_graph_nodes(s), G.call_graph_edges(s)), "agent")
    return g.edges.select("src_group", "dst_group", "call_count", r6("avg_duration_ms").alias("avg_duration_ms"))


# ---------------------------------------------------------------- G1 / J3 / U4 diff between two cuts

CUT_TS = 1705276800000  # 2024-01-15T00:00:00Z: base = spans received before, current = all


@register(
    "graph_diff",
    with_ctes(EV)
    + f""",
b as (select agent_id, function_name, avg(duration_ms) as ba from span_events where received_at <= {CUT_TS} group by all),
c as (select agent_id, function_name, avg(duration_ms) as ca from span_events group by all),
j as (select coalesce(c.agent_id, b.agent_id) as agent_id, coalesce(c.function_name, b.function_name) as function_name,
             b.ba, c.ca, case when b.ba > 0 then (c.ca - b.ba) / b.ba * 100 else 0 end as d
      from c full outer join b on c.agent_id = b.agent_id and c.function_name = b.function_name)
select agent_id, function_name,
       case when ca is null then 'removed' when ba is null then 'added' when d > 10 then 'slower'
            when d < -10 then 'faster' else 'unchanged' end as status,
       {sql_r6('case when ca is null or ba is null then 0 else d end')} as delta_pct
from j""",
)
def q_graph_diff(spark, sf_dir):
    s = events(spark, sf_dir)
    base = G.call_graph_nodes(s.where(F.col("received_at") <= CUT_TS))
    cur = G.call_graph_nodes(s)
    return G.graph_diff(base, cur).select("agent_id", "function_name", "status", r6("delta_pct").alias("delta_pct"))


@register(
    "removed_nodes",
    with_ctes(EV)
    + """
select count(*) as removed_count from (
  select distinct agent_id, function_name from span_events
  except select distinct agent_id, function_name from span_events where function_name like 'UiService.%')""",
)
def q_removed_nodes(spark, sf_dir):
    s = events(spark, sf_dir)
    return G.removed_nodes(G.call_graph_nodes(s), G.call_graph_nodes(s.where(F.col("function_name").startswith("UiService."))))


# ---------------------------------------------------------------- P6 / P7 / P8 / P18 / P19 / J7 / A19

_SLOW_NODES_SQL = with_ctes(EV, EV_FLAGGED, _LIVE_NODES_SQL) + """,
nodes as (select agent_id, function_name, call_count, avg_ms, has_anomaly, has_error,
                 (nn >= 5 and avg_ms >= thr) as is_slow from slow)
"""


@register(
    "filter_graph_errors_edges",
    with_ctes(EV, EV_FLAGGED, _LIVE_NODES_SQL, _LIVE_EDGES_SQL)
    + """,
k as (select agent_id, function_name from n where has_error)
select distinct src_agent_id, src_function_name, dst_agent_id, dst_function_name from links
where not (src_agent_id = dst_agent_id and src_function_name = dst_function_name)
  and (src_agent_id, src_function_name) in (select * from k)
  and (dst_agent_id, dst_function_name) in (select * from k)""",
)
def q_filter_graph_errors_edges(spark, sf_dir):
    g = G.filter_graph(G.call_graph(flag_anomalies(events(spark, sf_dir))), "errors")
    return g.edges.select(*G.SRC, *G.DST)


@register("filter_graph_slow_nodes", _SLOW_NODES_SQL + "select agent_id, function_name from nodes where is_slow")
def q_filter_graph_slow_nodes(spark, sf_dir):
    g = G.filter_graph(G.call_graph(flag_anomalies(events(spark, sf_dir))), "slow")
    return g.nodes.select("agent_id", "function_name")


@register(
    "hide_nodes_edges",
    with_ctes(EV, _LIVE_EDGES_SQL)
    + """
select distinct src_agent_id, src_function_name, dst_agent_id, dst_function_name from links
where not (src_agent_id = dst_agent_id and src_function_name = dst_function_name)
  and src_function_name <> 'raiseError' and dst_function_name <> 'raiseError'""",
)
def q_hide_nodes_edges(spark, sf_dir):
    g = G.call_graph(events(spark, sf_dir))
    hidden = g.nodes.where(F.col("function_name") == "raiseError")
    return G.hide_nodes(g, hidden).edges.select(*G.SRC, *G.DST)


@register(
    "export_visibility_nodes",
    with_ctes(EV)
    + """
select agent_id, function_name from span_events group by all
having contains(lower(function_name), 'view') and bool_or(has_error) = false
   and (case when strpos(function_name, '.') > 1 then split_part(function_name, '.', 1)
             when regexp_matches(function_name, '^(handle|process)[A-Z]') then 'Handlers' else 'Other' end)
       = 'UiService'""",
)
def q_export_visibility_nodes(spark, sf_dir):
    g = G.export_graph(events(spark, sf_dir))
    v = G.export_visibility(g, search="VIEW", node_filter="all", service="UiService")
    return v.nodes.select("agent_id", "function_name")


@register(
    "export_visibility_edges",
    with_ctes(EV)
    + """,
n as (select agent_id, function_name, bool_or(has_error) as e from span_events group by all),
k as (select agent_id, function_name from n where e and contains(lower(function_name), 'error'))
select distinct p.agent_id as src_agent_id, p.function_name as src_function_name,
       c.agent_id as dst_agent_id, c.function_name as dst_function_name
from span_events c join span_events p on c.parent_span_id = p.span_id
where (p.agent_id, p.function_name) in (select * from k) and (c.agent_id, c.function_name) in (select * from k)""",
)
def q_export_visibility_edges(spark, sf_dir):
    g = G.export_graph(events(spark, sf_dir))
    return G.export_visibility(g, search="Error", node_filter="errors").edges.select(*G.SRC, *G.DST)


@register(
    "mark_nodes",
    with_ctes(EV)
    + """
select agent_id, function_name, contains(lower(function_name), 'order') as marked from span_events group by all""",
)
def q_mark_nodes(spark, sf_dir):
    return G.mark_nodes(G.call_graph_nodes(events(spark, sf_dir)), "Order").select("agent_id", "function_name", "marked")


@register(
    "edge_weights",
    with_ctes(EV, _LIVE_EDGES_SQL)
    + f""",
ge as (select src_agent_id, src_function_name, dst_agent_id, dst_function_name, count(*) as call_count from links
      where not (src_agent_id = dst_agent_id and src_function_name = dst_function_name) group by all)
select *, {sql_r6('1 + call_count / greatest(max(call_count) over (), 1) * 4')} as weight from ge""",
)
def q_edge_weights(spark, sf_dir):
    e = G.edge_weights(G.call_graph_edges(events(spark, sf_dir)))
    return e.select(*G.SRC, *G.DST, "call_count", r6("weight").alias("weight"))


@register(
    "neighbours",
    with_ctes(EV, _LIVE_EDGES_SQL)
    + """,
ge as (select src_agent_id, src_function_name, dst_agent_id, dst_function_name, count(*) as call_count from links
      where not (src_agent_id = dst_agent_id and src_function_name = dst_function_name) group by all)
select 'caller' as direction, src_agent_id as agent_id, src_function_name as function_name, call_count from ge
where dst_agent_id = 'svc-0' and dst_function_name = 'raiseError'
union all
select 'callee', dst_agent_id, dst_function_name, call_count from ge
where src_agent_id = 'svc-0' and src_function_name = 'raiseError'""",
)
def q_neighbours(spark, sf_dir):
    n = G.neighbours(G.call_graph_edges(events(spark, sf_dir)), "svc-0", "raiseError")
    return n.select("direction", "agent_id", "function_name", "call_count")


@register(
    "graph_health",
    _SLOW_NODES_SQL
    + """
select sum(call_count) as total_calls, count(*) as functions,
       floor(sum(avg_ms * call_count) / sum(call_count) + 0.5) as avg_latency_ms,
       count(*) filter (where has_error) as error_nodes, count(*) filter (where has_anomaly) as anomaly_nodes,
       count(*) filter (where is_slow) as slow_nodes
from nodes""",
)
def q_graph_health(spark, sf_dir):
    return G.graph_health(G.call_graph_nodes(flag_anomalies(events(spark, sf_dir))))


@register(
    "replay_frames",
    with_ctes(EV, EV_FLAGGED)
    + """,
b as (select max(received_at) as mx, max(received_at) - 3600000 as seek from span_events),
fr as (select i as frame, case when b.seek + i * 10000 < b.mx then b.seek + i * 10000 end as frame_ts
       from b, range(0, cast(greatest(ceil((b.mx - b.seek) / 10000.0), 0) as bigint) + 1) r(i)),
n as (select fr.frame, fr.frame_ts, f.agent_id, f.function_name, count(*) as call_count,
             """ + sql_rounded_mean("f.duration_ms", 6) + """ as avg6, avg(f.duration_ms) as a,
             bool_or(f.anomaly) as has_anomaly, bool_or(f.has_error) as has_error
      from fr join flagged f on fr.frame_ts is null or f.received_at <= fr.frame_ts
      group by all),
r as (select *, row_number() over (partition by frame order by a, agent_id, function_name) as rn,
             count(*) over (partition by frame) as nn from n),
t as (select *, max(case when rn = least(floor(0.95::double * nn), nn - 1) + 1 then a end)
                  over (partition by frame) as thr from r)
select frame, frame_ts, agent_id, function_name, call_count, avg6 as avg_duration_ms, has_anomaly, has_error,
       (nn >= 5 and a >= thr) as is_slow
from t""",
)
def q_replay_frames(spark, sf_dir):
    f = G.replay_frames(flag_anomalies(events(spark, sf_dir)), speed=10, lookback_ms=3_600_000)
    f = with_rounded_mean(f, "total_duration_ms", "call_count", 6, "avg6")
    return f.select("frame", "frame_ts", "agent_id", "function_name", "call_count",
                    F.col("avg6").alias("avg_duration_ms"), "has_anomaly", "has_error", "is_slow")


@register(
    "collapse_by_file_nodes",
    with_ctes(EV, EV_FLAGGED, _LIVE_NODES_SQL)
    + f""",
g as (
  select n.*, 'group:file:' || n.file as group_id,
         row_number() over (partition by n.file order by avg_ms, n.agent_id, n.function_name) as grn,
         count(*) over (partition by n.file) as gk,
         first_value(n.agent_id) over (partition by n.file order by fr, fs, n.agent_id, n.function_name) as first_agent
  from (select slow.*, f.fr, f.fs from slow join (
          select agent_id, function_name, min(struct_pack(r := received_at, q := ingest_seq)).r as fr,
                 min(struct_pack(r := received_at, q := ingest_seq)).q as fs
          from flagged group by all) f using (agent_id, function_name)) n)
select group_id, concat(split_part(file, '/', -1), ' (', count(*), case when count(*) <> 1 then ' fns)' else ' fn)' end)
         as function_name,
       min(first_agent) as agent_id, file, sum(call_count) as call_count,
       {sql_r6('avg(avg_ms)')} as avg_duration_ms,
       bool_or(has_anomaly) as has_anomaly, bool_or(has_error) as has_error,
       bool_or(nn >= 5 and avg_ms >= thr) as is_slow
from g group by group_id, file""",
)
def q_collapse_by_file_nodes(spark, sf_dir):
    s = flag_anomalies(events(spark, sf_dir))
    g = G.collapse(G.call_graph(s), "file")
    return g.nodes.select("group_id", "function_name", "agent_id", "file", "call_count",
                          r6("avg_duration_ms").alias("avg_duration_ms"), "has_anomaly", "has_error", "is_slow")
