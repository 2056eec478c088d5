"""Registered tree, flame, chain and critical-path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.operators import graph as G
from spanlens.operators import tree as TR
from spanlens.operators.critical_path import critical_path
from spanlens.plans.registry import EV, ORD, TURNS, events, orders, r6, register, sql_r6, turns

_TREE_SQL = """
t(trace_id, span_id, root_id, depth) as (
  select s.trace_id, s.span_id, s.span_id, 0 from {v} s
  where s.parent_span_id is null
     or not exists (select 1 from {v} p where p.span_id = s.parent_span_id and p.trace_id = s.trace_id)
  union all
  select c.trace_id, c.span_id, t.root_id, t.depth + 1
  from {v} c join t on c.parent_span_id = t.span_id and c.trace_id = t.trace_id)
"""


@register(
    "span_tree_depths",
    "with recursive " + EV.strip() + ",\n" + _TREE_SQL.format(v="span_events").strip()
    + "\nselect depth, count(*) as spans from t group by depth",
)
def q_span_tree_depths(spark, sf_dir):
    t = TR.span_tree(events(spark, sf_dir))
    return t.groupBy("depth").agg(F.count(F.lit(1)).alias("spans"))


@register(
    "span_tree",
    "with recursive " + EV.strip() + ",\n" + _TREE_SQL.format(v="span_events").strip()
    + "\nselect trace_id, span_id, root_id, depth from t",
)
def q_span_tree(spark, sf_dir):
    return TR.span_tree(events(spark, sf_dir)).select("trace_id", "span_id", "root_id", "depth")


@register(
    "span_tree_orders_depths",
    "with recursive " + ORD.strip() + ",\n" + _TREE_SQL.format(v="span_orders").strip()
    + "\nselect depth, count(*) as spans, count(distinct root_id) as roots from t group by depth",
)
def q_span_tree_orders_depths(spark, sf_dir):
    t = TR.span_tree(orders(spark, sf_dir))
    return t.groupBy("depth").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("root_id").alias("roots"))


@register(
    "chain_depths_turns",
    "with recursive " + TURNS.strip() + ",\n" + _TREE_SQL.format(v="span_turns").strip()
    + "\nselect root_id, max(depth) + 1 as chain_depth, count(*) as tree_spans from t group by root_id",
)
def q_chain_depths_turns(spark, sf_dir):
    t = TR.span_tree(turns(spark, sf_dir))
    return TR.tree_depths(t).select("root_id", "chain_depth", "tree_spans")


@register(
    "call_chains",
    "with recursive " + EV.strip() + ",\n"
    + """
t(span_id, root_id, depth) as (
  select s.span_id, s.span_id, 0 from span_events s
  where s.parent_span_id is null or not exists (select 1 from span_events p where p.span_id = s.parent_span_id)
  union all
  select c.span_id, t.root_id, t.depth + 1 from span_events c join t on c.parent_span_id = t.span_id),
d as (select root_id, max(depth) + 1 as chain_depth, count(*) as tree_spans,
             count(*) filter (where depth = 1) as kids from t group by root_id)
select d.root_id, s.function_name, s.duration_ms, d.chain_depth, d.tree_spans
from d join span_events s on s.span_id = d.root_id
where kids > 0
order by chain_depth desc, duration_ms desc, received_at, ingest_seq limit 8""",
)
def q_call_chains(spark, sf_dir):
    return TR.call_chains(events(spark, sf_dir), k=8)


@register(
    "flame",
    "with recursive " + EV.strip() + ",\n" + _TREE_SQL.format(v="span_events").strip()
    + f""",
b as (select trace_id, min(started_at) as st, max(started_at + duration_ms) - min(started_at) as total
      from span_events group by trace_id having max(started_at + duration_ms) - min(started_at) > 0),
dd as (select trace_id, span_id, max(depth) as depth from t group by all),
f as (select s.trace_id, s.span_id, coalesce(dd.depth, 0) as depth, b.st, b.total, s.started_at, s.duration_ms
      from span_events s join b using (trace_id) left join dd using (trace_id, span_id))
select trace_id, span_id, depth, max(depth) over (partition by trace_id) as max_depth,
       {sql_r6('greatest((started_at - st) / total, 0)')} as x_frac,
       {sql_r6('greatest(duration_ms / total, 0)')} as width_frac, {sql_r6('total')} as total_ms
from f""",
)
def q_flame(spark, sf_dir):
    f = TR.flame(events(spark, sf_dir))
    return f.select("trace_id", "span_id", "depth", "max_depth", r6("x_frac").alias("x_frac"),
                    r6("width_frac").alias("width_frac"), r6("total_ms").alias("total_ms"))


@register("span_tree_json")
def q_span_tree_json(spark, sf_dir):
    """T4 (rows only): nested tree documents, one per root."""
    return TR.span_tree_json(events(spark, sf_dir))


_CP_ORDERS_SQL = """
n as (select agent_id, function_name, avg(duration_ms) as a from span_orders group by all),
e as (select distinct p.agent_id as sa, p.function_name as sf, c.agent_id as da, c.function_name as df
      from span_orders c join span_orders p on c.parent_span_id = p.span_id
      where not (p.agent_id = c.agent_id and p.function_name = c.function_name)),
r as (select * from n where not exists (select 1 from e where e.da = n.agent_id and e.df = n.function_name)),
paths(agent_id, function_name, path, total) as (
  select agent_id, function_name, [struct_pack(agent_id := agent_id, function_name := function_name)], a from r
  union all
  select e.da, e.df, list_append(p.path, struct_pack(agent_id := e.da, function_name := e.df)), p.total + n.a
  from paths p join e on e.sa = p.agent_id and e.sf = p.function_name
  join n on n.agent_id = e.da and n.function_name = e.df),
best as (select path, total from paths order by total desc limit 1)
"""


@register(
    "critical_path_orders",
    "with recursive " + ORD.strip() + ",\n" + _CP_ORDERS_SQL.strip()
    + f"""
select cast(i - 1 as integer) as step, path[i].agent_id as agent_id, path[i].function_name as function_name,
       {sql_r6('total')} as total_ms
from best, range(1, len(path) + 1) r(i)""",
)
def q_critical_path_orders(spark, sf_dir):
    p = critical_path(G.path_graph(orders(spark, sf_dir)))
    return p.select(F.col("step").cast("int").alias("step"), "agent_id", "function_name",
                    r6("total_ms").alias("total_ms"))


@register("critical_path_events")
def q_critical_path_events(spark, sf_dir):
    """G2 on the cyclic events graph (rows only: the cycle rule has no plain SQL form)."""
    p = critical_path(G.path_graph(events(spark, sf_dir)))
    return p.select("step", "agent_id", "function_name", r6("dist_ms").alias("dist_ms"),
                    r6("total_ms").alias("total_ms"))
