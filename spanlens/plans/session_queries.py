"""Registered session queries (W3-W5, W7, A14, A15, D1, D2, U1-U5, O9, P12, P13, S8 list).

Two recordings are cut from ``span_events`` at CUT_TS: ``before`` (received up to the cut) and ``after``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from spanlens.operators import sessions as SS
from spanlens.operators.filters import filter_calls
from spanlens.functions.stats import sql_rounded_mean
from spanlens.session import checkpoint_dir
from spanlens.sources import spans_io as IO
from spanlens.plans.registry import EV, events, r6, register, sql_r6, with_ctes

CUT_TS = 1705276800000

_CALLS_SQL = f"""
rec as (
  select case when received_at <= {CUT_TS} then 'before' else 'after' end as session, *
  from span_events),
calls as (
  select session, function_name as function, span_id, duration_ms,
         case when has_error then error_type end as error_type, output_json as return_json, input_json as args_json,
         row_number() over (partition by session order by started_at, received_at, ingest_seq) as sequence
  from rec)
"""


def _recordings(spark, sf_dir):
    s = events(spark, sf_dir)
    b_calls, b_meta = SS.record_session(s.where(F.col("received_at") <= CUT_TS), "before")
    a_calls, a_meta = SS.record_session(s.where(F.col("received_at") > CUT_TS), "after")
    return b_calls.unionByName(a_calls), b_meta.unionByName(a_meta)


@register("record_session", with_ctes(EV, _CALLS_SQL) + "\nselect session, sequence, function, span_id from calls")
def q_record_session(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    return calls.select("session", "sequence", "function", "span_id")


@register("session_documents", with_ctes(EV, _CALLS_SQL) + """
select session, sequence, function, span_id, duration_ms, error_type, json_extract(args_json, '$.k')::varchar as k from calls""")
def q_session_documents(spark, sf_dir):
    """Both recordings written as documents and read back."""
    root = os.path.join(checkpoint_dir(spark), "spanlens-sessions-" + uuid.uuid4().hex[:8])
    IO.write_session_documents(*_recordings(spark, sf_dir), root)
    calls, _ = IO.read_session_documents(spark, root)
    return calls.select("session", "sequence", "function", "span_id", "duration_ms", "error_type", F.get_json_object("args_json", "$.k").alias("k"))


@register(
    "record_session_capped",
    with_ctes(EV)
    + """,
f as (select * from span_events where function_name in ('UiService.click', 'raiseError')),
capped as (select * from (select *, row_number() over (partition by function_name
                                 order by started_at, received_at, ingest_seq) as k from f) where k <= 50),
numbered as (select *, row_number() over (order by started_at, received_at, ingest_seq) as sequence from capped)
select sequence, function_name as function, span_id from numbered where duration_ms > 10""",
)
def q_record_session_capped(spark, sf_dir):
    calls, _ = SS.record_session(events(spark, sf_dir), "capped", functions=["UiService.click", "raiseError"],
                                 max_calls=50, predicate=F.col("duration_ms") > 10)
    return calls.select("sequence", "function", "span_id")


@register(
    "list_sessions",
    with_ctes(EV, _CALLS_SQL)
    + """,
m as (select session, min(started_at) as st, max(started_at + duration_ms) as en, count(*) as call_count
      from rec group by session)
select session, call_count, strftime(epoch_ms(st), '%Y-%m-%dT%H:%M:%S.%gZ') as start_time,
       strftime(epoch_ms(cast(floor(en) as bigint)), '%Y-%m-%dT%H:%M:%S.%gZ') as end_time
from m""",
)
def q_list_sessions(spark, sf_dir):
    calls, meta = _recordings(spark, sf_dir)
    return SS.list_sessions(calls, meta)


@register(
    "session_summary",
    with_ctes(EV, _CALLS_SQL)
    + f"""
select session, function, count(*) as calls, count(error_type) as errors,
       {sql_r6('avg(case when error_type is not null then 1.0 else 0.0 end)')} as error_rate,
       {sql_rounded_mean('duration_ms', 0)} as avg_ms
from calls group by all""",
)
def q_session_summary(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    s = SS.session_summary(calls)
    return s.select("session", "function", "calls", "errors", r6("error_rate").alias("error_rate"), "avg_ms")


_DIFF_SQL = """,
st as (
  select session, function, avg(case when error_type is not null then 1.0 else 0.0 end) as err,
         max(case when rk = greatest(ceil(0.95::double * n) - 1, 0) + 1 then duration_ms end) as p95
  from (select *, row_number() over (partition by session, function order by duration_ms) as rk,
               count(*) over (partition by session, function) as n from calls)
  group by all),
b as (select * from st where session = 'before'),
a as (select * from st where session = 'after'),
d as (
  select 'added' as kind, a.function, null::double as before_value, null::double as after_value,
         null::double as change_pct
  from a where a.function not in (select function from b)
  union all
  select 'removed', b.function, null, null, null from b where b.function not in (select function from a)
  union all
  select 'error_rate', b.function, b.err, a.err, null from b join a using (function) where abs(b.err - a.err) > 0.001
  union all
  select 'latency', b.function, b.p95, a.p95, floor((a.p95 - b.p95) / b.p95 * 100 * 10.0 + 0.5) / 10.0
  from b join a using (function) where b.p95 > 0 and (a.p95 - b.p95) / b.p95 * 100 > 0)
"""


@register(
    "diff_sessions",
    with_ctes(EV, _CALLS_SQL) + _DIFF_SQL
    + f"""
select kind, function, {sql_r6('before_value')} as before_value, {sql_r6('after_value')} as after_value, change_pct
from d""",
)
def q_diff_sessions(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    d = SS.diff_sessions(calls.where(F.col("session") == "before"), calls.where(F.col("session") == "after"))
    return d.select("kind", "function", r6("before_value").alias("before_value"),
                    r6("after_value").alias("after_value"), "change_pct")


@register(
    "is_breaking",
    with_ctes(EV, _CALLS_SQL) + _DIFF_SQL
    + "\nselect coalesce(bool_or(kind = 'removed' or (kind = 'latency' and change_pct >= 20)), false) as breaking from d",
)
def q_is_breaking(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    d = SS.diff_sessions(calls.where(F.col("session") == "before"), calls.where(F.col("session") == "after"))
    return SS.is_breaking(d, 20.0)


@register(
    "merge_sessions",
    with_ctes(EV, _CALLS_SQL)
    + """
select 'merged' as session, span_id,
       row_number() over (order by sequence, case session when 'after' then 0 else 1 end) as sequence
from calls""",
)
def q_merge_sessions(spark, sf_dir):
    calls, meta = _recordings(spark, sf_dir)
    merged, _ = SS.merge_sessions(calls, meta, ["after", "before"], "merged")
    return merged.select("session", "span_id", "sequence")


@register(
    "session_timeline",
    with_ctes(EV, _CALLS_SQL)
    + f""",
p as (select session, count(*) as n, max(duration_ms) as mx from calls group by session)
select c.session, c.sequence, {sql_r6('(c.sequence - 1) / p.n * 100')} as left_pct,
       {sql_r6('greatest(c.duration_ms / greatest(p.mx, 1) * 30, 0.5)')} as width_pct
from calls c join p using (session)""",
)
def q_session_timeline(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    t = SS.session_timeline(calls)
    return t.select("session", "sequence", r6("left_pct").alias("left_pct"), r6("width_pct").alias("width_pct"))


@register(
    "session_examples",
    with_ctes(EV, _CALLS_SQL)
    + f""",
r as (select *, row_number() over (partition by session, function, error_type is null order by sequence) as k,
             row_number() over (partition by session, function order by sequence) as ka from calls)
select session, function, count(*) as call_count, {sql_rounded_mean('duration_ms', 0)} as avg_ms,
       coalesce(list(return_json order by sequence) filter (where error_type is null and k <= 3), []) as success_returns,
       coalesce(list(error_type order by sequence) filter (where error_type is not null and k <= 2), []) as error_types,
       list(args_json order by sequence) filter (where ka <= 3) as first_args
from r group by all""",
)
def q_session_examples(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    e = SS.session_examples(calls)
    return e.select("session", "function", "call_count", "avg_ms",
                    F.coalesce("success_returns", F.array().cast("array<string>")).alias("success_returns"),
                    F.coalesce("error_types", F.array().cast("array<string>")).alias("error_types"),
                    "first_args")


@register(
    "filter_calls_errors",
    with_ctes(EV, _CALLS_SQL)
    + "\nselect session, sequence from calls where error_type is not null and contains(lower(function), 'error')",
)
def q_filter_calls_errors(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    return filter_calls(calls, function="ERROR", status="errors").select("session", "sequence")


@register(
    "session_edits",
    with_ctes(EV, _CALLS_SQL)
    + """
select 'copy' as session, count(*) as n from calls where session = 'before'
union all select 'later', count(*) from calls where session = 'after'""",
)
def q_session_edits(spark, sf_dir):
    calls, _ = _recordings(spark, sf_dir)
    c = SS.clone_session(calls, "before", "copy")
    c = SS.rename_session(c, "after", "later")
    c = SS.delete_session(c, "before")
    return c.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


_SHAPES_SQL = """,
kv as (
  select session, function, 'obj' as slot, json_extract(return_json, '$.k')::varchar as v, sequence
  from calls where error_type is null and json_type(return_json) = 'OBJECT'
  union all
  select session, function, 'num', return_json, sequence
  from calls where error_type is null and json_type(return_json) in ('UBIGINT', 'BIGINT', 'DOUBLE')),
vf as (select session, function, slot, v, min(sequence) as f from kv group by all),
vals as (
  select session, function, slot,
         case when count(*) <= 10 then '{"enum":[' || string_agg(v, ',' order by f, v) || ']}'
              else '{"type":"number"}' end as vs
  from vf group by all),
br as (
  select v.session, v.function,
         case when v.slot = 'obj' then '{"type":"object","properties":{"k":' || v.vs || '},"required":["k"]}'
              else v.vs end as schema,
         (select min(sequence) from kv where kv.session = v.session and kv.function = v.function
                                         and kv.slot = v.slot) as first_seq
  from vals v),
shape as (
  select session, function,
         case when count(*) = 1 then min(schema)
              else '{"oneOf":[' || string_agg(schema, ',' order by first_seq) || ']}' end as shape
  from br group by all),
changed as (
  select b.function, b.shape as before_shape, a.shape as after_shape
  from shape b join shape a on a.function = b.function and b.session = 'before' and a.session = 'after'
  where b.shape <> a.shape),
dd as (select kind, function, change_pct from d
       union all select 'return_shape', function, null from changed)
"""


@register(
    "session_shape_changes",
    with_ctes(EV, _CALLS_SQL) + _DIFF_SQL + _SHAPES_SQL
    + "select dd.kind, dd.function, dd.change_pct, c.before_shape, c.after_shape "
      "from dd left join changed c using (function)",
)
def q_session_shape_changes(spark, sf_dir):
    """D1 return shapes, then the full diff including them."""
    calls, _ = _recordings(spark, sf_dir)
    b, a = calls.where(F.col("session") == "before"), calls.where(F.col("session") == "after")
    shapes = SS.shape_changes(b, a)
    d = SS.diff_sessions(b, a, shapes=shapes)
    return d.select("kind", "function", "change_pct").join(
        shapes.select("function", "before_shape", "after_shape"), "function", "left")
