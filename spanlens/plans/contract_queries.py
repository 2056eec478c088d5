"""Registered contract queries.

``span_events`` carries one argument object per span (``props``); the queries pass it as the argument list
``[props]``. ``strict`` contracts (dominant type) against default contracts (``oneOf``) give drift and violations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.operators import contracts as C
from spanlens.plans.registry import EV, events, register, with_ctes


def call_spans(spark, sf_dir):
    s = events(spark, sf_dir)
    return s.withColumn("input_json", F.concat(F.lit("["), F.col("input_json"), F.lit("]")))


@register(
    "value_profile",
    with_ctes(EV)
    + """
select function_name, 'args[0]' as slot, '' as path, 'object' as js_type, count(*) as n, null::bigint as n_distinct
from span_events group by all
union all
select function_name, 'args[0]', '.k', 'number', count(*), count(distinct json_extract(input_json, '$.k')::varchar)
from span_events group by all
union all
select function_name, 'return', '', output_type, count(*),
       case when output_type = 'number' then count(distinct output_json) end
from span_events where not has_error group by function_name, output_type
union all
select function_name, 'return', '.k', 'number', count(*), count(distinct json_extract(output_json, '$.k')::varchar)
from span_events where not has_error and output_type = 'object' group by all""",
)
def q_value_profile(spark, sf_dir):
    p = C.value_profile(call_spans(spark, sf_dir))
    return p.select("function_name", "slot", F.array_join("path", "").alias("path"), "js_type", "n", "n_distinct")


_CONTRACT_SQL = """,
s as (select * from span_events where function_name in
        (select function_name from span_events group by all having count(*) >= 5)),
-- one row per (function, slot, value): first arrival of each distinct JSON value
kv as (
  select function_name, 'arg' as slot, json_extract(input_json, '$.k')::varchar as v, received_at, ingest_seq from s
  union all
  select function_name, 'ret_k', json_extract(output_json, '$.k')::varchar, received_at, ingest_seq
  from s where not has_error and output_type = 'object'
  union all
  select function_name, 'ret_num', output_json, received_at, ingest_seq
  from s where not has_error and output_type = 'number'),
firsts as (select * from (select *, row_number() over (partition by function_name, slot, v
                                                       order by received_at, ingest_seq) as k from kv) where k = 1),
vals as (
  select function_name, slot,
         case when count(*) <= 10 then '{"enum":[' || string_agg(v, ',' order by received_at, ingest_seq, v) || ']}'
              else '{"type":"number"}' end as schema
  from firsts group by all),
obj as (select v.function_name, v.slot,
               '{"type":"object","properties":{"k":' || v.schema || '},"required":["k"]}' as schema
        from vals v where v.slot in ('arg', 'ret_k')),
branches as (
  select o.function_name, o.schema,
         (select arg_min(struct_pack(r := received_at, q := ingest_seq), struct_pack(r := received_at, q := ingest_seq))
          from s where s.function_name = o.function_name and not has_error and output_type = 'object') as f
  from obj o where o.slot = 'ret_k'
  union all
  select v.function_name, v.schema,
         (select arg_min(struct_pack(r := received_at, q := ingest_seq), struct_pack(r := received_at, q := ingest_seq))
          from s where s.function_name = v.function_name and not has_error and output_type = 'number')
  from vals v where v.slot = 'ret_num'),
rets as (select function_name,
                case when count(*) = 1 then min(schema)
                     else '{"oneOf":[' || string_agg(schema, ',' order by f.r, f.q) || ']}' end as returns
         from branches group by all),
errs as (
  select function_name, list('{"type":"object","properties":{"type":{"enum":["' || error_type
                              || '"]},"message":{"type":"string"}},"required":["type","message"]}'
                              order by f.r, f.q) as errors
  from (select function_name, error_type, min(struct_pack(r := received_at, q := ingest_seq)) as f
        from s where has_error group by all)
  group by all)
select c.function_name, c.sample_count, [a.schema] as args, coalesce(r.returns, '{}') as returns, e.errors
from (select function_name, count(*) as sample_count from s group by all) c
join obj a on a.function_name = c.function_name and a.slot = 'arg'
left join rets r on r.function_name = c.function_name
left join errs e on e.function_name = c.function_name
"""


@register("infer_contracts", with_ctes(EV) + _CONTRACT_SQL)
def q_infer_contracts(spark, sf_dir):
    """Contract documents; the SQL twin assembles the same texts for the fixture's flat payloads."""
    c = C.infer_contracts(call_spans(spark, sf_dir))
    return c.select("function_name", "sample_count", "args", "returns", "errors")


@register(
    "contract_counts",
    with_ctes(EV)
    + """
select function_name, count(*) as sample_count, count(distinct error_type) as error_schemas
from span_events group by all having count(*) >= 5""",
)
def q_contract_counts(spark, sf_dir):
    c = C.infer_contracts(call_spans(spark, sf_dir))
    return c.select("function_name", "sample_count", F.when(F.col("errors").isNull(), F.lit(0)).otherwise(F.size("errors")).cast("long")
                    .alias("error_schemas"))


@register(
    "contract_confidence",
    with_ctes(EV)
    + """,
t as (select function_name, count(*) as n,
             case when count(distinct output_type) filter (where not has_error) > 1 then 1 else 0 end as oneof_count
      from span_events group by all),
sc as (select *, cast(floor(least(100, least(n / 50.0, 1) * 50 + greatest(0, 30 - oneof_count * 5.0)) + 0.5)
                      as integer) as confidence from t)
select function_name, n as sample_count, oneof_count, confidence,
       case when confidence >= 80 then 'high' when confidence >= 50 then 'medium' else 'low' end as band,
       n < 10 as below_gate
from sc""",
)
def q_contract_confidence(spark, sf_dir):
    c = C.contract_confidence(C.infer_contracts(call_spans(spark, sf_dir)))
    return c.select("function_name", "sample_count", F.col("oneof_count").cast("long").alias("oneof_count"),
                    "confidence", "band", "below_gate")


@register(
    "contract_drift_strict",
    with_ctes(EV)
    + """,
t as (select function_name, count(distinct output_type) filter (where not has_error) as k,
             count(*) filter (where not has_error and output_type = 'object') as o,
             count(*) filter (where not has_error and output_type = 'number') as m
      from span_events group by all)
select function_name, 'returns' as path, 'type_changed' as kind from t where k > 1 and o >= m
union all select function_name, 'returns.k', 'field_removed' from t where k > 1 and o >= m
union all select function_name, 'returns.k', 'required_removed' from t where k > 1 and o >= m""",
)
def q_contract_drift_strict(spark, sf_dir):
    s = call_spans(spark, sf_dir)
    saved = C.infer_contracts(s, strict=True)
    cur = C.infer_contracts(s)
    return C.contract_drift(saved, cur).select("function_name", "path", "kind")


@register(
    "contract_drift_breaking",
    with_ctes(EV)
    + """,
t as (select function_name, count(distinct output_type) filter (where not has_error) as k,
             count(*) filter (where not has_error and output_type = 'object') as o,
             count(*) filter (where not has_error and output_type = 'number') as m
      from span_events group by all)
select function_name, cast(3 as bigint) as change_count, true as is_breaking from t where k > 1 and o >= m""",
)
def q_contract_drift_breaking(spark, sf_dir):
    s = call_spans(spark, sf_dir)
    return C.drift_breaking(C.contract_drift(C.infer_contracts(s, strict=True), C.infer_contracts(s)))


@register(
    "validate_calls",
    with_ctes(EV)
    + """,
t as (select function_name,
             count(*) filter (where not has_error and output_type = 'object') as o,
             count(*) filter (where not has_error and output_type = 'number') as m
      from span_events group by all)
select s.function_name, s.span_id, cast(1 as integer) as violation_count, 'return' as first_path, 'type' as first_rule
from span_events s join t using (function_name)
where not s.has_error and s.output_type = 'number' and t.o >= t.m""",
)
def q_validate_calls(spark, sf_dir):
    s = call_spans(spark, sf_dir)
    v = C.validate_calls(s, C.infer_contracts(s, strict=True))
    return v.select("function_name", "span_id", F.size("violations").alias("violation_count"),
                    F.col("violations")[0]["path"].alias("first_path"),
                    F.col("violations")[0]["rule"].alias("first_rule"))


@register(
    "contract_ddl",
    with_ctes(EV)
    + """,
t as (select function_name, count(*) as n,
             count(*) filter (where not has_error and output_type = 'object') as o,
             count(*) filter (where not has_error and output_type = 'number') as m
      from span_events group by all having count(*) >= 5)
select function_name, 0 as arg_index, 'struct<`k`:double>' as arg_ddl,
       case when o + m = 0 then 'string' when o >= m then 'struct<`k`:double>' else 'double' end as returns_ddl
from t""",
)
def q_contract_ddl(spark, sf_dir):
    """Spark DDL of every argument and return schema of the strict contracts."""
    return C.contract_to_ddl(C.infer_contracts(call_spans(spark, sf_dir), strict=True))


@register(
    "contract_index",
    with_ctes(EV)
    + """
select function_name, count(*) as sample_count, count(*) < 2000 as below_gate
from span_events group by all having count(*) >= 5""",
)
def q_contract_index(spark, sf_dir):
    """O10 with a coverage gate of 2000 samples."""
    return C.contract_index(C.infer_contracts(call_spans(spark, sf_dir)), gate=2000)


# ---------------------------------------------------------------- rich payloads

_CUSTOMER_CONTRACT = (
    '{"type":"object","required":["id","phone","seg"],"properties":{"id":{"oneOf":[{"type":"number"},{"type":"object","required":["key"],'
    '"properties":{"key":{"type":"string"}}}]},"mail":{"type":"string","format":"email"},"phone":{"type":"string","pattern":"^[0-9]{2}-"},'
    '"seg":{"enum":["BUILDING","MACHINERY","AUTOMOBILE"]},"tags":{"type":"array","items":{"type":"string"}}}}', '{"type":"number"}')


def customer_spans(spark, sf_dir):
    """A call per customer whose argument breaks every rule of ``_CUSTOMER_CONTRACT`` in some rows."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    c = c.repartition(spark.sparkContext.defaultParallelism)  # a small file is a large check: one task else
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    case = lambda m, *parts: F.element_at(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts)), (k % m + 1).cast("int"))
    number = F.concat(F.lit('"id":'), text)
    ident = case(5, F.concat(F.lit('"id":{"key":"'), text, F.lit('"}')), F.concat(F.lit('"id":{"key":'), text, F.lit("}")), F.concat(F.lit('"id":"'), text, F.lit('"')), number, number)
    mail = case(4, F.concat(F.lit('"mail":"c'), text, F.lit('@x.io",')), F.concat(F.lit('"mail":"c'), text, F.lit('",')), "", F.concat(F.lit('"mail":'), text, F.lit(",")))
    phone = F.concat(F.lit('"phone":"'), (F.col("c_nationkey") + 10).cast("string"), F.lit('-555",'))
    phone = case(6, '"phone":"none",', "", phone, phone, phone, phone)
    tags = case(3, '"tags":["a","b"],', F.concat(F.lit('"tags":["a",'), text, F.lit(',"b",null],')), "")
    return c.select(
        F.concat(F.lit("u"), text).alias("span_id"), F.lit("t").alias("trace_id"), F.lit("crm").alias("agent_id"), F.lit("Customer.sync").alias("function_name"),
        F.concat(F.lit("[{"), mail, phone, tags, F.lit('"seg":"'), F.col("c_mktsegment"), F.lit('",'), ident, F.lit("}]")).alias("input_json"),
        F.when(k % 10 == 0, F.lit('"x"')).otherwise(text).alias("output_json"), (k % 20 == 0).alias("has_error"),
        F.lit(1.0).alias("started_at"), F.lit(1.0).alias("duration_ms"), k.alias("received_at"), k.alias("ingest_seq"))


@register("validate_rich_calls", """
with c as (select c_custkey as k, 'u' || c_custkey as span_id, c_mktsegment as seg from customer)
select span_id, 'args[0].phone' as path, 'present' as expected, 'missing' as received, 'required' as rule from c where k % 6 = 1
union all select span_id, 'args[0].id', 'one of 2 schemas', case when k % 5 = 1 then 'object' else 'string' end, 'type' from c where k % 5 in (1, 2)
union all select span_id, 'args[0].mail', 'string(format: email)', 'c' || k, 'format' from c where k % 4 = 1
union all select span_id, 'args[0].mail', 'string', 'number', 'type' from c where k % 4 = 3
union all select span_id, 'args[0].phone', 'string matching /^[0-9]{2}-/', 'none', 'pattern' from c where k % 6 = 0
union all select span_id, 'args[0].seg', 'one of ["BUILDING","MACHINERY","AUTOMOBILE"]', '"' || seg || '"', 'enum' from c
          where seg not in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
union all select span_id, 'args[0].tags[' || i || ']', 'string', case i when 1 then 'number' else 'null' end, 'type' from c, (values (1), (3)) t(i) where k % 3 = 1
union all select span_id, 'return', 'number', 'string', 'type' from c where k % 10 = 0 and k % 20 != 0""")
def q_validate_rich_calls(spark, sf_dir):
    """Enum, oneOf, type, format, pattern, required and items, a row a violation."""
    args, returns = _CUSTOMER_CONTRACT
    contract = spark.createDataFrame([("Customer.sync", [args], returns)], "function_name string, args array<string>, returns string")
    return C.violation_details(C.validate_calls(customer_spans(spark, sf_dir), contract)).select("span_id", "path", "expected", "received", "rule")


def order_spans(spark, sf_dir):
    """A call per order: dates, free text, an optional field, a nested object, an array of two types, a flag; returns text or null."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    arg = F.concat(
        F.lit('[{"at":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","lines":['), text, F.lit(',"'), F.col("o_orderpriority"), F.lit('"],"ok":'),
        F.when(k % 2 == 0, "true").otherwise("false"), F.when(k % 3 == 0, F.concat(F.lit(',"note":"n'), text, F.lit('"'))).otherwise(""),
        F.lit(',"who":{"cust":'), F.col("o_custkey").cast("string"), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"},"none":[]}]'))
    return o.select(
        F.concat(F.lit("o"), text).alias("span_id"), F.lit("t").alias("trace_id"), F.lit("shop").alias("agent_id"), F.lit("Order.place").alias("function_name"),
        arg.alias("input_json"), F.when(k % 4 == 0, "null").otherwise(F.concat(F.lit('"r'), text, F.lit('"'))).alias("output_json"), F.lit(False).alias("has_error"),
        F.lit(1.0).alias("started_at"), F.lit(1.0).alias("duration_ms"), k.alias("received_at"), k.alias("ingest_seq"))


_RICH_SQL = """
with first as (
  select (select '[' || string_agg('"' || v || '"', ',' order by f) || ']' from (select o_orderpriority as v, min(o_orderkey) as f from orders group by all)) as prio,
         (select '[' || string_agg('"' || v || '"', ',' order by f) || ']' from (select o_orderstatus as v, min(o_orderkey) as f from orders group by all)) as status,
         (select '[' || string_agg(v, ',' order by f) || ']' from (select case when o_orderkey % 2 = 0 then 'true' else 'false' end as v, min(o_orderkey) as f
                                                                    from orders group by all)) as ok,
         (select count(*) from orders) as n, (select min(o_orderkey) % 4 = 0 from orders) as null_first)
"""


@register("infer_rich_contracts", _RICH_SQL + """
select 'Order.place' as function_name, n as sample_count,
       '{"type":"object","properties":{"at":{"type":"string","format":"date-time"},"lines":{"type":"array","items":{"oneOf":[{"type":"number"},{"enum":' || prio
       || '}]}},"none":{"type":"array"},"note":{"type":"string"},"ok":{"enum":' || ok || '},"who":{"type":"object","properties":{"cust":{"type":"number"},"status":{"enum":'
       || status || '}},"required":["cust","status"]}},"required":["at","lines","none","ok","who"]}' as arg,
       case when null_first then '{"oneOf":[{"type":"null"},{"type":"string"}]}' else '{"oneOf":[{"type":"string"},{"type":"null"}]}' end as returns
from first""")
def q_infer_rich_contracts(spark, sf_dir):
    """C1-C8 on strings, a format, an optional field, nested objects, an array of two types, an empty array, flags and a union."""
    c = C.infer_contracts(order_spans(spark, sf_dir))
    return c.select("function_name", "sample_count", F.col("args")[0].alias("arg"), "returns")
