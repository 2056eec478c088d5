"""Span views over the driver's tables (FIXTURES.md part B), in Spark and as DuckDB CTE text for oracles.

``span_events``: one trace per user and day from ``events``; the n-th event's parent is event floor(n/2).
``span_orders``: customer → order → line item, a three-level DAG with one trace per customer.
``span_turns``: conversations as traces, each turn's parent is the previous turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_ms(df: DataFrame, col: str) -> Column:
    """Epoch milliseconds (cut off, like ``unix_millis``) of a timestamp column, independent of the session zone
    for TIMESTAMP_NTZ."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`) div 1000")
    return F.floor(F.unix_micros(F.col(col)) / 1000).cast("long")


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    e = ev.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        epoch_ms(ev, "ts").alias("started_at"), day.alias("_day"),
    )
    e = e.withColumn("trace_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("_day")))
    w = Window.partitionBy("user_id", "_day").orderBy("ts", "event_id")
    e = e.withColumn("rn", F.row_number().over(w))
    p = e.select(F.col("trace_id").alias("_pt"), F.col("rn").alias("_prn"), F.col("event_id").alias("_pid"))
    c = e.join(
        p,
        (F.col("trace_id") == F.col("_pt")) & (F.col("rn") > 1) & (F.col("_prn") == F.floor(F.col("rn") / 2.0)),
        "left",
    )
    is_err = F.col("event_type") == "error"
    every97 = F.col("event_id") % 97 == 0
    fn = (
        F.when(F.col("event_type") == "click", "UiService.click")
        .when(F.col("event_type") == "view", "UiService.view")
        .when(F.col("event_type") == "purchase", "OrderService.purchase")
        .when(F.col("event_type") == "signup", "handleSignup")
        .otherwise("raiseError")
    )
    return c.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("span_id"),
        "trace_id",
        F.when(F.col("rn") == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("e"), F.col("_pid").cast("string"))).alias("parent_span_id"),
        F.concat(F.lit("svc-"), (F.col("event_id") % 3).cast("string")).alias("agent_id"),
        fn.alias("function_name"),
        F.concat(F.lit("src/"), F.col("event_type"), F.lit(".ts")).alias("file"),
        "started_at",
        F.col("value").alias("duration_ms"),
        (F.col("started_at") + F.ceil(F.col("value")).cast("long")).alias("received_at"),
        F.col("event_id").alias("ingest_seq"),
        F.col("props").alias("input_json"),
        F.when(is_err, F.lit("null")).when(every97, F.col("event_id").cast("string"))
        .otherwise(F.col("props")).alias("output_json"),
        F.when(is_err, F.lit("null")).when(every97, F.lit("number")).otherwise(F.lit("object")).alias("output_type"),
        is_err.alias("has_error"),
        F.when(is_err, F.when(F.col("event_id") % 2 == 0, "TimeoutError").otherwise("ValueError")).alias("error_type"),
    )


def span_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _table(spark, sf_dir, "customer")
    orders = _table(spark, sf_dir, "orders")
    li = _table(spark, sf_dir, "lineitem")
    nul = F.lit(None).cast("string")
    a = cust.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("span_id"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("trace_id"),
        nul.alias("parent_span_id"),
        F.concat(F.lit("crm-"), (F.col("c_nationkey") % 2).cast("string")).alias("agent_id"),
        F.concat(F.lit("CustomerService."), F.col("c_mktsegment")).alias("function_name"),
        (F.col("c_acctbal") + 1000).alias("duration_ms"),
    )
    b = orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        F.lit("orders"),
        F.concat(F.lit("OrderService."), F.col("o_orderpriority")),
        F.col("o_totalprice") / 1000,
    )
    lo = li.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = lo.select(
        F.concat_ws(
            "-",
            F.concat(F.lit("l"), F.col("l_orderkey").cast("string")),
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        ),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")),
        F.lit("shipping"),
        F.concat(F.lit("handle"), F.col("l_returnflag"), F.col("l_linestatus")),
        F.col("l_quantity"),
    )
    return a.unionAll(b).unionAll(c)


def span_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: span = turn, parent = previous turn of the same conversation (turns are gap-free)."""
    cv = _table(spark, sf_dir, "conversations")
    sid = F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return cv.select(
        sid.alias("span_id"),
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("trace_id"),
        F.when(F.col("turn") == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string")))
        .alias("parent_span_id"),
        F.lit("chat").alias("agent_id"),
        F.concat(F.lit("Chat."), F.col("role")).alias("function_name"),
        F.length("text").cast("double").alias("duration_ms"),
        F.col("turn").alias("ingest_seq"),
        F.col("turn").alias("received_at"),
    )


# --- DuckDB text of the same views (oracle side). Each oracle query inlines one of these as a CTE. ---

SPAN_EVENTS_CTE = """
e as (
  select *, epoch_us(ts) // 1000 as started_at,
         row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as rn,
         concat('u', user_id, '-', strftime(ts,'%Y-%m-%d')) as trace_id
  from events),
span_events as (
  select concat('e', c.event_id) as span_id, c.trace_id,
         case when c.rn = 1 then null else concat('e', p.event_id) end as parent_span_id,
         concat('svc-', c.event_id % 3) as agent_id,
         case c.event_type when 'click' then 'UiService.click' when 'view' then 'UiService.view'
              when 'purchase' then 'OrderService.purchase' when 'signup' then 'handleSignup'
              else 'raiseError' end as function_name,
         concat('src/', c.event_type, '.ts') as file,
         c.started_at, c.value as duration_ms,
         c.started_at + cast(ceil(c.value) as bigint) as received_at, c.event_id as ingest_seq,
         c.props as input_json,
         case when c.event_type = 'error' then 'null'
              when c.event_id % 97 = 0 then cast(c.event_id as varchar(20)) else c.props end as output_json,
         case when c.event_type = 'error' then 'null'
              when c.event_id % 97 = 0 then 'number' else 'object' end as output_type,
         c.event_type = 'error' as has_error,
         case when c.event_type = 'error' then
              case when c.event_id % 2 = 0 then 'TimeoutError' else 'ValueError' end end as error_type
  from e c left join e p
    on c.trace_id = p.trace_id and c.rn > 1 and p.rn = cast(floor(c.rn / 2.0) as bigint))
"""

SPAN_ORDERS_CTE = """
span_orders as (
  select concat('c', c_custkey) as span_id, concat('c', c_custkey) as trace_id,
         cast(null as varchar(64)) as parent_span_id, concat('crm-', c_nationkey % 2) as agent_id,
         concat('CustomerService.', c_mktsegment) as function_name, c_acctbal + 1000 as duration_ms
  from customer
  union all
  select concat('o', o_orderkey), concat('c', o_custkey), concat('c', o_custkey), 'orders',
         concat('OrderService.', o_orderpriority), o_totalprice / 1000 from orders
  union all
  select concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
                cast(round(l_extendedprice * 100) as bigint)), concat('c', o_custkey),
         concat('o', l_orderkey), 'shipping', concat('handle', l_returnflag, l_linestatus), l_quantity
  from lineitem join orders on l_orderkey = o_orderkey)
"""

SPAN_TURNS_CTE = """
span_turns as (
  select concat('t', conv_id, '-', turn) as span_id, concat('conv', conv_id) as trace_id,
         case when turn = 0 then null else concat('t', conv_id, '-', turn - 1) end as parent_span_id,
         'chat' as agent_id, concat('Chat.', role) as function_name,
         cast(length(text) as double) as duration_ms, turn as ingest_seq, turn as received_at
  from conversations)
"""
