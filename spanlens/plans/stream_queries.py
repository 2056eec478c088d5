"""Registered streaming queries (X1-X9): live ingest replayed from table-derived messages must equal the batch flags; arrival rate
(sliding windows), the rate cap, the live graph after every batch, a new consumer's snapshot and changes, the store's dump."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from spanlens.functions.stats import sql_rounded_mean
from spanlens.plans.registry import EV, EV_FLAGGED, events, register, with_ctes
from spanlens.plans.span_queries import EV_DISTRIBUTED, one_message, span_messages
from spanlens.session import checkpoint_dir, cut_lineage
from spanlens.operators.ingest import flag_anomalies
from spanlens.plans.graph_queries import _LIVE_EDGES_SQL, _LIVE_NODES_SQL, live_nodes_out, mean6
from spanlens.operators.graph import DST, SRC
from spanlens.schema import SPAN_COLUMNS, conform
from spanlens.streaming import live, live_graph

BATCHES = 4


def message_slices(spark, sf_dir) -> list:
    """The span messages of ``span_events`` with their arrival ``_t``, in BATCHES slices of arrival time; cuts sit on the
    50 ms batching grid so no message is split."""
    s = events(spark, sf_dir)
    cuts = s.agg(F.percentile_approx("received_at", [i / BATCHES for i in range(1, BATCHES)], 10000)).first()[0]
    bounds = [None, *[int(c) // 50 * 50 for c in cuts], None]
    msgs = cut_lineage(span_messages(s).withColumn("_t", F.get_json_object(
        F.when(F.col("value").startswith("["), F.get_json_object("value", "$[0]")).otherwise(F.col("value")),
        "$.received_at").cast("long")))  # built once, then written as arrival slices
    return [msgs.where((F.lit(lo is None) | (F.col("_t") >= (lo or 0))) & (F.lit(hi is None) | (F.col("_t") < (hi or 0))))
            for lo, hi in zip(bounds, bounds[1:])]


_STREAM_SQL = with_ctes(EV, EV_FLAGGED, EV_DISTRIBUTED) \
    + "\nselect f.span_id, f.anomaly, d.distributed from flagged f join dist d using (span_id)"


@register("stream_ingest_flags", _STREAM_SQL)
def q_stream_ingest_flags(spark, sf_dir):
    """A replay with recorded stamps: each slice of arrival time comes in as files of its own and is taken in before the next."""
    root = os.path.join(checkpoint_dir(spark), "spanlens-replay-" + uuid.uuid4().hex[:8])
    in_dir, sink = os.path.join(root, "in"), os.path.join(root, "sink")
    for part in message_slices(spark, sf_dir):
        part.select("value").write.mode("append").text(in_dir)
        raw = spark.readStream.format("text").load(in_dir)
        live.ingest_stream(raw, sink, checkpoint=os.path.join(root, "ck"), require_uuid=False,
                           arrival_col="received_at").awaitTermination()
    return live.read_sink(spark, sink).select("span_id", "anomaly", "distributed")


@register("stream_ingest_live", _STREAM_SQL)
def q_stream_ingest_live(spark, sf_dir):
    """Live traffic without recorded stamps: the source's own order (here the message time) and the place in a batched message
    decide what came first."""
    root = os.path.join(checkpoint_dir(spark), "spanlens-live-" + uuid.uuid4().hex[:8])
    in_dir, sink = os.path.join(root, "in"), os.path.join(root, "sink")
    for part in message_slices(spark, sf_dir):
        part.select("_t", "value").write.mode("append").parquet(in_dir)
        raw = spark.readStream.schema("_t long, value string").parquet(in_dir)
        live.ingest_stream(raw, sink, checkpoint=os.path.join(root, "ck"), require_uuid=False,
                           order_cols=["_t"]).awaitTermination()
    return live.read_sink(spark, sink).select("span_id", "anomaly", "distributed")


@register(
    "arrival_rate",
    with_ctes(EV)
    + """
select (received_at // 200) * 200 - k * 200 as window_start_ms, count(*) as spans
from span_events, range(0, 5) r(k) group by all""",
)
def q_arrival_rate(spark, sf_dir):
    return live.arrival_rate(events(spark, sf_dir))


@register(
    "rate_cap",
    "with recursive " + EV.strip() + """,
r as (select span_id, agent_id, received_at,
             row_number() over (partition by agent_id order by received_at, ingest_seq) as rn
      from span_events),
c(agent_id, rn, span_id, log, accepted) as (
  select agent_id, rn, span_id, [received_at], true from r where rn = 1
  union all
  select r.agent_id, r.rn, r.span_id,
         case when len(list_filter(c.log, lambda x: x >= r.received_at - 1000)) < 500
              then list_append(list_filter(c.log, lambda x: x >= r.received_at - 1000), r.received_at)
              else list_filter(c.log, lambda x: x >= r.received_at - 1000) end,
         len(list_filter(c.log, lambda x: x >= r.received_at - 1000)) < 500
  from c join r on r.agent_id = c.agent_id and r.rn = c.rn + 1)
select span_id, agent_id, accepted from c""",
)
def q_rate_cap(spark, sf_dir):
    """The reference's 500 per second per agent connection (SQL twin: the per-message log as a recursion)."""
    s = events(spark, sf_dir).select("span_id", "agent_id", "received_at", "ingest_seq")
    return live.rate_cap(s, 500).select("span_id", "agent_id", "accepted")


# ---------------------------------------------------------------- X1, X2: a view that really bursts

#: Two connections; 2,000 messages come within 667 ms, the next 2,000 start 900 ms later, every tenth time after five idle seconds.
_BURST_MS = "(ingest_seq div 2000) * 900 + (ingest_seq div 20000) * 5000 + (ingest_seq % 2000) div 3"
_BURST_SQL = "with recursive " + EV.strip() + f""",
burst as (
  select * exclude (received_at), {_BURST_MS.replace(" div ", " // ")} as received_at,
         case when ingest_seq % 3 < 2 then 'hot' else 'calm' end as connection from span_events),
r as (select span_id, connection, received_at, ingest_seq, row_number() over (partition by connection order by received_at, ingest_seq) as rn
      from burst),
c(connection, rn, span_id, log, accepted) as (
  select connection, rn, span_id, [received_at], true from r where rn = 1
  union all
  select r.connection, r.rn, r.span_id,
         case when len(list_filter(c.log, lambda x: x >= r.received_at - 1000)) < 500
              then list_append(list_filter(c.log, lambda x: x >= r.received_at - 1000), r.received_at)
              else list_filter(c.log, lambda x: x >= r.received_at - 1000) end,
         len(list_filter(c.log, lambda x: x >= r.received_at - 1000)) < 500
  from c join r on r.connection = c.connection and r.rn = c.rn + 1)
"""


def bursts(spark, sf_dir):
    """``span_events`` in bursts far over the cap, two thirds of them on one connection."""
    return events(spark, sf_dir).withColumn("received_at", F.expr(_BURST_MS).cast("long")).withColumn(
        "connection", F.when(F.col("ingest_seq") % 3 < 2, "hot").otherwise("calm"))


@register("rate_cap_burst", _BURST_SQL + "select span_id, connection, accepted from c")
def q_rate_cap_burst(spark, sf_dir):
    """X2 where it rejects: stretches of overload on a hot connection."""
    s = bursts(spark, sf_dir).select("span_id", "connection", "received_at", "ingest_seq")
    return live.rate_cap(s, 500, key="connection").select("span_id", "connection", "accepted")


_KEPT_SQL = """,
kept as (select b.* from burst b join c using (span_id) where c.accepted and b.ingest_seq % 50 != 7),
""" + EV_FLAGGED.replace("span_events", "kept").strip() + ",\n" + EV_DISTRIBUTED.replace("span_events", "kept").strip()


@register("stream_ingest_capped", _BURST_SQL + _KEPT_SQL + "\nselect f.span_id, f.anomaly, d.distributed from flagged f join dist d using (span_id)")
def q_stream_ingest_capped(spark, sf_dir):
    """X1 with the cap as a stage: four batches that begin within a millisecond of the one before; one message in 50 is invalid and uses
    its connection's quota all the same."""
    root = os.path.join(checkpoint_dir(spark), "spanlens-capped-" + uuid.uuid4().hex[:8])
    s = bursts(spark, sf_dir).withColumn("duration_ms", F.when(F.col("ingest_seq") % 50 == 7, -1.0).otherwise(F.col("duration_ms")))
    msgs = cut_lineage(s.select("connection", "ingest_seq", one_message(s).alias("value")))
    in_dir, sink = os.path.join(root, "in"), os.path.join(root, "sink")
    for i in range(BATCHES):
        msgs.where((F.col("ingest_seq") >= i * 2500) & ((F.lit(i == BATCHES - 1)) | (F.col("ingest_seq") < (i + 1) * 2500))).write.mode(
            "append").parquet(in_dir)
        raw = spark.readStream.schema(msgs.schema).parquet(in_dir)
        live.ingest_stream(raw, sink, checkpoint=os.path.join(root, "ck"), require_uuid=False, arrival_col="received_at",
                           connection_col="connection", per_second=500, trace_ttl_ms=None).awaitTermination()
    return live.read_sink(spark, sink).select("span_id", "anomaly", "distributed")


def _delivered(messages, folder: str) -> None:
    """Adds a delivery of message files to ``folder``: sorted over all tasks, one file time for all files of it (later than that of the
    delivery before it), so that their names go on with the order."""
    spark = messages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = lambda: {f.getPath().getName(): f for f in (fs.listStatus(path) if fs.exists(path) else []) if f.getPath().getName().startswith("part-")}
    before = files()
    messages.write.mode("append").text(folder)
    new = [f for name, f in files().items() if name not in before]
    at = max([f.getModificationTime() for f in new] + [f.getModificationTime() + 1 for f in before.values()], default=0)
    for f in new:
        fs.setTimes(f.getPath(), at, -1)


@register("stream_ingest_files", _STREAM_SQL)
def q_stream_ingest_files(spark, sf_dir):
    """Message files without stamps or order columns, taken in by one batch: a quarter of the messages first, the rest after it. File time,
    file and line decide what came first."""
    root = os.path.join(checkpoint_dir(spark), "spanlens-files-" + uuid.uuid4().hex[:8])
    first, *rest = message_slices(spark, sf_dir)
    late = rest[0]
    for part in rest[1:]:
        late = late.unionByName(part)
    for part in (first, late):
        _delivered(part.sort("_t").select("value"), os.path.join(root, "in"))
    live.ingest_stream(live.read_messages(spark, os.path.join(root, "in")), os.path.join(root, "sink"), checkpoint=os.path.join(root, "ck"),
                       require_uuid=False).awaitTermination()
    return live.read_sink(spark, os.path.join(root, "sink")).select("span_id", "anomaly", "distributed")


# ---------------------------------------------------------------- X6, X9: the live graph after every batch


def _live_graphs(spark, sf_dir, filters=None):
    """Four batches of stored spans, dealt by number so that parents come after their children; the graphs after each."""
    root = os.path.join(checkpoint_dir(spark), "spanlens-graph-" + uuid.uuid4().hex[:8])
    s = cut_lineage(conform(flag_anomalies(events(spark, sf_dir))).select(*SPAN_COLUMNS))
    for i in range(BATCHES):
        s.where(F.col("ingest_seq") % BATCHES == i).write.mode("append").parquet(os.path.join(root, "in"))
        live_graph.live_graph_stream(spark.readStream.schema(s.schema).parquet(os.path.join(root, "in")), os.path.join(root, "out"),
                                     os.path.join(root, "ck"), ttl_ms=None, filters=filters, keep=BATCHES, every=2).awaitTermination()
    return [live_graph.read_live_graph(spark, os.path.join(root, "out"), i) for i in range(BATCHES)]


def _after_each(graphs, pick, shape):
    out = None
    for i, g in enumerate(graphs):
        rows = shape(pick(g)).withColumn("batch", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


#: The batch SQL over the spans of the batches so far, once a batch.
_BATCH_NODES_SQL = _LIVE_NODES_SQL.replace("from flagged", "from seen").replace("partition by agent_id, function_name", "partition by batch, agent_id, function_name") \
    .replace("select agent_id, function_name, count(*) as call_count", "select batch, agent_id, function_name, count(*) as call_count") \
    .replace("from nd group by agent_id", "from nd group by batch, agent_id").replace("over (order by avg_ms", "over (partition by batch order by avg_ms") \
    .replace("count(*) over () as nn", "count(*) over (partition by batch) as nn").replace("end) over () as thr", "end) over (partition by batch) as thr")
_SEEN = ",\nseen as (select f.*, b.i::integer as batch from flagged f, range(4) b(i) where f.ingest_seq % 4 <= b.i{more}),\n"
_NODES_OUT = """
select batch, agent_id, function_name, concat(agent_id, ':', function_name) as node_id, file, call_count,
       avg6 as avg_duration_ms, p95 as p95_duration_ms, has_anomaly, has_error, latest_span_id, (nn >= 5 and avg_ms >= thr) as is_slow
from slow"""


@register("live_graph_nodes", with_ctes(EV, EV_FLAGGED) + _SEEN.format(more="") + _BATCH_NODES_SQL.strip() + _NODES_OUT)
def q_live_graph_nodes(spark, sf_dir):
    """A1 and A3 after each batch."""
    return _after_each(_live_graphs(spark, sf_dir), lambda g: g.nodes, live_nodes_out)


_BATCH_EDGES_SQL = """
idx as (
  select batch, span_id, agent_id, function_name from (
    select batch, span_id, agent_id, function_name,
           row_number() over (partition by batch, span_id order by received_at desc, ingest_seq desc) as k
    from seen) where k = 1),
links as (
  select c.batch, p.agent_id as src_agent_id, p.function_name as src_function_name,
         ch.agent_id as dst_agent_id, ch.function_name as dst_function_name, c.duration_ms
  from seen c join idx p on c.batch = p.batch and c.parent_span_id = p.span_id join idx ch on c.batch = ch.batch and c.span_id = ch.span_id)
"""
_EDGES_OUT = f"""
select batch, src_agent_id, src_function_name, dst_agent_id, dst_function_name, count(*) as call_count,
       {sql_rounded_mean('duration_ms', 6)} as avg_duration_ms
from links where not (src_agent_id = dst_agent_id and src_function_name = dst_function_name) group by all"""


def _edges_out(edges):
    return mean6(edges).select(*SRC, *DST, "call_count", "avg_duration_ms")


@register("live_graph_edges", with_ctes(EV, EV_FLAGGED) + _SEEN.format(more="") + _BATCH_EDGES_SQL.strip() + _EDGES_OUT)
def q_live_graph_edges(spark, sf_dir):
    """A2 after each batch."""
    return _after_each(_live_graphs(spark, sf_dir), lambda g: g.edges, _edges_out)


@register("live_graph_edges_filtered", with_ctes(EV, EV_FLAGGED) + _SEEN.format(more=" and contains(lower(f.function_name), 'service')")
          + _BATCH_EDGES_SQL.strip() + _EDGES_OUT)
def q_live_graph_edges_filtered(spark, sf_dir):
    """The visible graph of new spans under a filter on the function's name."""
    return _after_each(_live_graphs(spark, sf_dir, {"function": " Service "}), lambda g: g.edges, _edges_out)


# ---------------------------------------------------------------- X7, X8

#: Midnight of 15 January 2024: messages before it are stored when the consumer comes.
_CUT = 1_705_276_800_000


def _two_stores(spark, sf_dir, between):
    """A sink that takes in the spans before ``_CUT``, then, after ``between(sink)``, the rest."""
    root = os.path.join(checkpoint_dir(spark), "spanlens-store-" + uuid.uuid4().hex[:8])
    msgs = cut_lineage(span_messages(events(spark, sf_dir)).withColumn("_t", F.get_json_object(
        F.when(F.col("value").startswith("["), F.get_json_object("value", "$[0]")).otherwise(F.col("value")), "$.received_at").cast("long")))
    sink, seen = os.path.join(root, "sink"), None
    for late in (False, True):
        msgs.where((F.col("_t") >= _CUT) == late).select("value").write.mode("append").text(os.path.join(root, "in"))
        live.ingest_stream(spark.readStream.format("text").load(os.path.join(root, "in")), sink, checkpoint=os.path.join(root, "ck"),
                           require_uuid=False, arrival_col="received_at", trace_ttl_ms=None).awaitTermination()
        seen = seen or between(sink)
    return root, sink, seen


@register("subscribe_changes", with_ctes(EV) + f"""
select span_id, 'snapshot' as part from (
    select span_id from span_events where received_at < {_CUT} order by received_at desc, ingest_seq desc limit 200)
union all select span_id, 'change' from span_events where received_at >= {_CUT}""")
def q_subscribe_changes(spark, sf_dir):
    """A consumer that comes between two batches gets the newest 200 spans, then each later one once."""
    root, _, (snapshot, changes) = _two_stores(spark, sf_dir, lambda sink: live.subscribe(spark, sink, 200))
    out = os.path.join(root, "changes")
    changes.select("span_id").writeStream.format("parquet").option("checkpointLocation", os.path.join(root, "consumer")).trigger(
        availableNow=True).start(out).awaitTermination()
    later = spark.read.schema("span_id string").parquet(out)
    return snapshot.select("span_id", F.lit("snapshot").alias("part")).unionByName(later.select("span_id", F.lit("change").alias("part")))


@register("flush_newest", with_ctes(EV) + "\nselect span_id from span_events order by received_at desc, ingest_seq desc limit 1000")
def q_flush_newest(spark, sf_dir):
    """The dump after the second batch holds the newest 1,000 spans of the whole store."""
    root, sink, _ = _two_stores(spark, sf_dir, lambda sink: True)
    stored = spark.readStream.schema(live.read_sink(spark, sink).schema).parquet(sink)
    live.flush_stream(stored, os.path.join(root, "dump"), os.path.join(root, "dumped"), last_n=1000, trigger={"availableNow": True},
                      sink=sink).awaitTermination()
    lines = spark.read.text(os.path.join(root, "dump", "flush=0"))
    return lines.select(F.get_json_object("value", "$.span_id").alias("span_id"))
