"""Structured Streaming: live ingest, arrival rate, subscribe, periodic dump (X1, X3-X5, X7, X8). X2 is in ``ratecap``, X6 and X9 in
``live_graph``.

Live ingest (X1) = ``foreachBatch`` over explode, rate cap, validate, redact, the two flags and the sink. Both flags are decided by
first arrivals, so each needs only a table of them from earlier batches (``state.KeyedState``):

* X4 anomaly: first arrival per (agent, function, output type), at most 7 rows per function; it never expires;
* X5 distributed: first arrival per trace and agent; a trace expires ``trace_ttl_ms`` after its last span.

A micro-batch unions its rows with these rows and applies the batch rules (W1, W2), so the results are equal; it writes its own keys
only. The sink is written last: a batch whose sink folder is complete is not run again, a batch that failed before writes over its own
versions, so every span is stored once.

Spans are taken in arrival order: by the columns the source orders by (``order_cols``, for example partition and offset), by recorded
stamps in the message (``arrival_col``), or, for a folder of message files, as ``read_messages`` gives them: by file time, file and line.
A source without an order of its own is refused, because the order in which Spark deals out files is not one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlens.operators import filters as FL
from spanlens.operators import graph as G
from spanlens.operators.ingest import explode_messages, flag_anomalies, flag_distributed, output_type, parse_spans
from spanlens.operators.redact import redact
from spanlens.schema import conform
from spanlens.session import checkpoint_dir
from spanlens.streaming.ratecap import RATE_LIMIT, RateCap, rate_cap  # noqa: F401
from spanlens.streaming.state import KeyedState, delete, is_complete

_ARRIVED = "received_at long, ingest_seq long"


def _first_arrivals(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    first = rows.groupBy(*keys).agg(F.min(F.struct("received_at", "ingest_seq")).alias("_a"), *more)
    return first.select(*keys, "_a.received_at", "_a.ingest_seq", *(c for c in first.columns if c not in (*keys, "_a")))


def first_types(rows: DataFrame) -> DataFrame:
    """X4 state: the first arrival of each output type of a function."""
    return _first_arrivals(rows, ["agent_id", "function_name", "output_type"])


def first_agents(rows: DataFrame) -> DataFrame:
    """X5 state: the first arrival of each agent in a trace, and the trace's last span from it."""
    return _first_arrivals(rows, ["trace_id", "agent_id"], F.max("last").alias("last"))


def live_traces(rows: DataFrame, ttl_ms: int | None) -> DataFrame:
    """X5 state that can still matter: a trace's first two agents, for ``ttl_ms`` after its last span (newest span of all = now)."""
    per_trace = Window.partitionBy("trace_id")  # over (trace, agent): one row an agent
    x = rows.withColumn("_last", F.max("last").over(per_trace)).withColumn(
        "_r", F.row_number().over(per_trace.orderBy("received_at", "ingest_seq"))).where("_r <= 2")
    if ttl_ms is not None:
        x = x.where(F.col("_last") >= rows.agg(F.max("last")).scalar() - ttl_ms)
    return x.select("trace_id", "agent_id", "received_at", "ingest_seq", F.col("_last").alias("last"))


def flag_state(spark: SparkSession, root: str) -> tuple[KeyedState, KeyedState]:
    return (KeyedState(spark, root, "node_types", f"agent_id string, function_name string, output_type string, {_ARRIVED}", first_types),
            KeyedState(spark, root, "trace_agents", f"trace_id string, agent_id string, {_ARRIVED}, last long", first_agents))


def anomaly_batch(batch: DataFrame, node_types: DataFrame) -> DataFrame:
    """W1 for one micro-batch given first-arrival state: state rows stand in for earlier spans."""
    b = conform(batch).withColumn("output_type", output_type(batch)).withColumn("_batch", F.lit(True))
    known = node_types.withColumn("_batch", F.lit(False))
    return flag_anomalies(b.unionByName(known, allowMissingColumns=True)).where("_batch").drop("_batch")


def distributed_batch(batch: DataFrame, trace_agents: DataFrame) -> DataFrame:
    """W2 for one micro-batch given the first arrivals of earlier agents of its traces."""
    b = batch.withColumn("_batch", F.lit(True))
    known = trace_agents.drop("last").withColumn("_batch", F.lit(False))
    return flag_distributed(b.unionByName(known, allowMissingColumns=True)).where("_batch").drop("_batch")


def read_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of message files (one JSON text a line) with an order of its own: file time, file, place in the file."""
    raw = spark.readStream.format("text").options(**options).load(path)
    return raw.select("value", F.col("_metadata.file_modification_time").alias("_file_time"), F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"))


_FILE_ORDER = ["_file_time", "_file", "_block"]


def ingest_stream(raw: DataFrame, sink: str, checkpoint: str | None = None, value_col: str = "value",
                  require_uuid: bool = True, redact_keys: str | list = "hub", extra_keys: list | None = None,
                  trace_ttl_ms: int | None = 3_600_000, trigger: dict | None = None,
                  arrival_col: str | None = None, order_cols: list[str] | None = None, connection_col: str | None = None,
                  per_second: int = RATE_LIMIT, time_col: str | None = None) -> StreamingQuery:
    """Raw message stream → explode → rate cap → validate → redact → anomaly → distributed → sink.

    ``arrival_col`` names a key of the message with a recorded arrival time (replay of recorded traffic, which then also keeps its
    recorded ``ingest_seq``). Otherwise spans keep the source's order (see the module) and their place in a batched message;
    ``received_at`` is then ``time_col`` (epoch milliseconds at which the source took the message) or the batch's processing time.

    ``connection_col`` (a column of the source) turns the cap on: over ``per_second`` accepted messages a second and connection are
    dropped before they are validated, so bad messages use the quota. It needs the messages' own times. Invalid messages are dropped;
    ``parse_spans`` gives their reasons in batch jobs.
    """
    spark = raw.sparkSession
    if order_cols is None and set(_FILE_ORDER) <= set(raw.columns):
        order_cols = _FILE_ORDER
    if order_cols is None and arrival_col is None:
        raise ValueError("the source has no order: name order_cols or arrival_col, or read message files with read_messages")
    if connection_col is not None and arrival_col is None and time_col is None:
        raise ValueError("the rate cap needs the messages' times: name arrival_col or time_col")
    root = checkpoint or os.path.join(checkpoint_dir(spark), "spanlens-ingest-" + uuid.uuid4().hex[:8])
    node_types, trace_agents = flag_state(spark, os.path.join(root, "state"))
    cap = RateCap(spark, os.path.join(root, "state"), per_second)

    def stamped(batch: DataFrame) -> DataFrame:
        if order_cols:
            batch = batch.withColumn("_line", F.monotonically_increasing_id()).sort(*order_cols, "_line")
        msgs = explode_messages(batch, value_col).withColumn("_nth", F.monotonically_increasing_id())
        received, seq = F.unix_millis(F.current_timestamp()), F.col("_nth")
        if time_col is not None:
            received = F.col(time_col).cast("long")
        if arrival_col is not None:
            v = F.try_parse_json("message")
            received = F.try_variant_get(v, f"$.{arrival_col}", "long")
            seq = F.coalesce(F.try_variant_get(v, "$.ingest_seq", "long"), seq)
        more = [F.col(connection_col).alias("connection")] if connection_col is not None else []
        return msgs.select("message", received.alias("received_at"), seq.alias("ingest_seq"), *more)

    def run(batch: DataFrame, batch_id: int) -> None:
        done = os.path.join(sink, f"batch_id={batch_id}")
        if is_complete(spark, done):
            return  # stored before the last failure
        msgs, capped = stamped(batch), os.path.join(root, "messages", f"v={batch_id}")
        if connection_col is not None:
            msgs.write.mode("overwrite").parquet(capped)  # exploded once, with fixed stamps
            msgs = cap.apply(spark.read.parquet(capped), batch_id).where("accepted").drop("accepted", "connection")
        good = parse_spans(msgs, "message", require_uuid=require_uuid).where(F.size("reasons") == 0).drop("reasons")
        staged = os.path.join(root, "batch", f"v={batch_id}")  # parsed once
        conform(redact(good, keys=redact_keys, extra_keys=extra_keys).drop("redactions")).write.mode("overwrite").parquet(staged)
        b = spark.read.parquet(staged)
        node_types.add(batch_id, first_types(b.withColumn("output_type", output_type(b))))
        trace_agents.add(batch_id, first_agents(b.withColumn("last", F.col("received_at"))))
        if trace_agents.due(batch_id):
            node_types.compact(batch_id)
            trace_agents.compact(batch_id, lambda rows: live_traces(rows, trace_ttl_ms))
        flagged = distributed_batch(anomaly_batch(b, node_types.before(batch_id)), trace_agents.before(batch_id))
        flagged.write.mode("overwrite").parquet(done)
        for folder in (staged, capped):
            delete(spark, folder)

    w = raw.writeStream.foreachBatch(run).option("checkpointLocation", os.path.join(root, "offsets"))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink)


# ---------------------------------------------------------------- X3: arrival rate


def arrival_rate(spans: DataFrame, window_ms: int = 1000, slide_ms: int = 200, watermark: str | None = None
                 ) -> DataFrame:
    """Spans received per sliding window (1 s windows every 200 ms); works on batch and streaming input."""
    s = spans.withColumn("_ts", F.timestamp_millis("received_at"))
    if watermark is not None:
        s = s.withWatermark("_ts", watermark)
    w = F.window("_ts", f"{window_ms} milliseconds", f"{slide_ms} milliseconds")
    return s.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("spans")).select(
        F.unix_millis("w.start").alias("window_start_ms"), "spans")


# ---------------------------------------------------------------- X6 / X9: live graph


def live_node_stats(stream: DataFrame) -> DataFrame:
    """X6 (incremental part): per node count, mean, flags and latest arrival as a streaming aggregation
    (update mode). p95, slow flags and edges come from ``refresh_graph`` over the sink."""
    s = conform(stream)
    return s.groupBy("agent_id", "function_name").agg(
        F.count(F.lit(1)).alias("call_count"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.bool_or("anomaly").alias("has_anomaly"), F.bool_or("has_error").alias("has_error"),
        F.max("received_at").alias("latest_received_at"),
    )


def refresh_graph(spark: SparkSession, sink: str, out: str, agent_id: str | None = None, function: str = "",
                  tag: str = "") -> None:
    """Rebuild the exact live graph (A1/A2 with filters P2-P4) from the sink into ``out``."""
    s = FL.filter_spans(read_sink(spark, sink), agent_id=agent_id, function=function, tag=tag)
    g = G.call_graph(s)
    g.nodes.write.mode("overwrite").parquet(os.path.join(out, "nodes"))
    g.edges.write.mode("overwrite").parquet(os.path.join(out, "edges"))


# ---------------------------------------------------------------- X7 / X8


def complete_batches(spark: SparkSession, sink: str) -> list[int]:
    """Batches that the sink holds completely."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    ids = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))
    return [i for i in ids if is_complete(spark, os.path.join(sink, f"batch_id={i}"))]


def subscribe(spark: SparkSession, sink: str, last: int = 200) -> tuple[DataFrame, DataFrame]:
    """The newest ``last`` stored spans for a new consumer, then the stream of the spans stored after them.

    The snapshot is taken as of the newest complete batch; the changes are the batches after it, so no span is in both and none that is
    stored later is missed. Start the stream with a checkpoint of its own; it goes on where it stopped.
    """
    batches = complete_batches(spark, sink)
    if not batches:
        raise ValueError(f"no complete batch under {sink}")
    newest = batches[-1]
    stored = spark.read.option("basePath", sink).parquet(*(os.path.join(sink, f"batch_id={i}") for i in batches))
    changes = spark.readStream.schema(stored.schema).parquet(sink).where(F.col("batch_id") > newest)
    return FL.recent(stored, k=last), changes


def flush_stream(stream: DataFrame, path: str, checkpoint: str, interval: str = "30 seconds",
                 last_n: int | None = None, trigger: dict | None = None, sink: str | None = None) -> StreamingQuery:
    """Every ``interval`` a dump as NDJSON (one folder a batch): the newest ``last_n`` spans of the store ``sink``, or without a store
    the batch's own."""
    from spanlens.sources.spans_io import write_spans

    def run(batch: DataFrame, batch_id: int) -> None:
        spans = batch
        if sink is not None:
            batches = complete_batches(stream.sparkSession, sink)
            spans = stream.sparkSession.read.option("basePath", sink).parquet(*(os.path.join(sink, f"batch_id={i}") for i in batches)).drop("batch_id")
        write_spans(spans, os.path.join(path, f"flush={batch_id}"), last_n)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": interval})).start()
