"""The live call graph kept up by micro-batches (X6, X9): every batch adds what its spans change; no stored span is read again.

State (``KeyedState`` tables, so a batch writes its own keys only):

* ``nodes``: per function counts, exact sums, flags, first and latest span; ``values``: per function and distinct duration its
  count, from which the 95th percentile is ranked exactly;
* ``index``: per span id the function of the last span that carries it; ``links``: per (parent id, span id) the calls with their
  durations. A link whose parent has not come yet waits here; a repeated span id that moves to another function moves its links,
  because links meet the index when the graph is read off;
* ``edges``: links older than ``ttl_ms``, already added up per pair of functions. Without ``ttl_ms`` all links stay in ``links``.

With ``ttl_ms`` the index and the links hold the spans of that time only, whatever the age of the job: a parent that comes later
than that after its child, or a child that comes later than that after its parent, gives no edge any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlens.functions.stats import EXACT_SCALE, exact_rank_value, exact_sum, rank_floor95
from spanlens.operators import filters as FL
from spanlens.operators import graph as G
from spanlens.schema import arrival_key, conform
from spanlens.streaming.state import KeyedState, delete, is_complete

_ARR = "struct<r: long, s: long>"
_SUM = f"decimal(38,{EXACT_SCALE})"
_NODES = (f"agent_id string, function_name string, call_count long, total_duration_ms {_SUM}, has_anomaly boolean, has_error boolean, "
          f"first_seen {_ARR}, first struct<file: string, description: string, line: long>, latest_order {_ARR}, "
          "latest struct<span_id: string, received_at: long>")
_VALUES = "agent_id string, function_name string, value double, n long"
_INDEX = f"span_id string, seen {_ARR}, node struct<agent_id: string, function_name: string>"
_LINKS = f"parent_span_id string, span_id string, call_count long, total_duration_ms {_SUM}, first_seen {_ARR}"
_EDGES = ("src_agent_id string, src_function_name string, dst_agent_id string, dst_function_name string, call_count long, "
          f"total_duration_ms {_SUM}, first_seen {_ARR}")
_PAIR = [*G.SRC, *G.DST]


def _sums(*more) -> list:
    return [F.sum("call_count").alias("call_count"), F.sum("total_duration_ms").cast(_SUM).alias("total_duration_ms"), *more]


def _merge_nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*G.NODE_KEYS).agg(*_sums(
        F.bool_or("has_anomaly").alias("has_anomaly"), F.bool_or("has_error").alias("has_error"), F.min("first_seen").alias("_seen"),
        F.min_by("first", "first_seen").alias("first"), F.min("latest_order").alias("_order"), F.min_by("latest", "latest_order").alias("latest"),
    )).withColumnsRenamed({"_seen": "first_seen", "_order": "latest_order"}).select(*G.NODE_KEYS, "call_count", "total_duration_ms", "has_anomaly",
                                                                                     "has_error", "first_seen", "first", "latest_order", "latest")


def _merge_values(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*G.NODE_KEYS, "value").agg(F.sum("n").alias("n"))


def _merge_index(rows: DataFrame) -> DataFrame:
    return rows.groupBy("span_id").agg(F.max("seen").alias("_seen"), F.max_by("node", "seen").alias("node")).select(
        "span_id", F.col("_seen").alias("seen"), "node")


def _merge_links(rows: DataFrame) -> DataFrame:
    return rows.groupBy("parent_span_id", "span_id").agg(*_sums(F.min("first_seen").alias("first_seen")))


def _merge_edges(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_PAIR).agg(*_sums(F.min("first_seen").alias("first_seen")))


def _joined(links: DataFrame, index: DataFrame) -> DataFrame:
    """Links whose parent is known, as edges of two functions; calls of a function to itself drop out."""
    at = lambda c: index.select(F.col("span_id").alias(c), F.col("node").alias(f"_{c}"))
    pair = links.join(at("parent_span_id"), "parent_span_id").join(at("span_id"), "span_id").where("_parent_span_id != _span_id")
    return pair.select(*(F.col(f"_parent_span_id.{k}").alias(c) for k, c in zip(G.NODE_KEYS, G.SRC)),
                       *(F.col(f"_span_id.{k}").alias(c) for k, c in zip(G.NODE_KEYS, G.DST)), "call_count", "total_duration_ms", "first_seen")


class LiveGraph:
    """The graph of all batches given to ``update``; ``graph(id)`` is the graph after batch ``id``.

    ``filters`` are the arguments of ``filter_spans`` (agent, function name, tag): the visible graph of new spans under a filter.
    """

    def __init__(self, spark: SparkSession, root: str, ttl_ms: int | None = None, every: int = 8, filters: dict | None = None):
        make = lambda name, schema, merge: KeyedState(spark, root, name, schema, merge, every)
        self.ttl_ms, self.filters = ttl_ms, filters or {}
        self.nodes, self.values = make("nodes", _NODES, _merge_nodes), make("values", _VALUES, _merge_values)
        self.index, self.links, self.edges = make("index", _INDEX, _merge_index), make("links", _LINKS, _merge_links), make("edges", _EDGES, _merge_edges)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a batch of stored spans. A batch may be given again under its id; other batches must not run at the same time."""
        s = conform(FL.filter_spans(batch, **self.filters)).withColumn("_arr", arrival_key())
        s = s.select(*G.NODE_KEYS, "span_id", "parent_span_id", "duration_ms", "anomaly", "has_error", "file", "description", "line", "received_at",
                     "ingest_seq", "_arr")
        own = s.groupBy(*G.NODE_KEYS).agg(
            F.count(F.lit(1)).alias("call_count"), exact_sum("duration_ms").cast(_SUM).alias("total_duration_ms"),
            F.coalesce(F.bool_or("anomaly"), F.lit(False)).alias("has_anomaly"), F.coalesce(F.bool_or("has_error"), F.lit(False)).alias("has_error"),
            F.min("_arr").alias("first_seen"), F.min_by(F.struct("file", "description", "line"), "_arr").alias("first"),
            F.min(F.struct((-F.col("received_at")).alias("r"), F.col("ingest_seq").alias("s"))).alias("latest_order"),
            F.min_by(F.struct("span_id", "received_at"), F.struct((-F.col("received_at")).alias("r"), F.col("ingest_seq").alias("s"))).alias("latest"))
        self.nodes.add(batch_id, own)
        self.values.add(batch_id, s.where("duration_ms is not null").groupBy(*G.NODE_KEYS, F.col("duration_ms").alias("value")).agg(
            F.count(F.lit(1)).alias("n")))
        self.index.add(batch_id, s.groupBy("span_id").agg(F.max("_arr").alias("seen"), F.max_by(F.struct(*G.NODE_KEYS), "_arr").alias("node")))
        self.links.add(batch_id, s.where("parent_span_id is not null").groupBy("parent_span_id", "span_id").agg(
            F.count(F.lit(1)).alias("call_count"), exact_sum("duration_ms").cast(_SUM).alias("total_duration_ms"), F.min("_arr").alias("first_seen")))
        if self.links.due(batch_id):
            self._compact(batch_id)

    def _compact(self, batch_id: int) -> None:
        """Combines deltas; links that expire become edges, or nothing if their parent never came."""
        horizon = None
        if self.ttl_ms is not None:
            newest = self.nodes.before(batch_id + 1).agg(F.max("latest.received_at")).first()[0]
            horizon = None if newest is None else newest - self.ttl_ms
        old = F.lit(False) if horizon is None else F.col("first_seen.r") < horizon
        if horizon is not None:
            self.edges.add(batch_id, _merge_edges(_joined(self.links.before(batch_id + 1).where(old), self.index.before(batch_id + 1))))
            self.edges.compact(batch_id)
        self.links.compact(batch_id, lambda rows: rows.where(~old))
        # a link at the horizon may still wait for its ends: their ids stay twice as long
        self.index.compact(batch_id, None if horizon is None else lambda rows: rows.where(F.col("seen.r") >= horizon - self.ttl_ms))
        self.nodes.compact(batch_id)
        self.values.compact(batch_id)

    def graph(self, batch_id: int) -> G.Graph:
        """A1 to A3 after the batch ``batch_id``, from the state alone."""
        at = batch_id + 1
        p95 = exact_rank_value(self.values.before(at), G.NODE_KEYS, "value", rank_floor95, "p95_duration_ms", weight="n").drop("n")
        nodes = self.nodes.before(at).join(p95, G.NODE_KEYS, "left").select(
            *G.NODE_KEYS, G.node_id("agent_id", "function_name").alias("node_id"), "first.file", "first.description", "call_count",
            (F.col("total_duration_ms") / F.col("call_count")).cast("double").alias("avg_duration_ms"), "total_duration_ms",
            F.coalesce("p95_duration_ms", F.lit(0.0)).alias("p95_duration_ms"), "has_anomaly", "has_error",
            F.col("latest.span_id").alias("latest_span_id"), F.col("latest.received_at").alias("latest_received_at"), "first_seen")
        live = _joined(self.links.before(at), self.index.before(at))
        edges = _merge_edges(live.unionByName(self.edges.before(at))).withColumn(
            "avg_duration_ms", (F.col("total_duration_ms") / F.col("call_count")).cast("double"))
        return G.Graph(G._slow_flag(nodes), edges)


def live_graph_stream(spans: DataFrame, out: str, checkpoint: str, ttl_ms: int | None = 3_600_000, filters: dict | None = None,
                      trigger: dict | None = None, keep: int = 2, every: int = 8) -> StreamingQuery:
    """A stream of stored spans keeps ``out/nodes/v=N`` and ``out/edges/v=N`` up to date; the newest ``keep`` versions stay.

    Read the newest complete version with ``read_live_graph``. The state lives under ``checkpoint``, beside the stream's offsets.
    """
    spark = spans.sparkSession
    live = LiveGraph(spark, f"{checkpoint}/graph", ttl_ms, every, filters)

    def run(batch: DataFrame, batch_id: int) -> None:
        live.update(batch, batch_id)
        g = live.graph(batch_id)
        g.nodes.write.mode("overwrite").parquet(f"{out}/nodes/v={batch_id}")
        g.edges.write.mode("overwrite").parquet(f"{out}/edges/v={batch_id}")
        for kind in ("nodes", "edges"):
            delete(spark, f"{out}/{kind}/v={batch_id - keep}")

    w = spans.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/offsets")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_live_graph(spark: SparkSession, out: str, batch_id: int) -> G.Graph:
    """The graph that ``live_graph_stream`` wrote after a batch."""
    if not (is_complete(spark, f"{out}/nodes/v={batch_id}") and is_complete(spark, f"{out}/edges/v={batch_id}")):
        raise ValueError(f"no complete graph of batch {batch_id} under {out}")
    return G.Graph(spark.read.parquet(f"{out}/nodes/v={batch_id}"), spark.read.parquet(f"{out}/edges/v={batch_id}"))
