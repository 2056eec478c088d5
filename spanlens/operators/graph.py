"""Call graphs over a span table.

Node identity is the column pair (agent_id, function_name); ``node_id`` text is display only. Two graph variants
exist and are kept apart:

* live graph (``call_graph``): p95 rule A, self-loops dropped, the child of an edge is the node of the *last*
  span with that span id, a slow flag, the latest span per node;
* export graph (``export_graph``): p95 rule B, self-loops kept, the child is the span's own node, values
  rounded to 2 places, first-seen line.

Plan shape: one partial+final aggregation per table on the node keys; the parent lookup is an aggregate on
``span_id`` (map-side combined, so duplicate or hot ids do not skew) joined back on ``parent_span_id``.
Node and edge tables are dimensions (bounded by the number of functions), so per-graph windows over them
(slow threshold, edge weight) are cheap and evaluate each aggregate exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlens.functions.scalar import js_round, service_of
from spanlens.functions.stats import exact_sum, p95_floor, p95_rank, rank_floor95, with_rounded_mean
from spanlens.schema import arrival_key, conform

NODE_KEYS = ["agent_id", "function_name"]
SRC = ["src_agent_id", "src_function_name"]
DST = ["dst_agent_id", "dst_function_name"]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def node_id(agent: Column | str, fn: Column | str, sep: str = ":") -> Column:
    a = F.col(agent) if isinstance(agent, str) else agent
    f = F.col(fn) if isinstance(fn, str) else fn
    return F.concat(a, F.lit(sep), f)


def span_node_index(spans: DataFrame) -> DataFrame:
    """span_id → node of the last span (arrival order) carrying that id (a map ``set`` overwrites)."""
    s = conform(spans)
    return s.groupBy("span_id").agg(
        F.max_by(F.struct(*[F.col(k) for k in NODE_KEYS]), arrival_key()).alias("_node")
    )


def caller_links(spans: DataFrame, child_from_index: bool) -> DataFrame:
    """One row per span whose parent span is known: src node (parent), dst node (child), child duration.

    Unknown parents drop out (inner join). ``child_from_index`` picks the live-graph rule for the child node.
    """
    s = conform(spans)
    idx = span_node_index(s)
    c = s.where(F.col("parent_span_id").isNotNull()).select(
        "span_id", "parent_span_id", "duration_ms", *NODE_KEYS, arrival_key().alias("_arr")
    )
    p = idx.select(F.col("span_id").alias("_pid"), F.col("_node").alias("_pnode"))
    linked = c.join(p, F.col("parent_span_id") == F.col("_pid"), "inner")
    if child_from_index:
        ch = idx.select(F.col("span_id").alias("_cid"), F.col("_node").alias("_cnode"))
        linked = linked.join(ch, F.col("span_id") == F.col("_cid"), "inner")
        dst = [F.col("_cnode.agent_id"), F.col("_cnode.function_name")]
    else:
        dst = [F.col("agent_id"), F.col("function_name")]
    return linked.select(
        F.col("_pnode.agent_id").alias(SRC[0]),
        F.col("_pnode.function_name").alias(SRC[1]),
        dst[0].alias(DST[0]),
        dst[1].alias(DST[1]),
        "duration_ms",
        "_arr",
        "span_id",
    )


def _slow_flag(nodes: DataFrame) -> DataFrame:
    """A3: slow = avg >= p95 (rule A) of all node averages, only with at least 5 nodes.

    A window over the node table, which has one row per function: the threshold and the comparison read the very same averages.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = nodes.withColumn("_nn", F.count(F.lit(1)).over(every)).withColumn("_rn", F.row_number().over(every.orderBy("avg_duration_ms", *NODE_KEYS)))
    cut = F.max(F.when(F.col("_rn") == rank_floor95(F.col("_nn")), F.col("avg_duration_ms"))).over(every)
    return ranked.withColumn("_cut", cut).withColumn(
        "is_slow", F.coalesce((F.col("_nn") >= 5) & (F.col("avg_duration_ms") >= F.col("_cut")), F.lit(False))).drop("_nn", "_rn", "_cut")


def call_graph_nodes(spans: DataFrame) -> DataFrame:
    """A1 + A3: live-graph nodes."""
    s = conform(spans)
    agg = s.groupBy(*NODE_KEYS).agg(
        F.count(F.lit(1)).alias("call_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        exact_sum("duration_ms").alias("total_duration_ms"),
        F.coalesce(F.bool_or("anomaly"), F.lit(False)).alias("has_anomaly"),
        F.coalesce(F.bool_or("has_error"), F.lit(False)).alias("has_error"),
        F.min_by(F.struct("file", "description", "line"), arrival_key()).alias("_first"),
        F.min(arrival_key()).alias("first_seen"),
        # latest span: max received_at, the first one in arrival order wins ties
        F.min_by(F.struct("span_id", "received_at"),
                 F.struct((-F.col("received_at")).alias("r"), F.col("ingest_seq").alias("s"))).alias("_latest"),
    )
    p95 = p95_floor(s, NODE_KEYS, "duration_ms", out="p95_duration_ms").drop("n")
    nodes = agg.join(p95, NODE_KEYS, "left").select(
        *NODE_KEYS,
        node_id("agent_id", "function_name").alias("node_id"),
        F.col("_first.file").alias("file"),
        F.col("_first.description").alias("description"),
        "call_count",
        "avg_duration_ms",
        "total_duration_ms",
        F.coalesce("p95_duration_ms", F.lit(0.0)).alias("p95_duration_ms"),
        "has_anomaly",
        "has_error",
        F.col("_latest.span_id").alias("latest_span_id"),
        F.col("_latest.received_at").alias("latest_received_at"),
        "first_seen",
    )
    return _slow_flag(nodes)


def call_graph_edges(spans: DataFrame) -> DataFrame:
    """A2: live-graph edges; mean child duration; self-loops dropped."""
    links = caller_links(spans, child_from_index=True)
    links = links.where(~((F.col(SRC[0]) == F.col(DST[0])) & (F.col(SRC[1]) == F.col(DST[1]))))
    return links.groupBy(*SRC, *DST).agg(
        F.count(F.lit(1)).alias("call_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        exact_sum("duration_ms").alias("total_duration_ms"),
        F.min("_arr").alias("first_seen"),
    )


def call_graph(spans: DataFrame) -> Graph:
    return Graph(call_graph_nodes(spans), call_graph_edges(spans))


# ---------------------------------------------------------------- export variant


def export_nodes(spans: DataFrame) -> DataFrame:
    """Export nodes (rule B p95, values rounded to 2 places, first-seen file/line/description)."""
    s = conform(spans)
    agg = s.groupBy(*NODE_KEYS).agg(
        F.count(F.lit(1)).alias("call_count"),
        exact_sum("duration_ms").alias("_sum"),
        F.coalesce(F.bool_or("anomaly"), F.lit(False)).alias("has_anomaly"),
        F.coalesce(F.bool_or("has_error"), F.lit(False)).alias("has_error"),
        F.min_by(F.struct("file", "line", "description"), arrival_key()).alias("_first"),
        F.min(arrival_key()).alias("first_seen"),
    )
    agg = with_rounded_mean(agg, "_sum", "call_count", 2, "_avg")
    p95 = p95_rank(s, NODE_KEYS, "duration_ms", out="_p95").drop("n")
    return agg.join(p95, NODE_KEYS, "left").select(
        *NODE_KEYS,
        node_id("agent_id", "function_name", "::").alias("node_id"),
        F.col("_first.file").alias("file"),
        F.col("_first.line").alias("line"),
        F.col("_first.description").alias("description"),
        "call_count",
        F.col("_avg").alias("avg_duration_ms"),
        js_round(F.coalesce("_p95", F.lit(0.0)), 2).alias("p95_duration_ms"),
        "has_anomaly",
        "has_error",
        "first_seen",
    )


def export_edges(spans: DataFrame) -> DataFrame:
    """Export edges; self-loops kept; child = the span's own node; mean rounded to 2 places."""
    links = caller_links(spans, child_from_index=False)
    e = links.groupBy(*SRC, *DST).agg(
        F.count(F.lit(1)).alias("call_count"),
        exact_sum("duration_ms").alias("_sum"),
        F.min("_arr").alias("first_seen"),
    )
    return with_rounded_mean(e, "_sum", "call_count", 2, "avg_duration_ms").drop("_sum")


def export_graph(spans: DataFrame) -> Graph:
    return Graph(export_nodes(spans), export_edges(spans))


def export_summary(spans: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: distinct agents (count and sorted list), total spans, nodes with anomaly / error."""
    s = conform(spans)
    nodes = export_nodes(s) if nodes is None else nodes
    anomaly_nodes = nodes.agg(F.count_if(F.col("has_anomaly"))).scalar()
    error_nodes = nodes.agg(F.count_if(F.col("has_error"))).scalar()
    return s.agg(
        F.count_distinct("agent_id").alias("agent_count"),
        F.array_sort(F.collect_set("agent_id")).alias("agents"),
        F.count(F.lit(1)).alias("total_spans"),
    ).select("*", anomaly_nodes.alias("anomaly_count"), error_nodes.alias("error_count"))


# ---------------------------------------------------------------- collapse (A4, A5)


def collapse(graph: Graph, by: str) -> Graph:
    """A4/A5: collapse nodes by ``agent`` or ``file``; cross-group edges only."""
    if by not in ("agent", "file"):
        raise ValueError("by must be 'agent' or 'file'")
    nodes = graph.nodes
    key = F.col("agent_id") if by == "agent" else F.col("file")
    label = F.col("agent_id") if by == "agent" else F.element_at(F.split(F.col("file"), "/"), -1)
    gid = F.concat(F.lit(f"group:{by}:"), key)
    n = nodes.withColumn("group_id", gid).withColumn("_label", label)
    g = Window.partitionBy("group_id")
    g_ord = g.orderBy("avg_duration_ms", *NODE_KEYS)
    n = (
        n.withColumn("_rn", F.row_number().over(g_ord))
        .withColumn("_k", F.count(F.lit(1)).over(g))
    )
    grouped = n.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("fn_count"),
        F.sum("call_count").alias("call_count"),
        F.avg("avg_duration_ms").alias("avg_duration_ms"),
        F.max(F.when(F.col("_rn") == rank_floor95(F.col("_k")), F.col("avg_duration_ms"))).alias("p95_duration_ms"),
        F.bool_or("has_anomaly").alias("has_anomaly"),
        F.bool_or("has_error").alias("has_error"),
        F.bool_or("is_slow").alias("is_slow"),
        F.min_by(F.struct("_label", "agent_id", "file"), "first_seen").alias("_first"),
        F.min_by(F.struct("latest_span_id", "latest_received_at"),
                 F.struct((-F.col("latest_received_at")).alias("r"), F.col("first_seen").alias("f"))).alias("_latest"),
        F.min("first_seen").alias("first_seen"),
    )
    gnodes = grouped.select(
        "group_id",
        F.concat(
            F.col("_first._label"), F.lit(" ("), F.col("fn_count").cast("string"),
            F.when(F.col("fn_count") != 1, F.lit(" fns)")).otherwise(F.lit(" fn)")),
        ).alias("function_name"),
        F.col("_first.agent_id").alias("agent_id"),
        F.col("_first.file").alias("file"),
        "fn_count", "call_count", "avg_duration_ms", "p95_duration_ms",
        "has_anomaly", "has_error", "is_slow",
        F.col("_latest.latest_span_id").alias("latest_span_id"),
        F.col("_latest.latest_received_at").alias("latest_received_at"),
        "first_seen",
    )
    member = n.select(*NODE_KEYS, "group_id")
    src = member.select(F.col("agent_id").alias(SRC[0]), F.col("function_name").alias(SRC[1]),
                        F.col("group_id").alias("src_group"))
    dst = member.select(F.col("agent_id").alias(DST[0]), F.col("function_name").alias(DST[1]),
                        F.col("group_id").alias("dst_group"))
    e = graph.edges.join(src, SRC).join(dst, DST).where(F.col("src_group") != F.col("dst_group"))
    gedges = e.groupBy("src_group", "dst_group").agg(
        F.sum("call_count").alias("call_count"),
        F.avg("avg_duration_ms").alias("avg_duration_ms"),
        F.min("first_seen").alias("first_seen"),
    )
    return Graph(gnodes, gedges)


# ---------------------------------------------------------------- diff


def graph_diff(base_nodes: DataFrame, cur_nodes: DataFrame, pct: float = 10.0) -> DataFrame:
    """G1: per node added / slower / faster / unchanged (±``pct`` %), and removed rows for base-only nodes."""
    b = base_nodes.select(*NODE_KEYS, F.col("avg_duration_ms").alias("base_avg_ms"))
    c = cur_nodes.select(*NODE_KEYS, F.col("avg_duration_ms").alias("cur_avg_ms"), F.lit(True).alias("_in_cur"))
    j = c.join(b.withColumn("_in_base", F.lit(True)), NODE_KEYS, "full_outer")
    delta = F.when(
        F.col("base_avg_ms") > 0, (F.col("cur_avg_ms") - F.col("base_avg_ms")) / F.col("base_avg_ms") * 100
    ).otherwise(F.lit(0.0))
    status = (
        F.when(F.col("_in_cur").isNull(), F.lit("removed"))
        .when(F.col("_in_base").isNull(), F.lit("added"))
        .when(delta > pct, F.lit("slower"))
        .when(delta < -pct, F.lit("faster"))
        .otherwise(F.lit("unchanged"))
    )
    return j.select(
        *NODE_KEYS,
        status.alias("status"),
        F.when(F.col("_in_cur").isNull() | F.col("_in_base").isNull(), F.lit(0.0)).otherwise(delta).alias("delta_pct"),
        "base_avg_ms",
        "cur_avg_ms",
    )


def removed_nodes(base_nodes: DataFrame, cur_nodes: DataFrame) -> DataFrame:
    """U4: one row with the number of base nodes missing from the current graph."""
    gone = base_nodes.select(*NODE_KEYS).join(cur_nodes.select(*NODE_KEYS), NODE_KEYS, "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("removed_count"))


# ---------------------------------------------------------------- filters on graphs


def _keep_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    k = kept.select(*NODE_KEYS)
    src = k.select(F.col("agent_id").alias(SRC[0]), F.col("function_name").alias(SRC[1]))
    dst = k.select(F.col("agent_id").alias(DST[0]), F.col("function_name").alias(DST[1]))
    return edges.join(src, SRC, "left_semi").join(dst, DST, "left_semi")


def filter_graph(graph: Graph, node_filter: str = "all") -> Graph:
    """Keep error / anomaly / slow nodes after the graph is built; an edge stays only if both ends stay."""
    cond = {"all": None, "errors": "has_error", "anomalies": "has_anomaly", "slow": "is_slow"}[node_filter]
    if cond is None:
        return graph
    kept = graph.nodes.where(F.col(cond))
    return Graph(kept, _keep_edges(graph.edges, kept))


def hide_nodes(graph: Graph, hidden: DataFrame) -> Graph:
    """Drop the given (agent_id, function_name) nodes and every edge touching them."""
    h = hidden.select(*NODE_KEYS)
    kept = graph.nodes.join(h, NODE_KEYS, "left_anti")
    return Graph(kept, _keep_edges(graph.edges, kept))


def export_visibility(graph: Graph, search: str = "", node_filter: str = "all", service: str | None = None) -> Graph:
    """Export page visibility: name search AND error/anomaly filter AND service; edges need both ends."""
    cond = F.lit(True)
    if search != "":
        cond = cond & F.lower(F.col("function_name")).contains(search.lower())
    if node_filter == "errors":
        cond = cond & F.col("has_error")
    elif node_filter == "anomalies":
        cond = cond & F.col("has_anomaly")
    if service is not None:
        cond = cond & (service_of(F.col("function_name")) == F.lit(service))
    kept = graph.nodes.where(cond)
    return Graph(kept, _keep_edges(graph.edges, kept))


def mark_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """``marked`` when the name contains the search text (case-insensitive); blank text marks all."""
    if text.strip() == "":
        return nodes.withColumn("marked", F.lit(True))
    return nodes.withColumn("marked", F.lower(F.col("function_name")).contains(text.lower()))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Stroke weight 1 + 4 * count / max(1, max count)."""
    mx = edges.agg(F.greatest(F.max("call_count"), F.lit(1))).scalar()
    return edges.withColumn("weight", F.lit(1.0) + F.col("call_count") / mx * 4)


def neighbours(edges: DataFrame, agent_id: str, function_name: str) -> DataFrame:
    """Callers and callees of one node, with the direction."""
    callers = edges.where((F.col(DST[0]) == agent_id) & (F.col(DST[1]) == function_name)).select(
        F.lit("caller").alias("direction"), F.col(SRC[0]).alias("agent_id"), F.col(SRC[1]).alias("function_name"),
        "call_count", "avg_duration_ms",
    )
    callees = edges.where((F.col(SRC[0]) == agent_id) & (F.col(SRC[1]) == function_name)).select(
        F.lit("callee").alias("direction"), F.col(DST[0]).alias("agent_id"), F.col(DST[1]).alias("function_name"),
        "call_count", "avg_duration_ms",
    )
    return callers.unionByName(callees)


def graph_health(nodes: DataFrame) -> DataFrame:
    """One health row (none for an empty graph): calls, functions, call-weighted mean latency (rounded),
    nodes with error / anomaly / slow."""
    total = F.sum("call_count")
    out = nodes.agg(
        total.alias("total_calls"),
        F.count(F.lit(1)).alias("functions"),
        F.when(total > 0, js_round(F.sum(F.col("avg_duration_ms") * F.col("call_count")) / total))
        .otherwise(F.lit(0.0)).alias("avg_latency_ms"),
        F.count_if(F.col("has_error")).alias("error_nodes"),
        F.count_if(F.col("has_anomaly")).alias("anomaly_nodes"),
        F.count_if(F.col("is_slow")).alias("slow_nodes"),
    )
    return out.where(F.col("functions") > 0)


# ---------------------------------------------------------------- J9 replay frames

TICK_MS = 1_000
SPEEDS = (0.5, 1, 2, 10)


def replay_frames(spans: DataFrame, seek_ts: int | None = None, speed: float = 1, lookback_ms: int = 60_000
                  ) -> DataFrame:
    """The node table of every playback frame: frame i shows spans received at or before
    seek + i * 1000 ms * speed while that is before the newest span; the last frame is live (all spans).

    ``seek_ts`` None starts ``lookback_ms`` before the newest span. Per node, spans are aggregated by the first
    frame that shows them, then accumulated over frames (a running sum over one node's frames), so no frame
    re-reads the spans. Columns: frame, frame_ts (NULL for the live frame), agent_id, function_name,
    call_count, total_duration_ms, avg_duration_ms, has_anomaly, has_error, is_slow.
    """
    if speed not in SPEEDS:
        raise ValueError(f"speed must be one of {SPEEDS}")
    step = int(TICK_MS * speed) if float(TICK_MS * speed).is_integer() else TICK_MS * speed
    s = conform(spans)
    newest = s.agg(F.max("received_at")).scalar()
    seek = (F.lit(seek_ts) if seek_ts is not None else newest - F.lit(lookback_ms)).cast("long")
    # frames before live: seek + i*step < max  →  i < (max - seek) / step
    n_frames = F.greatest(F.ceil((newest - seek) / F.lit(float(step))), F.lit(0)).cast("long")
    # first frame showing a span: smallest i with seek + i*step >= received_at; beyond the last frame → live (= nf)
    fi = F.greatest(F.ceil((F.col("received_at") - seek) / F.lit(float(step))), F.lit(0)).cast("long")
    x = s.withColumn("_seek", seek).withColumn("_nf", n_frames).withColumn("_f", F.least(fi, F.col("_nf")))
    delta = x.groupBy(*NODE_KEYS, "_f", "_nf", "_seek").agg(
        F.count(F.lit(1)).alias("_c"), exact_sum("duration_ms").alias("_s"),
        F.bool_or("anomaly").alias("_a"), F.bool_or("has_error").alias("_e"),
    )
    per_node = Window.partitionBy(*NODE_KEYS).orderBy("_f")  # one row per frame in which the node changes
    upto = per_node.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = delta.select(
        *NODE_KEYS, "_f", "_nf", "_seek",
        F.sum("_c").over(upto).alias("call_count"), F.sum("_s").over(upto).alias("total_duration_ms"),
        F.bool_or("_a").over(upto).alias("has_anomaly"), F.bool_or("_e").over(upto).alias("has_error"),
        F.coalesce(F.lead("_f").over(per_node), F.col("_nf") + 1).alias("_until"),
    )
    frames = cum.select("*", F.explode(F.sequence("_f", F.col("_until") - 1)).alias("frame"))
    frames = frames.withColumn("avg_duration_ms", (F.col("total_duration_ms") / F.col("call_count")).cast("double"))
    # slow flag per frame: one window per frame over that frame's nodes (a dimension)
    wf = Window.partitionBy("frame")
    ranked = frames.withColumn("_rn", F.row_number().over(wf.orderBy("avg_duration_ms", *NODE_KEYS))) \
        .withColumn("_nn", F.count(F.lit(1)).over(wf))
    ranked = ranked.withColumn(
        "_thr", F.max(F.when(F.col("_rn") == rank_floor95(F.col("_nn")), F.col("avg_duration_ms"))).over(wf))
    return ranked.select(
        "frame",
        F.when(F.col("frame") < F.col("_nf"), F.col("_seek") + F.col("frame") * F.lit(step)).cast("long")
        .alias("frame_ts"),
        *NODE_KEYS, "call_count", "total_duration_ms", "avg_duration_ms", "has_anomaly", "has_error",
        ((F.col("_nn") >= 5) & (F.col("avg_duration_ms") >= F.col("_thr"))).alias("is_slow"),
    )


def path_graph(spans: DataFrame) -> Graph:
    """The part of the live graph the critical path needs: node means and first-seen order, live edges.
    One aggregation per table (no p95 passes)."""
    s = conform(spans)
    nodes = s.groupBy(*NODE_KEYS).agg(
        F.avg("duration_ms").alias("avg_duration_ms"), F.min(arrival_key()).alias("first_seen"))
    return Graph(nodes, call_graph_edges(s))
