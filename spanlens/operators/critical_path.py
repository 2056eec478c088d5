"""Critical path of a call graph.

dist(n) = avg(n) + max(0, max over children dist(child)); start at the in-degree-0 node with the largest dist
(all nodes when every node has a caller); ties go to the first edge / first node in first-seen order; nothing when
the best total is 0.

Cycles follow the reference's rule by relation instead of by a sequential sort: nodes left over by a topological
peel (those on or below a cycle) are ranked by first-seen order, and an edge between two leftover nodes counts
only when it points to a later-ranked node. The remaining edge set is acyclic, so the DP converges.

Everything runs on the node and edge tables (dimensions: one row per function / caller pair) as iterative
DataFrame jobs: a peel round and a relax round are one join + aggregate each; each round's result is written to
the shared checkpoint folder so lineage stays short and a lost executor recomputes one round only.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlens.operators.graph import DST, NODE_KEYS, SRC, Graph
from spanlens.session import cut_lineage


def _peel_leftovers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that a topological peel never removes (on or reachable from a cycle)."""
    remaining = cut_lineage(nodes.select(*NODE_KEYS))
    left = remaining.count()
    while True:
        live_src = remaining.select(F.col("agent_id").alias(SRC[0]), F.col("function_name").alias(SRC[1]))
        e = edges.join(live_src, SRC, "left_semi")
        targets = e.select(F.col(DST[0]).alias("agent_id"), F.col(DST[1]).alias("function_name")).distinct()
        nxt = cut_lineage(remaining.join(targets, NODE_KEYS, "left_semi"))
        now = nxt.count()
        if now == left:
            return nxt
        remaining, left = nxt, now


def critical_path(graph: Graph) -> DataFrame:
    """Rows (step, agent_id, function_name, avg_duration_ms, dist_ms, total_ms) from the start node down."""
    # graph order = first-seen order; the struct itself is the rank (structs compare field by field)
    nodes = cut_lineage(graph.nodes.select(
        *NODE_KEYS, "avg_duration_ms",
        F.struct(F.col("first_seen").alias("f"), F.col("agent_id").alias("a"), F.col("function_name").alias("n"))
        .alias("rank")))
    edges = cut_lineage(graph.edges.select(*SRC, *DST, F.col("first_seen").alias("edge_seen")))
    left = _peel_leftovers(nodes, edges).withColumn("_left", F.lit(True))

    src_info = nodes.join(left, NODE_KEYS, "left").select(
        F.col("agent_id").alias(SRC[0]), F.col("function_name").alias(SRC[1]),
        F.col("rank").alias("_sr"), F.coalesce("_left", F.lit(False)).alias("_sl"),
    )
    dst_info = nodes.join(left, NODE_KEYS, "left").select(
        F.col("agent_id").alias(DST[0]), F.col("function_name").alias(DST[1]),
        F.col("rank").alias("_dr"), F.coalesce("_left", F.lit(False)).alias("_dl"),
    )
    e2 = edges.join(src_info, SRC).join(dst_info, DST)
    usable = cut_lineage(e2.where(~(F.col("_sl") & F.col("_dl") & (F.col("_dr") <= F.col("_sr")))).select(
        *SRC, *DST, "edge_seen"
    ))

    dist = cut_lineage(nodes.select(*NODE_KEYS, "avg_duration_ms", F.col("avg_duration_ms").alias("dist")))
    while True:
        child = dist.select(F.col("agent_id").alias(DST[0]), F.col("function_name").alias(DST[1]),
                            F.col("dist").alias("_cd"))
        best = usable.join(child, DST).groupBy(*SRC).agg(F.max("_cd").alias("_best"))
        best = best.select(F.col(SRC[0]).alias("agent_id"), F.col(SRC[1]).alias("function_name"), "_best")
        nxt = dist.join(best, NODE_KEYS, "left").select(
            *NODE_KEYS, "avg_duration_ms",
            (F.col("avg_duration_ms") + F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0))).alias("dist"),
        )
        nxt = cut_lineage(nxt)
        changed = nxt.join(dist.select(*NODE_KEYS, F.col("dist").alias("_old")), NODE_KEYS).where(
            F.col("dist") != F.col("_old")
        )
        dist = nxt
        if changed.isEmpty():
            break

    # next step: the child with the largest dist (> 0), first edge in first-seen order on ties
    child = dist.select(F.col("agent_id").alias(DST[0]), F.col("function_name").alias(DST[1]),
                        F.col("dist").alias("_cd"))
    cand = usable.join(child, DST).where(F.col("_cd") > 0)
    w = Window.partitionBy(*SRC).orderBy(F.col("_cd").desc(), "edge_seen")
    nxt_step = cut_lineage(cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*SRC, *DST))

    # start: in-degree 0 over all edges (all nodes if none), largest dist > 0, first-seen on ties
    has_caller = edges.select(F.col(DST[0]).alias("agent_id"), F.col(DST[1]).alias("function_name")).distinct()
    roots = dist.join(has_caller, NODE_KEYS, "left_anti")
    pool = roots if not roots.isEmpty() else dist
    start = pool.join(nodes.select(*NODE_KEYS, "rank"), NODE_KEYS).where(F.col("dist") > 0).orderBy(
        F.col("dist").desc(), "rank"
    ).limit(1)
    start = cut_lineage(start.select(*NODE_KEYS, F.col("dist").alias("total_ms"), F.lit(0).alias("step")))
    path = start
    cur = start
    for step in count(1):
        here = cur.select(F.col("agent_id").alias(SRC[0]), F.col("function_name").alias(SRC[1]), "total_ms")
        nxt = here.join(nxt_step, SRC).select(
            F.col(DST[0]).alias("agent_id"), F.col(DST[1]).alias("function_name"), "total_ms",
            F.lit(step).alias("step"),
        )
        nxt = cut_lineage(nxt)
        if nxt.isEmpty():
            break
        path = path.unionByName(nxt)
        cur = nxt
    return path.join(dist, NODE_KEYS).select(
        "step", *NODE_KEYS, "avg_duration_ms", F.col("dist").alias("dist_ms"), "total_ms"
    )
