"""Span trees (T1-T4, O5): roots, depth, path, chain depth, flame layout, nested documents.

Trees are built by pointer doubling: every span points to an ancestor, and each round replaces the pointer by its
ancestor's pointer, so a chain of n spans needs about log2(n) rounds, each one join of narrow rows. Rounds are written to the
shared checkpoint folder. Spans in a parent cycle never reach a root and are absent, like in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.schema import conform
from spanlens.session import written
from spanlens.sources.spans_io import span_json


def span_tree(spans: DataFrame, per_trace: bool = True) -> DataFrame:
    """Every reachable span with ``root_id``, ``depth`` (root = 0) and ``path`` (span ids from the root).

    Roots are spans whose parent is null or not in the set (J2). With ``per_trace`` the parent must be in the
    same trace (the correlator's rule); otherwise parents are looked up over the whole set (report chains). A span whose
    parent id occurs more than once has one row for each of them.

    A round settles the spans whose pointer has passed the root. Spans that wait have ancestors at every smaller depth, so a
    round that settles none has only cycles left.
    """
    s = written(conform(spans).select("trace_id", "span_id", "parent_span_id", "function_name", "agent_id",
                                      "duration_ms", "started_at", "received_at", "ingest_seq"))
    scope = ["trace_id"] if per_trace else []
    # only spans with children are ever looked up: the rounds leave the leaves out, a last join hangs them on
    parents = s.select(*scope, F.col("parent_span_id").alias("span_id")).distinct()
    inner = s.select(*scope, "span_id", F.col("parent_span_id").alias("_up")).join(parents, [*scope, "span_id"], "left_semi")
    ids = inner.select(*scope, F.col("span_id").alias("_up")).distinct()
    start = inner.join(ids.withColumn("_known", F.lit(True)), [*scope, "_up"], "left")
    state = written(start.select(*scope, "span_id", F.when(F.col("_known"), F.col("_up")).alias("_up"), F.array("span_id").alias("path")))
    done, waiting = state.where("_up is null"), state.where("_up is not null")
    while True:
        above = state.select(*scope, F.col("span_id").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_head"))
        moved = written(waiting.join(above, [*scope, "_up"]).select(
            *scope, "span_id", F.col("_next").alias("_up"), F.concat("_head", "path").alias("path")))
        settled, waiting = moved.where("_up is null"), moved.where("_up is not null")
        if settled.isEmpty():
            break
        done = done.unionByName(settled)
        state = done.unionByName(waiting)
    # what still waits hangs on a cycle: its path is null, and so is that of the leaves below it
    heads = done.select(*scope, "span_id", "path").unionByName(waiting.select(*scope, "span_id", F.lit(None).cast("array<string>").alias("path")))
    heads = heads.select(*(F.col(c).alias("_" + c) for c in scope), F.col("span_id").alias("_id"), F.col("path").alias("_head"))
    on = [F.col("parent_span_id") == F.col("_id"), *(F.col(c) == F.col("_" + c) for c in scope)]
    whole = F.when(F.col("_id").isNull(), F.array("span_id")).otherwise(F.concat("_head", F.array("span_id")))
    tree = s.join(heads, on, "left").where("_id is null or _head is not null").select(*s.columns, whole.alias("path"))
    return tree.select(*s.columns, F.element_at("path", 1).alias("root_id"), (F.size("path") - 1).alias("depth"), "path")


def tree_depths(tree: DataFrame) -> DataFrame:
    """Per root: chain depth (levels = 1 + deepest descendant depth), child count of the root."""
    return tree.groupBy("root_id").agg(
        (F.max("depth") + 1).alias("chain_depth"),
        F.count_if(F.col("depth") == 1).alias("root_children"),
        F.count(F.lit(1)).alias("tree_spans"),
    )


def call_chains(spans: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` deepest call chains over the whole set (roots with at least one child), by depth then root
    duration, both descending; ties keep arrival order."""
    tree = span_tree(spans, per_trace=False)
    d = tree_depths(tree).where(F.col("root_children") > 0)
    roots = tree.where(F.col("depth") == 0).select(
        F.col("span_id").alias("root_id"), "function_name", "duration_ms", "received_at", "ingest_seq"
    )
    ranked = d.join(roots, "root_id")
    return ranked.orderBy(
        F.col("chain_depth").desc(), F.col("duration_ms").desc(), "received_at", "ingest_seq"
    ).limit(k).select("root_id", "function_name", "duration_ms", "chain_depth", "tree_spans")


def flame(spans: DataFrame) -> DataFrame:
    """Flame layout per trace: depth (BFS within the trace, unreached 0), x = (start - trace start)/total
    clipped at 0, width = duration/total; a trace with total <= 0 is dropped."""
    s = conform(spans)
    tree = span_tree(s, per_trace=True)
    depth = tree.groupBy("trace_id", "span_id").agg(F.max("depth").alias("_depth"))
    # per-trace facts are aggregates joined back (a hot trace never sits in one window task)
    bounds = s.groupBy("trace_id").agg(
        F.min("started_at").alias("trace_start"),
        F.max(F.col("started_at") + F.col("duration_ms")).alias("_end"),
    ).withColumn("total_ms", F.col("_end") - F.col("trace_start")).where(F.col("total_ms") > 0).drop("_end")
    deepest = depth.groupBy("trace_id").agg(F.max("_depth").alias("max_depth"))
    per_trace = bounds.join(deepest, "trace_id", "left").withColumn("max_depth", F.coalesce("max_depth", F.lit(0)))
    f = s.join(per_trace, "trace_id").join(depth, ["trace_id", "span_id"], "left")
    f = f.withColumn("depth", F.coalesce("_depth", F.lit(0)))
    return f.select(
        "trace_id", "span_id", "agent_id", "function_name", "started_at", "duration_ms", "depth", "max_depth",
        F.greatest((F.col("started_at") - F.col("trace_start")) / F.col("total_ms"), F.lit(0.0)).alias("x_frac"),
        F.greatest(F.col("duration_ms") / F.col("total_ms"), F.lit(0.0)).alias("width_frac"),
        "total_ms", "trace_start", "has_error", "anomaly",
    )


def span_tree_json(spans: DataFrame, per_trace: bool = True) -> DataFrame:
    """T4: nested tree documents, one row per root: each node is the whole span with its ``children`` in arrival order.
    Built bottom-up, one level per step, from the T1 table."""
    keys = ["trace_id", "span_id", "received_at", "ingest_seq"]
    whole = conform(spans)
    place = span_tree(spans, per_trace=per_trace).select(*keys, F.col("parent_span_id").alias("_parent"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"))
    # the texts are made after the join, which so moves columns, and written once for all levels
    tree = written(whole.join(place, keys).select(*keys, F.col("_parent").alias("parent_span_id"), F.col("_root").alias("root_id"),
                                                  F.col("_depth").alias("depth"), span_json(whole).alias("_h")))
    max_d = tree.agg(F.max("depth")).first()[0]
    scope = ["trace_id"] if per_trace else []

    def node_doc(kids):
        return F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"children":['), kids, F.lit("]}"))

    docs = None
    for d in range(max_d, -1, -1):
        lvl = tree.where(F.col("depth") == d)
        if docs is not None:
            kids = docs.groupBy(*[F.col(k).alias("_s_" + k) for k in scope], F.col("parent_span_id").alias("_p")).agg(
                F.array_sort(F.collect_list(F.struct("received_at", "ingest_seq", "doc"))).alias("_k")
            )
            cond = [F.col("span_id") == F.col("_p")] + [F.col(k) == F.col("_s_" + k) for k in scope]
            lvl = lvl.join(kids, cond, "left").drop("_p", *["_s_" + k for k in scope])
            kid_text = F.coalesce(F.array_join(F.transform("_k", lambda x: x["doc"]), ","), F.lit(""))
        else:
            kid_text = F.lit("")
        lvl = lvl.withColumn("doc", node_doc(kid_text))
        docs = written(lvl.select(*scope, "span_id", "parent_span_id", "root_id", "received_at", "ingest_seq", "doc"))
    return docs.select(*scope, F.col("root_id"), F.col("doc").alias("tree_json"))
