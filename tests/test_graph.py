"""Call graph, p95 rules, slow flag, self-loops, collapse, diff, critical path."""

from __future__ import annotations

import random

from helpers import make_spans
from pyspark.sql import functions as F

from spanlens.functions.stats import p95_floor, p95_rank, sequence_number
from spanlens.operators import graph as G
from spanlens.operators.critical_path import critical_path


def _nodes(df):
    return {(r.agent_id, r.function_name): r for r in df.collect()}


def test_slow_node_needs_five_nodes_and_top_avg(spark):
    rows = [{"function_name": f"f{i}", "duration_ms": d} for i, d in enumerate([10, 20, 30, 40, 500])]
    n = _nodes(G.call_graph_nodes(make_spans(spark, rows)))
    assert [k[1] for k, r in n.items() if r.is_slow] == ["f4"]


def test_fewer_than_five_nodes_none_slow(spark):
    rows = [{"function_name": "a", "duration_ms": 9999.0}, {"function_name": "b", "duration_ms": 1.0}]
    assert not any(r.is_slow for r in G.call_graph_nodes(make_spans(spark, rows)).collect())


def test_self_loop_dropped_live_kept_export(spark):
    rows = [{"span_id": "p"}, {"span_id": "c", "parent_span_id": "p"}]
    s = make_spans(spark, rows)
    assert G.call_graph_edges(s).count() == 0
    e = G.export_edges(s).collect()
    assert len(e) == 1 and e[0].call_count == 1


def test_p95_rules_differ_at_n20(spark):
    vals = [float(i) for i in range(1, 21)]
    df = spark.createDataFrame([("k", v) for v in vals], "k string, d double")
    a = p95_floor(df, ["k"], "d").first()
    b = p95_rank(df, ["k"], "d").first()
    assert a.p95 == 20.0  # rule A: sorted[min(19, 19)]
    assert b.p95 == 19.0  # rule B: sorted[ceil(19) - 1] = sorted[18]


def test_exact_rank_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(3000):  # a third of the rows on one key, many ties and a wide range
        rows.append(("hot", float(rnd.choice([0.0, 1.5, 2.25, 1e6, -3.0, rnd.random() * 100]))))
    for k in range(40):
        for _ in range(rnd.randint(1, 120)):
            rows.append((f"k{k}", float(rnd.randint(0, 30)) / 7))
    df = spark.createDataFrame(rows, "k string, d double")
    got_a = {r.k: r.p95 for r in p95_floor(df, ["k"], "d").collect()}
    got_b = {r.k: r.p95 for r in p95_rank(df, ["k"], "d").collect()}
    groups: dict[str, list[float]] = {}
    for k, d in rows:
        groups.setdefault(k, []).append(d)
    import math

    for k, vs in groups.items():
        vs = sorted(vs)
        n = len(vs)
        assert got_a[k] == vs[min(math.floor(0.95 * n), n - 1)]
        assert got_b[k] == vs[max(0, math.ceil(0.95 * n) - 1)]


def test_sequence_number_is_dense_and_ordered(spark):
    rnd = random.Random(5)
    rows = [("a" if i % 3 else "b", rnd.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, t long, id long")
    out = sequence_number(df, ["g"], ["t", "id"], partitions=7).collect()
    for g in ("a", "b"):
        mine = sorted((r.seq, r.t, r.id) for r in out if r.g == g)
        expect = sorted((t, i) for gg, t, i in rows if gg == g)
        assert [m[0] for m in mine] == list(range(1, len(expect) + 1))
        assert [(m[1], m[2]) for m in mine] == expect


def test_duplicate_span_id_last_wins_as_parent(spark):
    rows = [
        {"span_id": "x", "function_name": "first"},
        {"span_id": "x", "function_name": "second"},
        {"span_id": "c", "parent_span_id": "x", "function_name": "child"},
    ]
    e = G.call_graph_edges(make_spans(spark, rows)).collect()
    assert [(r.src_function_name, r.dst_function_name) for r in e] == [("second", "child")]


def test_orphan_parent_gives_no_edge(spark):
    rows = [{"span_id": "c", "parent_span_id": "missing"}]
    assert G.call_graph_edges(make_spans(spark, rows)).count() == 0


def test_collapse_by_agent_labels_and_cross_edges(spark):
    rows = [
        {"span_id": "a", "agent_id": "A", "function_name": "f", "duration_ms": 10.0},
        {"span_id": "b", "agent_id": "A", "function_name": "g", "parent_span_id": "a", "duration_ms": 30.0},
        {"span_id": "c", "agent_id": "B", "function_name": "h", "parent_span_id": "b", "duration_ms": 5.0},
    ]
    g = G.collapse(G.call_graph(make_spans(spark, rows)), "agent")
    labels = {r.group_id: r.function_name for r in g.nodes.collect()}
    assert labels == {"group:agent:A": "A (2 fns)", "group:agent:B": "B (1 fn)"}
    e = g.edges.collect()
    assert [(r.src_group, r.dst_group, r.call_count) for r in e] == [("group:agent:A", "group:agent:B", 1)]


def test_graph_diff_statuses(spark):
    base = spark.createDataFrame([("a", "f", 100.0), ("a", "g", 100.0), ("a", "gone", 1.0), ("a", "z", 0.0)],
                                 "agent_id string, function_name string, avg_duration_ms double")
    cur = spark.createDataFrame([("a", "f", 120.0), ("a", "g", 95.0), ("a", "new", 5.0), ("a", "z", 7.0)],
                                "agent_id string, function_name string, avg_duration_ms double")
    d = {r.function_name: (r.status, r.delta_pct) for r in G.graph_diff(base, cur).collect()}
    assert d["f"][0] == "slower" and abs(d["f"][1] - 20.0) < 1e-9
    assert d["g"][0] == "unchanged"
    assert d["new"] == ("added", 0.0)
    assert d["z"] == ("unchanged", 0.0)
    assert d["gone"][0] == "removed"
    assert G.removed_nodes(base, cur).first().removed_count == 1


def _graph(spark, nodes, edges):
    n = spark.createDataFrame([("a", f, avg, (i, 0)) for i, (f, avg) in enumerate(nodes)],
                              "agent_id string, function_name string, avg_duration_ms double, "
                              "first_seen struct<r:long,s:long>")
    e = spark.createDataFrame([("a", s, "a", t, (i, 0)) for i, (s, t) in enumerate(edges)],
                              "src_agent_id string, src_function_name string, dst_agent_id string, "
                              "dst_function_name string, first_seen struct<r:long,s:long>")
    return G.Graph(n, e)


def test_critical_path_dag(spark):
    g = _graph(spark, [("root", 1.0), ("a", 5.0), ("b", 2.0), ("c", 10.0)],
               [("root", "a"), ("root", "b"), ("b", "c")])
    p = critical_path(g).orderBy("step").collect()
    assert [r.function_name for r in p] == ["root", "b", "c"]
    assert p[0].total_ms == 13.0


def test_critical_path_cycle_rule(spark):
    # all nodes on a cycle: leftover order = first seen; edges only count towards later-ranked nodes
    g = _graph(spark, [("x", 1.0), ("y", 2.0), ("z", 4.0)], [("x", "y"), ("y", "z"), ("z", "x")])
    p = critical_path(g).orderBy("step").collect()
    # no in-degree-0 node: all are candidates; dist z=4, y=2+4=6, x=1+6=7 (z->x is ignored)
    assert [r.function_name for r in p] == ["x", "y", "z"]
    assert p[0].total_ms == 7.0


def test_graph_health_and_weights(spark):
    rows = [{"span_id": "p", "function_name": "f", "duration_ms": 10.0},
            {"span_id": "c", "parent_span_id": "p", "function_name": "g", "duration_ms": 30.0}]
    g = G.call_graph(make_spans(spark, rows))
    h = G.graph_health(g.nodes).first()
    assert h.total_calls == 2 and h.functions == 2 and h.avg_latency_ms == 20.0
    w = G.edge_weights(g.edges).first()
    assert w.weight == 5.0
    assert G.graph_health(g.nodes.where(F.lit(False))).count() == 0
