"""Critical path (G2) against an enumeration of all simple paths of small graphs."""

from __future__ import annotations

import os

import pytest

from spanlens.operators import graph as G
from spanlens.operators.critical_path import critical_path
from spanlens.sources import fixtures


def counted_edges(names: list, edges: set) -> set:
    """Edges that count: all but those that lead from a node on or below a cycle to one seen no later that is so, too."""
    stuck = set(names)
    while (free := {n for n in stuck if not any(s in stuck for s, d in edges if d == n)}):
        stuck -= free
    return {(s, d) for s, d in edges if not (s in stuck and d in stuck and names.index(d) <= names.index(s))}


def simple_paths(start, edges: set, before: tuple = ()):
    yield (*before, start)
    for s, d in edges:
        if s == start and d not in before:
            yield from simple_paths(d, edges, (*before, start))


@pytest.mark.parametrize("view", ["events", "orders"])
def test_no_path_is_longer(spark, view):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables not present")
    spans = fixtures.span_events(spark, sf) if view == "events" else fixtures.span_orders(spark, sf)
    g = G.path_graph(spans)
    avg = {(r.agent_id, r.function_name): r.avg_duration_ms for r in g.nodes.orderBy("first_seen", "agent_id", "function_name").collect()}
    edges = {((r.src_agent_id, r.src_function_name), (r.dst_agent_id, r.dst_function_name)) for r in g.edges.collect()}
    usable = counted_edges(list(avg), edges)
    roots = [n for n in avg if all(d != n for _, d in edges)] or list(avg)
    longest = max(sum(avg[n] for n in p) for r in roots for p in simple_paths(r, usable))
    got = [(r.agent_id, r.function_name) for r in critical_path(g).orderBy("step").collect()]
    assert got[0] in roots and all(e in usable for e in zip(got, got[1:]))
    assert sum(avg[n] for n in got) == pytest.approx(longest)
    assert critical_path(g).first().total_ms == pytest.approx(longest)
