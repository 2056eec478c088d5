"""The embedding operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from spanlens.llm import nndescent, topk
from spanlens.llm.common import components

ROWS = "vec_id long, embedding array<float>, label int, note string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, exact and scaled copies, ties, null, zero, non-finite and repeated rows."""
    draw = np.random.default_rng(7)
    x = draw.standard_normal((300, 16))
    for c in range(4):
        x[c * 30:c * 30 + 30] = x[c * 30] + 0.08 * draw.standard_normal((30, 16))
    rows = [(i, [float(v) for v in np.float32(x[i])], i // 30 % 3, "n") for i in range(300)]
    rows += [(400 + i, rows[i % 3][1], 0, "copy") for i in range(40)] + [(500, [2 * v for v in rows[0][1]], 0, "scaled")]
    nan, inf = float("nan"), float("inf")
    rows += [(600, None, 0, ""), (620, [0.0] * 16, 0, ""), (640, [nan] + [1.0] * 15, 0, ""), (660, [inf] + [1.0] * 15, 0, ""), (680, [None] + [1.0] * 15, 0, ""),
             (700, rows[0][1], None, ""), (None, rows[0][1], 0, ""), (720, [], 0, ""), (740, rows[5][1], 0, "again"), (740, rows[5][1], 0, "again")]
    return spark.createDataFrame(rows, ROWS)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


def test_near_duplicates_equal_brute_force(spark, vectors):
    rows = vectors.collect()
    ok = [r for r in rows if usable(r.embedding) and any(r.embedding) and r.label is not None and r.vec_id is not None]
    x = np.array([r.embedding for r in ok], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    links = (x @ x.T >= 0.93) & (np.array([r.label for r in ok])[:, None] == np.array([r.label for r in ok])[None, :])
    np.fill_diagonal(links, False)
    least = [r.vec_id for r in ok]
    for _ in ok:
        least = [min([least[i], *(least[j] for j in np.flatnonzero(links[i]))]) for i in range(len(ok))]
    want = sorted([(str(r.vec_id), int(n), str(c)) for r, n, c in zip(ok, links.sum(1), least)] + [(str(r.vec_id), 0, str(r.vec_id)) for r in rows if r not in ok])
    got = nndescent.near_duplicates(vectors).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert nndescent.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def test_lists_grow_when_saturated(spark):
    draw = np.random.default_rng(1)
    x = np.ones(8) + 0.05 * draw.standard_normal((90, 8))
    reps = spark.createDataFrame([(i, 0, bytearray(np.float32(v).tobytes())) for i, v in enumerate(x)], "rid long, label int, raw binary")
    graph, facts = nndescent.neighbour_graph(reps, "<f4", 0.93, k=4)
    assert facts["recall"] == 1.0 and graph.filter("sim >= 0.93").count() == 90 * 89


def test_rare_links_are_all_found(spark, monkeypatch):
    """Few links among many vectors, in cells that part most of them."""
    for name, value in (("CELL", 4), ("HOME", 64), ("TABLES", 1), ("AUDIT", 64)):
        monkeypatch.setattr(nndescent, name, value)
    draw = np.random.default_rng(11)
    x = draw.standard_normal((1200, 96))
    x[:30] = x[30:60] + 0.35 * draw.standard_normal((30, 96))
    x = np.float32(x)
    reps = spark.createDataFrame([(i, 0, bytearray(v.tobytes())) for i, v in enumerate(x)], "rid long, label int, raw binary")
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.93)) if i != j}
    graph, _ = nndescent.neighbour_graph(reps, "<f4", 0.93, k=1)
    got = {tuple(sorted((r.u, r.v))) for r in graph.filter("sim >= 0.93").collect()}
    assert len(want) > 20 and got == {tuple(sorted(map(int, p))) for p in want}


def test_top_k_equals_brute_force(spark, vectors):
    rows = {(r.vec_id, tuple(r.embedding)) for r in vectors.collect() if r.vec_id is not None and usable(r.embedding)}
    ids = np.array([i for i, _ in rows])
    x = np.floor(64 * np.array([v for _, v in rows], float))
    got = {}
    for r in topk.top_k(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        best = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != q)[:20]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(spark.createDataFrame([], ROWS)).count() == 0
    few = topk.top_k(vectors.filter("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2


def test_bounds_lose_no_member():
    import pandas as pd

    draw = np.random.default_rng(2)
    x = np.floor(64 * draw.standard_normal((500, 8)))
    pivots = topk.pick_pivots(x[:100], 6, 1)
    d = topk.distances(x, pivots)
    near, dist = d.argmin(1), d.min(1)
    cells = pd.DataFrame({"pivot": near, "ring": (dist // 20).astype(int), "dist": dist, "norm2": (x * x).sum(1)})
    g = cells.groupby(["pivot", "ring"], as_index=False).agg(near=("dist", "min"), far=("dist", "max"), norm2=("norm2", "max"))
    most = topk.bounds(x[:50], pivots, g)
    at = {(p, r): i for i, (p, r) in enumerate(zip(g["pivot"], g["ring"]))}
    column = [at[p, r] for p, r in zip(cells["pivot"], cells["ring"])]
    assert (x[:50] @ x.T <= most[:, column]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103)] + [(200 + i, 200) for i in range(1, 50)] + [(300, 300), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 103, 105), 100), **dict.fromkeys(range(200, 250), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
