"""Ranked search against plain Python, and the sharing DAG against its queries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    split_docs = [(i, Counter(split(t))) for i, t in docs]
    split_docs = [(i, c) for i, c in split_docs if c]
    n_docs, n_all = len(split_docs), sum(sum(c.values()) for _, c in split_docs)
    df = Counter(t for _, c in split_docs for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(split(t))
    out = []
    for item, ts in queries.items():
        scored = []
        for d, c in split_docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefgéß日7") for _ in range(draw.randint(1, 3))) for _ in range(150)]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", ", ", "_", "\x00", "\x7f", "\n"]) for _ in range(n))
    docs = [(i, text(draw.randint(1, 80))) for i in range(200)]
    docs += [(300 + i, docs[i][1]) for i in range(40)] + [docs[0], docs[0], (None, docs[1][1]), (None, None), (500, None), (501, ""), (502, " .-_ "),
                                                         (503, "Wort WORT wort " * 3000), (504, "É é Straße")]
    shared = [text(6), text(9)]
    items = [(i, shared[i % 2] + text(draw.randint(0, 12))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "?!"), (43, "nowhere zzzz"), (3, "wort again"), (None, docs[5][1]), (44, "WORT É"), (45, docs[7][1] * 50)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_ranks_equal_brute_force(spark, tables, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CELLS", 5000)
    docs, items = tables
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for c in ("n", "ids", "score", "rank", "term", "raw", "item"):
        d, q = d.withColumn(c, F.lit("extra")), q.withColumn(c, F.lit(1))
    got = search.rank_documents(d, q, 7)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 7)


def test_sharing_holds_each_query_and_saves_additions():
    draw = random.Random(2)
    common = [draw.sample(range(60), 12) for _ in range(4)]
    queries = [sorted({*common[i % 4], *common[(i + 1) % 4], *draw.sample(range(400), 5)}) for i in range(50)]
    plan = search.mined(queries, 400)
    sets = [Counter({t}) for t in range(400)]
    nodes = [Counter() for _ in range(plan.nodes)]
    for t in {t for q in queries for t in q}:
        nodes[plan.leaf[t]].update(sets[t])
    at = plan.nodes - sum(len(a) for a, _ in plan.levels)
    for left, right in plan.levels:
        for a, b in zip(left, right):
            assert a < at and b < at + len(left)
            nodes[at] = nodes[a] + nodes[b]
            at += 1
    ends = [*plan.starts[1:], len(plan.left)]
    for q, a, b in zip(queries, plan.starts, ends):
        assert sum((nodes[n] for n in plan.left[a:b]), Counter()) == Counter(q)  # each term once
    assert plan.adds < 0.6 * plan.plain


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        got = search.rank_documents(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_best_keeps_ties_by_document():
    best, draw, seen = search.Best(3, 4), np.random.default_rng(1), []
    for _ in range(20):
        scores, docs = draw.integers(0, 5, (3, 6)), draw.integers(0, 1000, 6)
        best.add(scores, docs)
        seen += [(q, -scores[q, d], docs[d]) for q in range(3) for d in range(6) if scores[q, d]]
    want = [x for q in range(3) for x in sorted(e for e in seen if e[0] == q)[:4]]
    assert list(zip(best.q, -best.score, best.doc)) == want
