"""Embedding near-dedup by NN-descent on a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_written, written
from .vectors import usable

#: Neighbours a vector starts with, tables of the first graph, members of one of their cells, of one home block.
NEIGHBOURS, TABLES, CELL, HOME = 10, 4, 256, 1024
#: Vectors the audit starts with, true links it goes on for, and the recall of links at which it is content.
AUDIT, ENOUGH, RECALL = 1024, 200, 0.99
#: Rows that are multiplied at once.
_TILE = 2048
_EDGE = "u long, v long, sim double"


def _units(blobs, kind: str) -> np.ndarray:
    blobs = list(blobs)
    if not blobs:
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(ids: np.ndarray, units: np.ndarray, others: np.ndarray, other_units: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """For each of ``ids`` its k most similar others and all others of similarity ``least`` or more."""
    found = []
    for i in range(0, len(ids), _TILE):
        parts, top = [], np.full((len(ids[i:i + _TILE]), k), -2.0)
        for j in range(0, len(others), _TILE):
            s = units[i:i + _TILE] @ other_units[j:j + _TILE].T
            s[ids[i:i + _TILE, None] == others[None, j:j + _TILE]] = -2
            top = -np.partition(-np.hstack((top, s)), k - 1, axis=1)[:, :k]
            r, c = np.nonzero((s >= np.minimum(top.min(axis=1), least)[:, None]) & (s > -2))
            parts.append((r, c + j, s[r, c]))
        r, c, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        ok = s >= np.minimum(top.min(axis=1), least)[r]
        found.append(pd.DataFrame({"u": ids[i:i + _TILE][r[ok]], "v": others[c[ok]], "sim": s[ok]}))
    return pd.concat(found) if found else pd.DataFrame({"u": [], "v": [], "sim": []}).astype({"u": "int64", "v": "int64"})


def lists(edges: DataFrame, k: int, least: float) -> DataFrame:
    """Each vector's k most similar neighbours; a list whose k-th still links is saturated and holds all that link."""
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return one.withColumn("nth", F.row_number().over(w)).filter((F.col("nth") <= k) | (F.col("sim") >= least))


def _met(kind: str, k: int, least: float):
    def run(members: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return nearest(members["own"].to_numpy(), _units(members["vector"], kind), others["rid"].to_numpy(), _units(others["raw"], kind), k, least)

    return run


def neighbour_graph(reps: DataFrame, kind: str, least: float, k: int = NEIGHBOURS, seed: int = 42) -> tuple[DataFrame, dict]:
    """(u, v, sim, nth) and facts (rounds, recall). ``reps``: rid, label, raw (a written table of distinct vectors).

    The first graph joins vectors that share a cell of one of several random-hyperplane tables of their label. Each round
    gathers, for each home block of vectors, the neighbours (also reverse) of its members' neighbours, compares
    blocks with what they gathered, and keeps better lists; lists of vectors with k or more links grow. It ends when a
    round finds no new link, changes next to nothing, and the audit is content; an audit below ``RECALL`` doubles k, and
    where that does not halve the missing links all blocks of a label are compared with each other. The audit compares a
    seeded sample of vectors with every row; it takes more of them, up to all, until it holds ``ENOUGH`` true links. What
    it found joins the graph. Only flags, counts and the sample, a part at a time, reach the driver.
    """
    spark = reps.sparkSession
    sizes = reps.groupBy("label").agg(F.count(F.lit(1)).alias("members"))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _units(b["raw"], kind)
            for t in range(TABLES):
                planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], 40))
                bits = ((x @ planes) > 0) @ (1 << np.arange(40, dtype=np.int64))

                def cell(target):
                    wide = np.maximum(np.ceil(np.log2(b["members"].to_numpy() / target)), 0).astype(np.int64)
                    return bits & ((np.int64(1) << wide) - 1)

                yield pd.DataFrame({"rid": b["rid"], "label": b["label"], "t": t, "cell": cell(CELL)})
                if not t:
                    yield pd.DataFrame({"rid": b["rid"], "label": b["label"], "t": -1, "cell": cell(HOME)})

    keys = ["label", "t", "cell"]
    dealt = written(reps.join(sizes, "label").mapInPandas(cells, "rid long, label int, t int, cell long"), "cells")
    many = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # a cell that very many share is split by hash, another way in each table
    split = F.ceil(F.col("n") / (2 * F.when(F.col("t") < 0, HOME).otherwise(CELL)))
    dealt = written(dealt.join(many, keys).select("rid", "t", F.xxhash64(*keys, F.pmod(F.xxhash64("t", "rid"), split)).alias("block")), "blocks")
    home = dealt.filter("t < 0").select("rid", "block")
    vectors = reps.select("rid", "raw")

    def inside(g: pd.DataFrame) -> pd.DataFrame:
        ids, x = g["rid"].to_numpy(), _units(g["raw"], kind)
        return nearest(ids, x, ids, x, k, least)

    first = dealt.filter("t >= 0").join(vectors, "rid").groupBy("block").applyInPandas(inside, _EDGE)
    graph = written(lists(first, k, least), "graph")

    def audit(sent):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, labels, raw = sent.value
            q, ids, labels = _units(raw, kind), np.array(ids), np.array(labels)
            for b in batches:
                x = _units(b["raw"], kind)
                for i in range(0, len(ids) if len(b) else 0, 1024):
                    s = np.where(labels[i:i + 1024, None] == b["label"].to_numpy()[None, :], q[i:i + 1024] @ x.T, -2)
                    r, c = np.nonzero(s >= least)
                    yield pd.DataFrame({"u": ids[i:i + 1024][r], "v": b["rid"].to_numpy()[c], "sim": s[r, c]}).query("u != v")

        return run

    parts, links, size, last = [], 0, AUDIT, None
    order = reps.select("rid", "label", "raw", F.xxhash64(F.lit(seed), "rid").alias("o"))
    while links < ENOUGH:
        sample = (order if last is None else order.filter(F.col("o") > last)).orderBy("o").limit(size).collect()
        if not sample:
            break
        sent = spark.sparkContext.broadcast(([r.rid for r in sample], [r.label for r in sample], [bytes(r.raw) for r in sample]))
        parts.append(written(reps.mapInPandas(audit(sent), _EDGE), "audit"))
        links, size, last = links + parts[-1].count(), min(2 * size, 16 * AUDIT), sample[-1].o
    known = parts[0] if parts else graph.select("u", "v", "sim").limit(0)
    for p in parts[1:]:
        known = known.union(p)

    def exact() -> DataFrame:
        placed = reps.join(home, "rid").select("label", "block", "rid", "raw")
        blocks = placed.select("label", "block").distinct()
        pairs = blocks.join(blocks.withColumnRenamed("block", "with"), "label").select("block", "with")
        mine = pairs.join(placed.select("block", F.col("rid").alias("own"), F.col("raw").alias("vector")), "block")
        theirs = pairs.select(F.col("block").alias("x"), F.col("with").alias("y")).join(placed.select(F.col("block").alias("y"), "rid", "raw"), "y")
        return mine.groupBy("block", "with").cogroup(theirs.groupBy("x", "y")).applyInPandas(_met(kind, k, least), _EDGE)

    recall, rounds, missed = 1.0, 0, None
    while True:
        rounds += 1
        short = graph.filter(F.col("nth") <= k).select("u", "v")
        both = short.union(short.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = graph.select("u", "v").union(both).join(home, F.col("u") == F.col("rid")).select("block", "v").distinct()
        far = near.join(both.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("block", F.col("w").alias("v"))
        asked = near.union(far).distinct().join(vectors.withColumnRenamed("rid", "v"), "v").select("block", F.col("v").alias("rid"), "raw")

        members = home.join(vectors, "rid").select(F.col("block").alias("at"), F.col("rid").alias("own"), F.col("raw").alias("vector"))
        met = members.groupBy("at").cogroup(asked.groupBy("block")).applyInPandas(_met(kind, k, least), _EDGE)
        after = written(lists(graph.select("u", "v", "sim").union(met), k, least), "graph")
        total = after.count()
        new, linked = after.join(graph.select("u", "v"), ["u", "v"], "left_anti").agg(
            F.count(F.lit(1)), F.count(F.when(F.col("sim") >= least, 1))).first()
        drop_written(graph)
        graph = after
        got = known.join(graph.select("u", "v"), ["u", "v"], "left_semi").count()
        recall = got / links if links else 1.0
        if new <= 0.001 * total and not linked:
            if recall >= RECALL:
                break
            if missed is not None and 2 * (links - got) > missed:
                graph = written(lists(graph.select("u", "v", "sim").union(exact()), k, least), "graph")
                recall = 1.0
                break
            missed = links - got
            k *= 2
    found = known.join(graph.select("u", "v"), ["u", "v"], "left_anti").withColumn("nth", F.lit(0))
    graph = written(graph.select("u", "v", "sim", "nth").union(found.select("u", "v", "sim", "nth")), "graph")
    return graph, {"rounds": rounds, "recall": recall, "neighbours": k}


def near_duplicates(embeddings: DataFrame, least: float = 0.93, seed: int = 42) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a row of ``embeddings`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine, in doubles, is ``least`` or more. Vectors that are
    null, empty, zero or hold null or non-finite components, rows without label or vec_id link with nothing. Rows of equal
    label and vector are one class: it takes part once, each of its rows counts as a link of the others. n_links counts
    other rows; component_id is the smallest vec_id reachable. Vectors are expected to be of one length.
    """
    double = embeddings.schema["embedding"].dataType.elementType.typeName() == "double"
    kind = "<f8" if double else "<f4"
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    ok &= F.exists("embedding", lambda x: x != 0)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "raw": [np.asarray(v, kind).tobytes() for v in b["embedding"]]})

    label = F.col("label").cast("int")
    rows = written(embeddings.filter(ok).select("vec_id", label.alias("label"), "embedding").mapInPandas(raw, "vec_id long, label int, raw binary"), "rows")
    classes = written(rows.groupBy("label", "raw").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("n")), "classes")
    graph, _ = neighbour_graph(classes.select("rid", "label", "raw"), kind, least, seed=seed)
    links = graph.filter(F.col("sim") >= least).select("u", "v")
    links = written(links.union(links.select("v", "u")).distinct(), "links")
    others = links.join(classes.select(F.col("rid").alias("v"), "n"), "v").groupBy("u").agg(F.sum("n").alias("more"))
    roots = components(links, "u", "v")
    per = classes.join(others, F.col("rid") == F.col("u"), "left").join(roots, F.col("rid") == F.col("node"), "left").select(
        "label", "raw", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "rid").alias("component_id"))
    linked = rows.join(per, ["label", "raw"]).select("vec_id", "n_links", "component_id")
    rest = embeddings.filter(~ok | ok.isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
