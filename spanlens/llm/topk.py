"""Exact top-k inner products by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, usable

#: Rows of the sample that pivots are picked from, pivots, and rings of distance around each: bounds of the directory.
SAMPLE, PIVOTS, RINGS = 4096, 24, 8
#: Rows of one block of an annulus, and of one batch of queries: what a task holds at once.
BLOCK, BATCH = 8192, 1024


def pick_pivots(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Distinct sample vectors, each far from those before it (greedy, among a seeded draw)."""
    if not len(sample):
        return sample
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(seed).permutation(len(sample))]
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, from integer components exact up to the root."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1), 0))


def keyed(vectors: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """Adds the nearest pivot, the distance to it, the ring of that distance and the squared norm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["x"])
            if not len(x):
                continue
            d = distances(x, pivots)
            near = d.argmin(1)
            b = b.assign(pivot=near.astype(np.int32), dist=d[np.arange(len(x)), near], norm2=(x * x).sum(1))
            yield b.assign(ring=np.minimum(b["dist"] // width, RINGS - 1).astype(np.int32))

    return vectors.mapInPandas(run, "vec_id long, x binary, query boolean, pivot int, dist double, norm2 double, ring int")


def bounds(q: np.ndarray, pivots: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
    """For each query and annulus, the greatest inner product that a member can have.

    The triangle inequality bounds a member's distance from below by how far the query is outside the annulus;
    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 turns that into a bound on the score, and |q.x - q.p| <= |q| |x - p| into
    another; the lesser counts. A small allowance covers rounding, so no member is lost.
    """
    d = distances(q, pivots)[:, cells["pivot"].to_numpy()]
    gap = np.maximum(np.maximum(d - cells["far"].to_numpy(), cells["near"].to_numpy() - d), 0)
    q2 = (q * q).sum(1)[:, None]
    by_distance = (q2 + cells["norm2"].to_numpy() - gap * gap) / 2
    by_pivot = (q @ pivots.T)[:, cells["pivot"].to_numpy()] + np.sqrt(q2) * cells["far"].to_numpy()
    return np.minimum(by_distance, by_pivot) + 1e-6 * (1 + np.abs(by_distance))


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best members for each query, other than itself; ties to the smaller id. ``ids`` ascend."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    else:
        least = np.full(len(q), -np.inf)
    row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    score = s[row, col]
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return pd.DataFrame({"query_id": q_ids[row[keep]], "vec_id": ids[col[keep]], "score": score[keep].astype(np.int64)})


def top_k(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the exact k best candidates of each query by integer inner product.

    ``embeddings``: vec_id, embedding. Each component becomes floor(scale * x). Queries are the rows whose vec_id is
    divisible by ``every``, candidates all rows but the query's own; ties go to the smaller vec_id. Rows that are null, empty,
    hold null or non-finite components, or have a null vec_id take no part; rows of one vec_id and vector count once.
    Vectors are expected to be of one length.

    Index: each vector is keyed by its nearest pivot and ring of distance; the directory of annuli (at most
    PIVOTS x RINGS rows) goes to every task. First each query searches the most promising annuli that hold k candidates together, which
    gives a score that k candidates reach. Then it searches every further annulus whose bound reaches that score, and no
    other. Annuli are dealt in blocks, queries in batches, so no task holds more than one of each.
    """
    spark = embeddings.sparkSession
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", x.alias("x")).dropDuplicates()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "x": [np.asarray(v, np.float64).tobytes() for v in b["x"]], "query": b["vec_id"] % every == 0})

    base = written(rows.mapInPandas(pack, "vec_id long, x binary, query boolean"), "vectors")
    sample = matrix(r.x for r in base.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).select("x").collect())
    out_kind = "query_id long, vec_id long, score long"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = pick_pivots(sample, PIVOTS, seed)
    width = float(distances(sample, pivots).min(1).max()) / RINGS or 1.0
    index = written(keyed(base, pivots, width), "index")
    cells = index.groupBy("pivot", "ring").agg(F.min("dist").alias("near"), F.max("dist").alias("far"), F.max("norm2").alias("norm2"),
                                               F.count(F.lit(1)).alias("n")).toPandas()  # at most PIVOTS x RINGS rows
    cells["blocks"] = -(-cells["n"] // BLOCK)
    sent = spark.sparkContext.broadcast((pivots, cells))
    blocks_of = F.broadcast(spark.createDataFrame(cells[["pivot", "ring", "blocks"]].reset_index().rename(columns={"index": "cell"}).astype(int)))
    members = index.join(blocks_of, ["pivot", "ring"]).select(
        F.col("cell").cast("int").alias("cell"), F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "x")
    n_queries = index.filter("query").count()
    batches_of = -(-n_queries // BATCH) or 1
    queries = index.filter("query").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"),
                                           F.pmod(F.xxhash64("vec_id"), F.lit(batches_of)).cast("int").alias("batch"))

    def visits(again: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, cells = sent.value
            for p in parts:
                q = matrix(p["q"])
                if not len(q):
                    continue
                most = bounds(q, pivots, cells)
                order = np.argsort(-most, axis=1, kind="stable")
                have = np.cumsum(cells["n"].to_numpy()[order], axis=1)
                first = np.zeros(most.shape, bool)  # the most promising annuli that hold k candidates besides the query
                np.put_along_axis(first, order, np.concatenate((np.zeros((len(q), 1)), have[:, :-1]), axis=1) < k + 1, axis=1)
                go = ~first & (most >= p["floor"].to_numpy()[:, None]) if again else first
                row, cell = np.nonzero(go)
                count = cells["blocks"].to_numpy()[cell]
                row, cell = np.repeat(row, count), np.repeat(cell, count)
                block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                yield pd.DataFrame({"cell": cell, "block": block, "batch": p["batch"].to_numpy()[row], "query_id": p["query_id"].to_numpy()[row], "q": p["q"].to_numpy()[row]})

        return run

    def search(asked: DataFrame) -> DataFrame:
        def one(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(m):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            m = m.sort_values("vec_id")
            xs, ids = matrix(m["x"]), m["vec_id"].to_numpy()
            return pd.concat([best(matrix(c["q"]), c["query_id"].to_numpy(), xs, ids, k) for c in (q[i:i + BATCH] for i in range(0, len(q), BATCH))])

        keys = ["cell", "block", "batch"]
        asked = written(asked, "visits")
        wanted = asked.select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("batch").alias("to")).distinct()
        copies = members.join(wanted, (F.col("cell") == F.col("c")) & (F.col("block") == F.col("b"))).select(
            "cell", "block", F.col("to").alias("batch"), "vec_id", "x")
        return asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(one, out_kind)

    kind = "cell int, block int, batch int, query_id long, q binary"
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    some = written(search(queries.withColumn("floor", F.lit(0.0)).mapInPandas(visits(False), kind)), "first")
    floor = some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    rest = queries.join(floor, "query_id", "left").fillna(float("-inf"), ["floor"])
    more = search(rest.select("query_id", "q", "batch", "floor").mapInPandas(visits(True), kind))
    return some.union(more).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
