"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, written

#: The hash is read in two digits of this many bits before single documents are looked at.
DIGIT_BITS = 12


@dataclass(frozen=True)
class MixPlan:
    """``sources``: source -> (size, target). ``patterns``: key -> (size, flow by source)."""

    sources: dict[str | None, tuple[int, float]]
    patterns: dict[str, tuple[int, dict[str | None, int]]]


def reshared_targets(sizes: dict[str | None, int], total: float, weights: tuple[float, ...], most: float) -> dict[str | None, float]:
    """Share ``total`` by weight; a source gets at most ``most`` times its size, the excess is reshared by weight.

    Sources are taken in code point order with null last; ``weights`` repeats over them. Where every source has
    reached its limit the rest of ``total`` stays unshared.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    open_ = list(order)
    while open_:
        left = total - sum(target.values())
        unit = left / (sum(weight[s] for s in open_) or 1)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        for s in full or open_:
            target[s] = float(most * sizes[s]) if full else unit * weight[s]
        open_ = [s for s in open_ if s not in target]
    return target


def route(capacity: dict[str, int], members: dict[str, list], quota: dict[str | None, int], repeats: int) -> dict[str, dict]:
    """Min-cost flow of words from patterns to the quotas of their sources.

    The r-th copy of a pattern's words costs 2r - 1 a word, so repetition is convex and spread before it is raised.
    Successive cheapest paths (Dijkstra over reduced costs); nodes are patterns and sources, never documents.
    """
    names = ["<in>", *(("p", p) for p in capacity), *(("s", s) for s in quota), "<out>"]
    at = {n: i for i, n in enumerate(names)}
    head: list[list[int]] = [[] for _ in names]
    to, room, cost = [], [], []

    def arc(u, v, c, w):
        for x, y, r, k in ((u, v, c, w), (v, u, 0, -w)):
            head[x].append(len(to))
            to.append(y), room.append(r), cost.append(k)

    for p, c in capacity.items():
        for r in range(1, repeats + 1):
            arc(0, at["p", p], c, 2 * r - 1)
        for s in members[p]:
            arc(at["p", p], at["s", s], c * repeats, 0)
    for s, q in quota.items():
        arc(at["s", s], len(names) - 1, q, 0)
    potential = [0] * len(names)
    while True:
        best, via, queue = {0: 0}, {}, [(0, 0)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > best[u]:
                continue
            for e in head[u]:
                if room[e] > 0 and (n := d + cost[e] + potential[u] - potential[to[e]]) < best.get(to[e], n + 1):
                    best[to[e]], via[to[e]] = n, e
                    heapq.heappush(queue, (n, to[e]))
        out = len(names) - 1
        if out not in best:
            break
        for i in range(len(names)):
            potential[i] += best.get(i, best[out])
        path, v = [], out
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flow: dict[str, dict] = {p: {} for p in capacity}
    for p in capacity:
        for e in head[at["p", p]]:
            if not e & 1 and room[e ^ 1] > 0:
                flow[p][names[to[e]][1]] = room[e ^ 1]
    return flow


def mix(docs: DataFrame, members: Column, size: Column, ident: list[Column], *, share: float = 1.5,
        weights: tuple[float, ...] = (3, 1, 2), repeats: int = 2, seed: int = 42, out: str = "mix") -> tuple[DataFrame, MixPlan]:
    """Choose how often each document is taken so that every source's words come near its target.

    ``members``: array of the sources that a document belongs to (overlap is allowed; a null element is a source of
    its own; null or empty array: in no source, never taken). ``size``: words of a document. ``ident``: columns that
    tell documents apart; the seeded order hashes them, so reruns agree, and rows that agree in all of them are taken
    together. Returns ``docs`` with a struct column ``out`` (size, pattern, copies, taken, quota) and the plan. An
    existing column of that name is kept and the new one gets underscores: read the name off ``columns[-1]``.

    One row per membership pattern and per source reaches the driver; both are bounded by the weight table that the
    caller states, not by documents. A pattern's flow is a number of whole copies for all its documents and one more
    for those below a hash threshold. The threshold is found digit by digit over grouped sums, so that no window ever
    holds more than the documents that share two digits (1 in 2^24). Empty tables give no rows; documents without words
    take none.
    """
    spark = docs.sparkSession
    name = free_name(docs, out)
    key, n, h = (free_name(docs, f"_{name}_{c}") for c in ("key", "size", "hash"))
    pattern = F.when(F.size(members) > 0, F.to_json(F.array_sort(F.array_distinct(members))))
    rows = docs.select("*", pattern.alias(key), F.coalesce(size.cast("long"), F.lit(0)).alias(n),
                       F.xxhash64(F.lit(seed), *ident).bitwiseAND(F.lit((1 << 63) - 1)).alias(h))
    narrow = written(rows.select(F.col(key).alias("k"), F.col(n).alias("n"), F.col(h).alias("h")).filter("k is not null"), "mix")
    found = narrow.groupBy("k").agg(F.sum("n").alias("n")).withColumn("m", F.from_json("k", "array<string>")).collect()
    of = {r.k: list(r.m) for r in found}
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in r.m:
            sizes[s] = sizes.get(s, 0) + r.n
    target = reshared_targets(sizes, share * sum(r.n for r in found), weights, repeats)
    flow = route({r.k: r.n for r in found}, of, {s: round(t) for s, t in target.items()}, repeats)
    plan = MixPlan({s: (sizes[s], target[s]) for s in sizes}, {r.k: (r.n, flow[r.k]) for r in found})

    quota = []
    for r in found:
        total = sum(flow[r.k].values())
        whole = total // r.n if r.n else 0
        upto, shares = 0, []
        for s, f in flow[r.k].items():
            upto += f
            shares.append((s, upto / total))
        quota.append((r.k, whole, total - whole * r.n, shares))
    steps = spark.createDataFrame(quota, "k string, whole long, rest long, shares array<struct<source: string, upto: double>>")

    left = F.broadcast(steps.select("k", "rest").filter("rest > 0"))  # one row a pattern, as collected above
    low = narrow.filter("n > 0").join(left, "k").select("k", "rest", "n", "h", *(
        F.shiftright("h", 63 - DIGIT_BITS * (i + 1)).alias(f"d{i}") for i in range(2)))
    keys = ["k"]
    for digit in ("d0", "d1", "h"):
        w = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
        sums = low.groupBy(*keys, "rest", digit).agg(F.sum("n").alias("s")).withColumn("upto", F.sum("s").over(w))
        if digit == "h":
            break
        edge = sums.filter("upto >= rest and upto - s < rest").select(*keys, digit, (F.col("rest") - F.col("upto") + F.col("s")).alias("rest"))
        keys.append(digit)
        low = low.drop("rest").join(edge, keys)
    # below the edge digit everything goes, in it the documents that end nearest to the rest
    low_edge = sums.groupBy("k").agg(F.max(F.when(F.col("upto") - F.col("s") / 2 <= F.col("rest"), F.col("h"))).alias("last"), F.min("h").alias("first"))
    edge = low_edge.select("k", F.coalesce("last", F.col("first") - 1).alias("last"))
    draw = F.xxhash64(F.lit(seed + 1), F.col(h)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    plan_rows = steps.join(F.broadcast(edge), "k", "left").select(F.col("k").alias(key), "whole", "last", "shares")
    copies = F.when(F.col(n) == 0, 0).otherwise(F.coalesce(F.col("_p.whole") + (F.col(h) <= F.coalesce("_p.last", F.lit(-1))).cast("long"), F.lit(0)))
    joined = rows.join(F.broadcast(plan_rows.select(key, F.struct("whole", "last", "shares").alias("_p"))), key, "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(
        F.col(n).alias("size"), F.col(key).alias("pattern"), copies.alias("copies"), (copies * F.col(n)).alias("taken"),
        F.when(copies > 0, F.filter("_p.shares", lambda s: s["upto"] > draw)[0]["source"]).alias("quota")).alias(name)), plan


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``mix`` by the column ``source`` with words of ``text`` as size; adds size, source_size, target, copies, taken.

    Only doc_id and source come along. Null doc_id, source or text are values like any other; see ``mix``.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    mixed, plan = mix(written(rows, "mix-docs"), F.array("source"), F.col("size"), [F.col("doc_id"), F.col("digest")], **how)
    per = docs.sparkSession.createDataFrame([(s, n, t) for s, (n, t) in plan.sources.items()], "src string, source_size long, target double")
    return mixed.join(F.broadcast(per), F.col("source").eqNullSafe(F.col("src"))).select(
        "doc_id", "source", "size", "source_size", "target", F.col("mix.copies").alias("copies"), F.col("mix.taken").alias("taken"))


def take_copies(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: ``docs`` with each document as often as ``mix`` takes it, zero times included."""
    mixed, _ = mix(docs, F.array("source"), word_count(F.col("text")), [F.col("doc_id"), F.xxhash64("text")], **how)
    name = mixed.columns[-1]
    times = mixed.filter(F.col(name)["copies"] > 0).select(
        *(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(1), F.col(name)["copies"].cast("int"))))
    return times.select(*(F.col(f"`{c}`") for c in docs.columns))
