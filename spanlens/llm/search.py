"""Ranked lexical search of many queries at once: what queries share is computed once a document.

Terms that occur in the same queries form one leaf; pairs of nodes that several queries hold are merged into a node of their own,
again and again. The result is a sharing DAG: its nodes are term sets, its edges say which two sets make a larger one. A block of
documents gets one accumulator row a node, filled once, children first; a query adds up the few nodes left to it.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: (query, term) pairs of one block of queries: what its plan may hold on the driver and in a worker.
BLOCK = 1 << 18
#: Accumulators (nodes times documents) that a worker fills at once.
CELLS = 1 << 22
#: ASCII letters are lower-cased, digits stay, other ASCII characters part terms; bytes of all other characters stay.
_FOLD = bytes(c if chr(c).isalnum() else 32 for c in range(128)).lower() + bytes(range(128, 256))


def terms(raw: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return (raw or b"").translate(_FOLD).split()


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each query's distinct terms; rows of one id are one query, rows of a null id too."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column("item_id"), batch.column("raw")):
                found = sorted(set(terms(raw.as_py())))
                for a in range(0, len(found), 10_000):
                    part = found[a:a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(part), i.type), pa.array(part, pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(split, f"item_id {kind}, term binary").distinct()


@dataclass
class Sharing:
    """A block's DAG. Leaf of each term; levels of (left, right) children, whose nodes are numbered on from the leaves; each query's
    remaining nodes, one after the other, with their starts. ``plain`` and ``adds`` count a document's additions without and with sharing."""

    leaf: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    nodes: int
    left: np.ndarray
    starts: np.ndarray
    plain: int
    adds: int


def mined(queries: list[list[int]], n_terms: int) -> Sharing:
    """The sharing DAG of queries given as lists of distinct term numbers, none empty.

    Each round orders every query's nodes by how many queries hold them, counts neighbours and merges pairs that two or more queries
    share, the most frequent first and each node once a query; it ends when no pair is shared. A round reads each list once.
    """
    holders = defaultdict(list)
    for q, ts in enumerate(queries):
        for t in ts:
            holders[t].append(q)
    of_set: dict[tuple, int] = {}
    leaf = np.zeros(n_terms, np.int64)
    for t in sorted(holders):
        leaf[t] = of_set.setdefault(tuple(holders[t]), len(of_set))
    lists = [sorted({int(leaf[t]) for t in ts}) for ts in queries]
    plain = sum(len(ts) - 1 for ts in queries)
    nodes, levels = len(of_set), []
    while True:
        held = Counter(itertools.chain.from_iterable(lists))
        pairs: Counter = Counter()
        for ns in lists:
            ns.sort(key=lambda x: (-held[x], x))
            pairs.update(itertools.pairwise(ns))
        made: dict[tuple[int, int], int] = {}
        uses: Counter = Counter()
        ranked = {p: i for i, (p, c) in enumerate(sorted(pairs.items(), key=lambda e: (-e[1], e[0]))) if c > 1}
        chosen = []
        for ns in lists:  # in each query the best pairs that do not overlap
            taken, mine = set(), []
            for p in sorted((p for p in itertools.pairwise(ns) if p in ranked), key=ranked.__getitem__):
                if not taken & set(p):
                    taken.update(p)
                    mine.append(p)
            uses.update(mine)
            chosen.append(mine)
        for p in sorted((p for p, c in uses.items() if c > 1), key=ranked.__getitem__):
            made[p] = nodes + len(made)
        if not made:
            break
        for q, mine in enumerate(chosen):
            merged = [p for p in mine if p in made]
            gone = set(itertools.chain.from_iterable(merged))
            lists[q] = [x for x in lists[q] if x not in gone] + [made[p] for p in merged]
        levels.append((np.array([a for a, _ in made]), np.array([b for _, b in made])))
        nodes += len(made)
    sizes = np.array([len(ns) for ns in lists])
    in_leaves = n_terms - len(of_set)
    return Sharing(leaf, levels, nodes, np.array(list(itertools.chain.from_iterable(lists))), np.concatenate(([0], np.cumsum(sizes)[:-1])),
                   plain, in_leaves + nodes - len(of_set) + int((sizes - 1).sum()))


def occurrences(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs): each document's number of terms, and which of ``words`` it holds how often (int32 lists)."""
    env = docs.sparkSession.sparkContext.broadcast(words)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(env.value)}
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                sizes, ids, tfs = [], [], []
                for raw in batch.column("raw"):
                    found = terms(raw.as_py())
                    at = np.fromiter(map(number.get, found, itertools.repeat(-1)), np.int32, len(found))
                    i, n = np.unique(at[at >= 0], return_counts=True)
                    sizes.append(len(found))
                    ids.append(i.astype("<i4").tobytes())
                    tfs.append(n.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                                                  pa.array(tfs, pa.binary())], ["doc_id", "n", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, n long, ids binary, tfs binary")


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each of the block's terms; a task counts its own documents first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4"), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in found.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Best:
    """The k best (score, then smaller document) of each of several queries, kept up as blocks of scores arrive."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.zeros(queries, np.int64)
        self.q, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: one row a query, one column a document; only scores above 0 count."""
        q, d = np.nonzero((scores >= self.least[:, None]) & (scores > 0))
        q, score, doc = np.concatenate((self.q, q)), np.concatenate((self.score, scores[q, d])), np.concatenate((self.doc, docs[d]))
        order = np.lexsort((doc, -score, q))
        q, score, doc = q[order], score[order], doc[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        self.q, self.score, self.doc = (x[place < self.k] for x in (q, score, doc))
        last = q[place == self.k - 1]
        self.least[last] = score[place == self.k - 1]


def best_documents(found: DataFrame, ids: list, plan: Sharing, weight: np.ndarray, n_docs: int, n_all: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents of every query of the block."""
    env = found.sparkSession.sparkContext.broadcast((ids, plan, weight))
    doc = found.schema["doc_id"].dataType.simpleString()

    def accumulate(plan: Sharing, weight: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        term = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4")
        tf = np.frombuffer(b"".join(batch.column("tfs").to_pylist()), "<i4").astype(np.int64)
        sizes = np.array([len(x) // 4 for x in batch.column("ids").to_pylist()])
        at = np.repeat(np.arange(batch.num_rows), sizes)
        m = 100 - 90 + (90 * batch.column("n").to_numpy() * n_docs) // n_all
        cells = np.zeros((plan.nodes, batch.num_rows), np.int64)
        np.add.at(cells, (plan.leaf[term], at), weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at])))
        node = plan.nodes - sum(len(a) for a, _ in plan.levels)
        for a, b in plan.levels:
            np.add(cells[a], cells[b], out=cells[node:node + len(a)])
            node += len(a)
        return np.add.reduceat(cells[plan.left], plan.starts, axis=0)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, plan, weight = env.value
        best, kind = Best(len(queries), k), None
        for whole in batches:
            kind, step = whole.schema.field("doc_id").type, max(1, CELLS // plan.nodes)
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                best.add(accumulate(plan, weight, batch), batch.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy())
        docs = [None if d == _NO_ID else d for d in best.doc.tolist()]
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([queries[q] for q in best.q.tolist()]).cast(pa.int64()), pa.array(docs, kind), pa.array(best.score)],
                                             ["item_id", "doc_id", "score"])

    return found.mapInArrow(rank, f"item_id long, doc_id {doc}, score long")


#: Stands for a null document id while ranking: it comes after every other id.
_NO_ID = (1 << 63) - 1


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each query's ``k`` highest-scoring documents: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    Ids are integers. A null or empty text has no terms: as a document it takes part in nothing, as a query it has no rows. Rows of
    one item_id are one query, null ids included. Rows of one doc_id are documents of their own and may rank beside each other; a
    null doc_id comes last among equal scores. Without documents, queries or common terms the result is empty. Other columns are not
    read. Texts of any length count whole. Scores are 64-bit integers; sums of a term and a document do not depend on their order.

    Queries are worked on in blocks of about ``BLOCK`` (query, term) pairs by a hash of their id, every block against all documents;
    a block's terms and plan are what the driver holds and sends. Documents never move: each task keeps its k best of each query.
    """
    pairs = written(query_terms(items), "terms")
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw"))
    blocks = max(1, math.ceil(pairs.count() / BLOCK))
    out = None
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        queries = sorted(((r.item_id, [bytes(t) for t in r.terms]) for r in mine.collect()), key=lambda q: (q[0] is None, q[0]))
        if not queries:
            continue
        words = sorted(set(itertools.chain.from_iterable(ts for _, ts in queries)))
        number = {w: i for i, w in enumerate(words)}
        found = written(occurrences(texts, words), "found")
        n_docs, n_all = found.agg(F.count(F.expr("if(n > 0, 1, null)")), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(found, len(words))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        plan = mined([[number[t] for t in ts] for _, ts in queries], len(words))
        best = best_documents(found.where("n > 0"), [i for i, _ in queries], plan, weight, n_docs, n_all, k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = texts.limit(0).select(F.lit(None).cast("long").alias("item_id"), "doc_id", F.lit(None).cast("long").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The same ranks by an inverted list.
SQL = rf"""
with docs as (
    select row_number() over () as r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') as ts
    from documents where text is not null),
stats as (select count(*) as nn, sum(len(ts))::bigint as ll from docs where len(ts) > 0),
items as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) as term
    from benchmark),
tf as (
    select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(ts) as n, unnest(ts) as term from docs)
    where term in (select term from items) group by r, doc_id, n, term),
weights as (
    select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint as w
    from (select term, count(*) as df from tf group by term), stats),
scores as (
    select item_id, r, any_value(doc_id) as doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::bigint as score
    from items join tf using (term) join weights using (term), stats group by item_id, r)
select item_id, cast(rank as integer) as rank, doc_id, score from (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 10
"""
