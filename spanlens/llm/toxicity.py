"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features are hashed to this many coordinates: the bound of every model's size (8 bytes each while training).
BITS = 20
_WORDS = re.compile(r"\w+")
#: Words whose hashes a worker keeps; then it starts anew.
_KEPT = 150_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def features(text: str | None) -> np.ndarray:
    """Coordinates (with repeats) of the words, of pairs of neighbours and of pairs with one or two words between."""
    words = _WORDS.findall((text or "").lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    """Settings: learning rate ``alpha``, ``beta``, L1 and L2 strength, passes over the sample, seed of the order."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    passes: int = 3
    seed: int = 42


def train(rows: list[np.ndarray], labels: np.ndarray, how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Per-coordinate FTRL-proximal; each row holds distinct coordinates: (coordinates, weights, bias), weights non-zero.

    Coordinates of three or fewer rows, or whose share of label 1 is within two standard errors of the sample's, are left
    out before training. Without both labels the model is a constant, the share of label 1 (one half without rows).
    """
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    often, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, y in zip(rows, labels):
        often[r] += 1
        toxic[r] += y
    share = labels.mean()
    tells = (often > 3) & (np.abs(toxic - share * often) > 2 * np.sqrt(share * (1 - share) * often))
    rows = [np.append(r[tells[r]], 1 << BITS) for r in rows]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full((1 << BITS) + 1, how.l1)
    l1[-1] = 0  # the bias

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2))

    draw = np.random.default_rng(how.seed)
    for _ in range(how.passes):
        for k in draw.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    used = np.flatnonzero(w[:-1])
    return used, w[used], float(w[-1])


def held_out(doc_id, folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, how: Ftrl = Ftrl(), label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``rows`` labelled documents (least seeded hash of doc_id) outside the held-out fold.

    A document with contradicting labels counts as 1; null labels and labels without a document do not count. The
    sample is featurised in tasks; its bounded rows are trained in one task, since FTRL updates follow one another.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_y"))
    some = known.orderBy(F.xxhash64(F.lit(how.seed), "doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``rows`` pairs of numbers

    def coordinates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["_y"], "f": [np.unique(features(t)).astype(np.int32).tobytes() for t in b["text"]]})

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "f": []}), *batches]).sort_values(["doc_id", "f"])
        used, w, bias = train([np.frombuffer(f, np.int32) for f in found["f"]], found["y"].to_numpy(float), how)
        yield pd.DataFrame({"at": [used.astype(np.int32).tobytes()], "w": [w.astype(np.float32).tobytes()], "bias": [bias]})

    row = texts.select("doc_id", "text", F.col("_y").cast("double")).mapInPandas(coordinates, "doc_id long, y double, f binary").repartition(1).mapInPandas(
        model, "at binary, w binary, bias double").first()
    return np.frombuffer(row.at, np.int32), np.frombuffer(row.w, np.float32), row.bias


def score_text(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, held_out, score, predicted; whole texts, null like the empty text.

    The weights, at most 2^20, go to the tasks with the function; every row is scored for itself, so repeated rows and
    null doc_ids (never held out) are rows like any other.
    """
    at, w, bias = model
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((at, w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for b in batches:
            out = np.empty(len(b))
            for k, t in enumerate(b["text"]):
                f = features(t)
                f = np.unique(f[dense[f] != 0])
                out[k] = bias + dense[f].sum(dtype=np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(out, -30, 30)))})

    # the id travels as text: pandas would turn longs with nulls into floats
    scored = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    scored = scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 12_000, how: Ftrl = Ftrl()) -> DataFrame:
    """Score of every document by a model fitted on labels outside the held-out fold; see ``fit`` and ``score_text``."""
    return score_text(docs.select("doc_id", "text"), fit(docs, labels, rows, how), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 12_000, how: Ftrl = Ftrl()) -> DataFrame:
    """``docs`` without the documents that the model predicts to be toxic; all columns stay as they are.

    Kept rows are found in the same pass that scores them, so no row is joined back by an id that may be null or repeated.
    """
    at, w, bias = fit(docs, labels, rows, how)
    sent = docs.sparkSession.sparkContext.broadcast((at, w))
    names = docs.columns
    text = names.index("text")

    def run(batches):
        import pyarrow as pa

        dense = np.zeros(1 << BITS, np.float32)
        dense[sent.value[0]] = sent.value[1]
        limit = np.log(threshold / (1 - threshold)) - bias
        for b in batches:
            keep = []
            for t in b.column(text).to_pylist():
                f = features(t)
                f = np.unique(f[dense[f] != 0])
                keep.append(bool(dense[f].sum(dtype=np.float64) < limit))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
