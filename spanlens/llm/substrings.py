"""Substring dedup: every word covered by a recurring window of consecutive words goes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Words of the phrase that picks a window's place in the index.
PHRASE = 12
#: Words whose hashes a worker keeps; then it starts anew.
_KEPT = 300_000
# Odd multipliers.
_BASE, _MIX, _SHIFT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_ALL = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = 2 * n + 1024
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[:len(a) - (width - done)], a[width - done:]) if width > done else a


class Words:
    """A text's words and hashes of any stretch of them."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(self.words)
        up, self.down = _power(n)
        h = np.fromiter(map(_hashes.__getitem__, self.words), np.uint64, n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)))

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a to b - 1, the same wherever these words stand."""
        return _scrambled((self.sums[b] - self.sums[a]) * self.down[a])

    def runs(self, window: int, phrase: int = PHRASE) -> tuple[np.ndarray, ...]:
        """(phrase hash, run hash, first window, windows): consecutive windows whose least phrase is the same one.

        A window's phrase is the one of least hash inside it, the leftmost of equals, so equal windows have equal
        phrases at equal places. The run hash is of all the run's words and of where in it the phrase stands.
        """
        n = len(self.words)
        if n < window:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        at = np.arange(n - phrase + 1)
        g = self.stretch(at, at + phrase)
        span = window - phrase + 1
        least = _slide(g, span, np.minimum)
        edge = np.zeros(span - 1, np.uint64)
        marks = np.flatnonzero(_slide(np.concatenate((edge, least, edge)), span, np.maximum) == g)
        pick = np.searchsorted(marks, np.arange(len(least)))
        while len(wrong := np.flatnonzero(g[marks[pick]] != least)):
            pick[wrong] += 1
        place = marks[pick]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        phrase_at = place[first]
        run = self.stretch(first, last + window) + _scrambled((phrase_at - first).astype(np.uint64) + np.uint64(_SHIFT))
        return g[phrase_at], run, first, last - first + 1


def covered(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """Mask of the words inside any of the stretches."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def _runs(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b[i:i + 500]
                found = [Words(t).runs(window) for t in part["text"]]
                g, r, first, n = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"k": np.repeat(part["k"].to_numpy(), [len(f[0]) for f in found]), "g": g.view(np.int64),
                                    "r": r.view(np.int64), "s": first.astype(np.int32), "n": n.astype(np.int32)})

    return docs.mapInPandas(run, "k long, g long, r long, s int, n int")


def recurring(docs: DataFrame, window: int) -> DataFrame:
    """(k, a, b): stretches of words of the text ``k`` that are covered by windows that also start elsewhere.

    ``docs``: k, text. One row a run (some ten words apart) is counted by its phrase, combined before the shuffle, and joined
    back in joins that adaptive execution can split. Phrases that occur once confirm
    that none of their windows recurs; runs that are equal as a whole (in phrase, all 64 bits of the run hash and number of
    windows, so that millions of runs may share a phrase) confirm that all theirs do. Only one of each kind of the others, where passages begin and end, is looked at window by window, with 128-bit digests of the words themselves.
    """
    every = written(_runs(docs, window), "every-run")
    # what is counted by a key is written before it is joined by that key: only a join of plain exchanges can be split
    phrases = written(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"), "phrases")
    found = written(every.join(phrases, "g", "left_semi"), "found-runs")
    drop_written(every)
    kinds = written(found.groupBy("g", "r", "n").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "s")).alias("one")), "kinds")
    kinds = written(kinds.join(written(kinds.groupBy("g").agg(F.min("times").alias("least")), "least"), "g"), "kinds")
    runs = written(found.join(kinds, ["g", "r", "n"]).select(
        "k", "s", "n", "times", ((F.col("least") == 1) & (F.struct("k", "s") == F.col("one"))).alias("ask")), "runs")
    drop_written(found)
    asked = runs.filter("ask").groupBy("k").agg(F.collect_set(F.struct("s", "n", "times")).alias("runs"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, text, some in zip(b["k"], b["text"], b["runs"]):
                words = Words(text).words
                rows = [(hashlib.blake2b(b" ".join(words[s:s + window]), digest_size=16).digest(), k, s, int(x["times"]))
                        for x in some for s in range(x["s"], x["s"] + x["n"])]
                yield pd.DataFrame(rows, columns=["w", "k", "s", "times"])

    texts = docs.join(asked, "k").dropDuplicates(["k"])
    each = written(texts.select("k", "text", "runs").mapInPandas(windows, "w binary, k long, s int, times long"), "windows")
    twice = each.groupBy("w").agg(F.sum("times").alias("all")).filter("all > 1").select("w")
    edges = each.filter("times = 1").join(twice, "w", "left_semi")
    return runs.filter("times > 1").select("k", F.col("s").alias("a"), (F.col("s") + F.col("n") + window - 1).alias("b")).union(
        edges.select("k", F.col("s").alias("a"), (F.col("s") + window).alias("b")))


def drop_recurring(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space): documents without words of recurring windows.

    A window is ``window`` consecutive words of one document; it recurs if its words also start anywhere else, in another
    document, in this one, overlapping included. Windows are judged on the input. Null and empty texts have no words;
    texts of fewer words than a window lose none. Rows are told apart by a 64-bit hash of doc_id and text only to carry
    results back; repeated rows are occurrences like any other, and each of them loses its windows.
    """
    if window < PHRASE:
        raise ValueError(f"window must hold the phrase of {PHRASE} words")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    parts = recurring(keyed.select("k", "text"), window).groupBy("k").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, starts, ends in zip(b["doc_id"], b["text"], b["a"], b["b"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if starts is None:
                    kept = words
                else:
                    kept = [words[i] for i in np.flatnonzero(~covered(len(words), starts, ends)).tolist()]
                rows.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    joined = keyed.join(parts, "k", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "a", "b")
    out = joined.mapInPandas(cut, "doc_id string, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def substring_report(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; see ``drop_recurring``."""
    return drop_recurring(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
